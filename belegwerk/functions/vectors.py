"""Vector expressions: similarity, norms, half precision, a hashed embedding."""

from __future__ import annotations

import functools
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.functions.text import tokens

# Scores are rounded so that a threshold or a tie never hangs on the order in
# which a sum was taken; stored vectors carry about 7 significant digits.
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two columns on one row; null for a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.round(dot(a, b) / length, SCORE_DIGITS))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _half(vectors: pa.Array) -> pa.Array:
    flat = vectors.flatten()  # of a batch's vectors that are not null
    with np.errstate(over="ignore"):
        half = flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    at = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    blank = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    return pa.ListArray.from_arrays(at, pa.array(half, pa.float32(), mask=blank), mask=vectors.is_null())


def quantize_half(vector: Column) -> Column:
    """Round a vector to half precision and give it back as floats."""
    return _half(vector)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


@functools.lru_cache(maxsize=8)
def _hashed(dim: int) -> Callable[[Column], Column]:
    """A column function from lists of tokens to vectors of ``dim`` numbers."""

    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        # Words repeat so much that only a batch's distinct ones are hashed.
        bucket = np.array([int.from_bytes(md5(t.encode()).digest()[:4]) % dim for t in coded.dictionary.to_pylist()], np.int64)
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        at = row * dim + bucket[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(at, minlength=len(lists) * dim).reshape(-1, dim).astype(np.float64)
        length = np.sqrt((counts * counts).sum(1))
        unit = (counts / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)
        ends = np.arange(len(lists) + 1) * dim
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(unit.ravel()))

    return F.arrow_udf(run, T.ArrayType(T.FloatType()))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic stand-in model: hashed bag of words, unit length.

    A token's bucket is read from the 32 leading bits of its MD5. A text
    without tokens, or null, has the zero vector.
    """
    return _hashed(dim)(tokens(text))
