"""Tables of texts to token ids and back, with the encoder of ``byte_bpe``.

Defined results: a null text counts as empty and has no ids; a null key stays
null; a null id list decodes to an empty text; an id outside the vocabulary
raises; repeated rows are encoded each for itself; an empty table gives an empty
one. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from belegwerk.llm.arrow_text import slices
from belegwerk.llm.byte_bpe import encoder

Batches = Iterator[pa.RecordBatch]


def encoded_batches(batches: Batches, path: str) -> Batches:
    """``(key, text)`` to ``(key, ids)``, a few megabytes of text at a time."""
    for batch in batches:
        for lo, hi, _, _ in slices(batch.column(1)):
            ids, bounds = encoder(path).encode(batch.column(1).slice(lo, hi - lo))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["key", "ids"])


def decoded_batches(batches: Batches, path: str) -> Batches:
    """``(key, ids)`` to ``(key, ids, decoded)``; special tokens stay."""
    for batch in batches:
        lists = batch.column(1)
        bounds = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=bounds[1:])
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(encoder(path).size)):
            raise ValueError("an id is outside the vocabulary")
        texts = pa.array(encoder(path).decode(ids, bounds), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["key", "ids", "decoded"])


def digest_batches(batches: Batches) -> Batches:
    """``(key, ids, decoded)`` to counts and digests of both."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().fill_null(0)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False)).tolist()
        yield pa.RecordBatch.from_arrays([
            batch.column(0), sizes.cast(pa.int64()),
            pa.array([sha(ids[a:b].data) for a, b in zip([0, *ends], ends)], pa.string()),
            pa.array([sha(t.encode()) for t in batch.column(2).to_pylist()], pa.string()),
        ], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` with the ids of every whole text as ``array<int>``.

    ``path`` names the vocabulary file on every worker.
    """
    run = lambda batches: encoded_batches(batches, path)
    out = docs.select(key, text).mapInArrow(run, f"key {_key_type(docs, key)}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, ids, decoded)``: the text of every list of ids."""
    run = lambda batches: decoded_batches(batches, path)
    schema = f"key {_key_type(encoded, key)}, ids array<int>, decoded string"
    return encoded.select(key, ids).mapInArrow(run, schema).withColumnsRenamed({"key": key, "ids": ids})


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest whole texts in one pass of one worker.

    ``(key, n_tokens, ids_sha256, decoded_sha256)``: ids hashed as little-endian
    unsigned 32-bit numbers, decoded texts as UTF-8.
    """
    run = lambda batches: digest_batches(decoded_batches(encoded_batches(batches, path), path))
    schema = f"key {_key_type(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
