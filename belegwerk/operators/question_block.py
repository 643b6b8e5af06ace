"""A bounded block of questions, fetched once and turned into broadcast tables.

Everything the branches need of the questions (ids, vectors, terms, lexemes) is
small once a block is bounded, so it is read from the questions once instead of
being planned again inside every join.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.functions.text import search_terms
from belegwerk.functions.vectors import hashed_embedding
from belegwerk.operators.models import Model
from belegwerk.session import LIMITS, Limits, collect_bounded


def prepare_questions(
    questions: DataFrame, embedding_model: Model = hashed_embedding,
    stop_words: tuple[str, ...] | None = None,
) -> DataFrame:
    """``(qid, question)`` plus search terms, and a vector unless it has one."""
    out = questions.withColumn("terms", search_terms(F.col("question"), stop_words))
    if "embedding" not in questions.columns:
        out = out.withColumn("embedding", embedding_model(F.col("question")))
    return out.select("qid", "question", "terms", "embedding")


def unit_rows(vectors: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row matrix of unit vectors and the mask of rows that have a direction."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dim)
    length = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return rows / np.where(good, length, 1.0)[:, None], good


class QuestionBlock:
    """The collected rows of one block: ``qid`` and any of the prepared columns."""

    def __init__(self, questions: DataFrame, limits: Limits = LIMITS):
        self.spark: SparkSession = questions.sparkSession
        self.qid_type = questions.schema["qid"].dataType
        self.schema = questions.schema
        self.table = collect_bounded(questions, limits)

    def frame(self, *columns: str) -> DataFrame:
        """Some of the columns as a local table."""
        schema = T.StructType([self.schema[c] for c in columns])
        return self.spark.createDataFrame(self.table.select(columns), schema)

    @functools.cached_property
    def vectors(self) -> tuple[pa.Array, np.ndarray]:
        """Question ids and unit vectors; vectors without direction drop out."""
        given = self.table.select(["qid", "embedding"])
        sizes = np.array([0 if v is None else len(v) for v in given["embedding"].to_pylist()], int)
        given = given.filter(pa.array(sizes > 0))
        dims = set(sizes[sizes > 0].tolist())
        if not dims:
            return given["qid"].combine_chunks(), np.zeros((0, 0))
        if len(dims) != 1:
            raise ValueError(f"question vectors of different length: {sorted(dims)}")
        rows, good = unit_rows(given["embedding"], dims.pop())
        return given["qid"].combine_chunks().filter(pa.array(good)), rows[good]

    @functools.cached_property
    def askers(self) -> tuple[list[str], list[list]]:
        """Distinct lower-cased terms in order, and the questions of each."""
        per_term: dict[str, dict] = {}
        # Lower-casing happened in Spark, where the texts are lower-cased too.
        for qid, terms in zip(self.table["qid"].to_pylist(), self.table["terms"].to_pylist()):
            for term in terms or ():
                if term is not None:
                    per_term.setdefault(term, {})[qid] = None
        words = sorted(per_term)
        return words, [list(per_term[w]) for w in words]
