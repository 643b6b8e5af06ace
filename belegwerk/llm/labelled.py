"""Which labelled rows may be learned from, and small fits on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.session import small_batches


def held_out(key: str | Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    column = F.col(key) if isinstance(key, str) else key
    fold = F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2
    return F.coalesce(fold, F.lit(False))


def training_sample(labels: DataFrame, label: str, per_class: int | None) -> DataFrame:
    """``(doc_id, label)``: up to ``per_class`` learnable rows of each class, by hash order; None: all.

    Rows without an id or a label are not learned from.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id")
    ).dropDuplicates(["doc_id"])
    if per_class is None:
        return usable
    parts = [
        usable.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for c in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, offset: float | np.ndarray = 0.0,
             weight: np.ndarray | None = None, rounds: int = 40, block: int = 4096) -> np.ndarray:
    """Weights of a ridge logistic regression by damped Newton steps.

    Products run over blocks of rows, so that no second copy of ``x`` is made.
    """
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    scale = max(weight.sum(), 1.0)
    cuts = [slice(k, k + block) for k in range(0, len(x), block)]

    def scores(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(x[c] @ w for c in cuts)]) + offset

    def loss(w: np.ndarray) -> float:
        z = scores(w)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / scale + ridge * (w @ w) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(scores(w))
        wrong, bend = weight * (p - y), weight * p * (1 - p)
        gradient = sum(x[c].T @ wrong[c] for c in cuts) / scale + ridge * w
        curve = sum((x[c] * bend[c][:, None]).T @ x[c] for c in cuts) / scale + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w, before, now = w - rate * step, now, loss(w - rate * step)
        if before - now < 1e-9:
            break
    return w


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_text_column(
    docs: DataFrame, name: str, kind: str, work: Callable[[pa.Array], pa.Array], text: str = "text"
) -> DataFrame:
    """``docs`` with one more column that ``work`` makes of each batch of texts.

    Only the text leaves the JVM and only the new column comes back, so other columns
    may have any names and types.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name} already")

    small_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return work(texts)

    # Else Spark would work twice where a filter and a column use the result.
    made = F.arrow_udf(run, kind).asNondeterministic()
    return docs.withColumn(name, made(F.col(text)))
