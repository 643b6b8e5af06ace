"""Two-level chunking of documents: recursive and fixed-stride."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.fixed_values import CHILD_OVERLAP, CHILD_SIZE, PARENT_OVERLAP, PARENT_SIZE

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, lo: int, hi: int, sep: str) -> list[tuple[int, int]]:
    """Spans of text[lo:hi] cut in front of every separator."""
    if sep == "":
        return [(i, i + 1) for i in range(lo, hi)]
    cuts, at = [lo], text.find(sep, lo, hi)
    while at >= 0:
        cuts.append(at)
        at = text.find(sep, at + len(sep), hi)
    cuts.append(hi)
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def split_text(
    text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters that prefer to break at separators.

    The first separator found in a span cuts it; short neighbours are packed
    together, and the tail of one chunk, up to ``overlap`` characters, opens the
    next. A piece that is still too long is cut by the next separator.
    """
    chunks: list[str] = []

    def emit(lo: int, hi: int) -> None:
        chunk = text[lo:hi].strip()
        if chunk:
            chunks.append(chunk)

    def pack(run: list[tuple[int, int]]) -> None:
        """Slide a window of whole pieces over a run of adjacent pieces."""
        first = 0
        for i, (lo, hi) in enumerate(run):
            if hi - run[first][0] > size and first < i:
                emit(run[first][0], lo)
                while first < i and (lo - run[first][0] > overlap or hi - run[first][0] > size):
                    first += 1
        if run:
            emit(run[first][0], run[-1][1])

    def cut(lo: int, hi: int, level: int) -> None:
        while level < len(separators) - 1 and text.find(separators[level], lo, hi) < 0:
            level += 1
        run: list[tuple[int, int]] = []
        for a, b in _pieces(text, lo, hi, separators[level]):
            if b - a < size:
                run.append((a, b))
                continue
            pack(run)
            run = []
            if level + 1 < len(separators):
                cut(a, b, level + 1)
            else:
                emit(a, b)
        pack(run)

    cut(0, len(text), 0)
    return chunks


def recursive_chunks(
    text: Column, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS
) -> Column:
    """``array<string>`` of recursive chunks, one Arrow batch at a time."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, size, overlap, separators))

    return run(text)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """``array<string>`` of windows of ``size`` characters every ``size - overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    stride = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / stride) - 1, F.lit(0)).cast("int")
    return F.when(F.length(text) > 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * stride + 1, F.lit(size))
    )).otherwise(F.array().cast("array<string>"))


def chunk_rows(df: DataFrame, chunks: Column, text: str, index: str) -> DataFrame:
    """One row per chunk, numbered from 0; a text without chunks gives no row."""
    return df.select("*", F.posexplode(chunks).alias(index, text))


def chunk_recursive(
    df: DataFrame, column: str, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP,
    out: str = "chunk", index: str = "chunk_idx",
) -> DataFrame:
    """Recursive chunking of a text column, one row per chunk."""
    return chunk_rows(df, recursive_chunks(F.col(column), size, overlap), out, index)


def stable_id(*parts: Column) -> Column:
    """Deterministic id, so that a repeated write repeats its ids."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)


def split_parents(
    docs: DataFrame, method: str = "recursive",
    size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP,
) -> DataFrame:
    """Parent blocks of documents ``(title, source_url, summary, text)``."""
    cut = {"recursive": recursive_chunks, "fixed": fixed_chunks}[method]
    rows = docs.select(
        "title", "source_url", "summary",
        F.posexplode(cut(F.col("text"), size, overlap)).alias("parent_idx", "full_text"),
    )
    return rows.withColumn("id", stable_id(F.col("title"), F.col("parent_idx"), F.col("full_text")))


def split_children(
    parents: DataFrame, method: str = "recursive",
    size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP,
) -> DataFrame:
    """Child chunks of parent blocks ``(id, full_text)``, with their ``document`` if they have it."""
    cut = {"recursive": recursive_chunks, "fixed": fixed_chunks}[method]
    kept = ["document"] if "document" in parents.columns else []
    rows = parents.select(
        F.col("id").alias("parent_id"), *kept,
        F.posexplode(cut(F.col("full_text"), size, overlap)).alias("child_idx", "content"),
    )
    return rows.withColumn("id", stable_id(F.col("parent_id"), F.col("child_idx"), F.col("content")))


def first_children(
    parents: DataFrame, method: str = "recursive",
    size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP, kept: tuple[str, ...] = (),
) -> DataFrame:
    """``(parent_id, first_chunk[, <kept>])``: the smallest id among the child chunks of every block that has any.

    A block's chunks are cut again where it is, so that their ids need not be shuffled.
    """
    cut = {"recursive": recursive_chunks, "fixed": fixed_chunks}[method]
    ids = F.transform(
        cut(F.col("full_text"), size, overlap), lambda content, n: stable_id(F.col("id"), n, content)
    )
    rows = parents.select(F.col("id").alias("parent_id"), F.array_min(ids).alias("first_chunk"), *kept)
    return rows.filter(F.col("first_chunk").isNotNull())
