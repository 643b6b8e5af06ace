"""Checks and counts over corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_corpus(parents: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """Violations ``(rule, id, n)`` of keys, references and vector lengths."""
    def repeated(df: DataFrame, rule: str) -> DataFrame:
        return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.lit(rule).alias("rule"), F.col("id").cast("string"), "n"
        )

    def rows(df: DataFrame, rule: str) -> DataFrame:
        return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(rule).alias("rule"), F.col("id").cast("string"), "n"
        )

    known = parents.select(F.col("id").alias("parent_id")).distinct()
    orphans = chunks.filter("parent_id is not null").join(known, "parent_id", "left_anti")
    wrong = chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") != dim))
    return (
        repeated(parents, "parent id repeated")
        .unionByName(repeated(chunks, "chunk id repeated"))
        .unionByName(rows(orphans, "chunk without parent"))
        .unionByName(rows(wrong, "vector length"))
    )


def corpus_stats(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, parents, chunks."""
    left = parents.agg(F.countDistinct("title").alias("documents"), F.count("*").alias("parents"))
    return left.join(chunks.agg(F.count("*").alias("chunks")))


def document_names(parents: DataFrame) -> DataFrame:
    """Documents as ``(title, source_url, summary)``."""
    return parents.select("title", "source_url", "summary").distinct()


def indexed_titles(parents: DataFrame) -> DataFrame:
    return parents.select("title").distinct()
