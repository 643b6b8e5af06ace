"""Documents to a two-level corpus: parents and embedded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.fixed_values import DEFAULT_FILE_BASE_URL, SUMMARY_INPUT_CHARS
from belegwerk.functions.prompts import summary_prompt
from belegwerk.functions.text import document_key
from belegwerk.functions.vectors import hashed_embedding
from belegwerk.operators.chunking import split_children, split_parents
from belegwerk.operators.models import Model, lead_summary, summarise


def prepare_documents(
    docs: DataFrame, base_url: str = DEFAULT_FILE_BASE_URL, summary_model: Model = lead_summary,
    summary_template: str | None = None, summary_chars: int | None = SUMMARY_INPUT_CHARS,
) -> DataFrame:
    """``(title, text)`` plus ``source_url`` and ``summary``, once per document.

    With ``summary_template`` the model gets the prompt around the first ``summary_chars``
    characters (None: all), else the text.
    """
    text = F.col("text")
    asked = text if summary_template is None else summary_prompt(text, summary_template, summary_chars)
    return docs.select(
        "title", "text",
        F.concat(F.lit(base_url), F.col("title")).alias("source_url"),
        summarise(asked, summary_model).alias("summary"),
    )


def build_parents(
    docs: DataFrame, method: str = "recursive", base_url: str = DEFAULT_FILE_BASE_URL,
    summary_model: Model = lead_summary, summary_template: str | None = None,
) -> DataFrame:
    return split_parents(prepare_documents(docs, base_url, summary_model, summary_template), method)


def build_chunks(
    parents: DataFrame, method: str = "recursive", embedding_model: Model = hashed_embedding,
) -> DataFrame:
    """Chunks with their vector on the same row; no positional zip, no join."""
    return split_children(parents.withColumn("document", document_key()), method).withColumn(
        "embedding", embedding_model(F.col("content"))
    )


def build_corpus(
    docs: DataFrame, method: str = "recursive", base_url: str = DEFAULT_FILE_BASE_URL,
    summary_model: Model = lead_summary, embedding_model: Model = hashed_embedding,
    summary_template: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lazy ``(parents, chunks)`` of documents ``(title, text)``.

    Every step is narrow: one row in, its parts out, on the same executor.
    """
    parents = build_parents(docs, method, base_url, summary_model, summary_template)
    return parents, build_chunks(parents, method, embedding_model)
