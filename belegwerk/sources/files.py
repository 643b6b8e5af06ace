"""Folders of files as documents, and the selection of new ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.fixed_values import SUPPORTED_EXTENSIONS
from belegwerk.functions.markup import page_markdown
from belegwerk.functions.urls import extension, file_name, is_supported

TEXT_EXTENSIONS = (".md", ".txt", ".asc")


def list_sources(
    spark: SparkSession, folder: str, extensions: Iterable[str] = SUPPORTED_EXTENSIONS
) -> DataFrame:
    """Supported files of one flat folder: ``(filename, path, length, content)``.

    The extension test ignores case, which a glob would not. ``content`` is read
    only when something asks for it.
    """
    files = spark.read.format("binaryFile").load(folder)
    return supported_files(files, extensions)


def stream_sources(
    spark: SparkSession, folder: str, extensions: Iterable[str] = SUPPORTED_EXTENSIONS
) -> DataFrame:
    """The same as a stream of files that arrive."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return supported_files(files, extensions)


def supported_files(files: DataFrame, extensions: Iterable[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    return files.filter(is_supported(F.col("path"), extensions)).select(
        file_name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
        .alias("filename"), "path", "length", "content",
    )


def document_text(name: Column, content: Column) -> Column:
    """Text of a file; null where its format needs a converter of its own."""
    text = F.try_validate_utf8(content.cast("string"))
    kind = extension(name)
    return F.when(kind == ".html", page_markdown(text)).when(kind.isin(*TEXT_EXTENSIONS), text)


def read_documents(files: DataFrame) -> DataFrame:
    """``(title, text)`` of listed files."""
    return files.select(
        F.col("filename").alias("title"),
        document_text(F.col("filename"), F.col("content")).alias("text"),
    )


def new_sources(sources: DataFrame, parents: DataFrame, name: str = "filename") -> DataFrame:
    """Sources whose name is not yet a title; changed content does not count."""
    known = parents.select(F.col("title").alias(name)).distinct()
    return sources.join(known, name, "left_anti")
