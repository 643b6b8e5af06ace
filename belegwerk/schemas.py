"""Table schemas of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source_url", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("parent_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("document", T.StringType()),
])

ERRORS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("failed_at", T.TimestampType()),
])

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select a table's columns in order; absent ones get their default.

    ``created_at`` and ``failed_at`` default to now, everything else to null.
    """
    def column(field: T.StructField):
        if field.name in df.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.current_timestamp().alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
