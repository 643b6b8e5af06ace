"""Model stages as columns: pluggable batch functions and SQL stand-ins.

A model is a function from columns to a column. ``batch_model`` makes one from
a NumPy batch function; the stand-ins below are plain expressions, so that
tests and oracles can check the plumbing around a model exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.fixed_values import NO_SUMMARY
from belegwerk.functions.text import search_terms, trim_blanks
from belegwerk.functions.vectors import let

Model = Callable[..., Column]


def bisected(predict: Callable[[Sequence], Sequence], rows: Sequence) -> list:
    """Predictions of all rows; a failing batch is halved until only failing rows are null.

    One bad row among ``n`` costs about ``2 log2 n`` more calls, not ``n``. A batch with another
    number of predictions than rows has failed too.
    """
    try:
        out = list(predict(rows))
        if len(out) == len(rows):
            return out
    except Exception:
        pass
    if len(rows) < 2:
        return [None] * len(rows)
    half = len(rows) // 2
    return bisected(predict, rows[:half]) + bisected(predict, rows[half:])


def batch_model(
    make_predict: Callable[[], Callable[..., np.ndarray]], return_type: T.DataType,
    batch_size: int = 64,
) -> Model:
    """A model from a factory that runs once per Python worker.

    ``make_predict`` loads the model and returns a function of NumPy batches,
    one per input column.
    """
    return predict_batch_udf(make_predict, return_type=return_type, batch_size=batch_size)


def text_model(
    make_predict: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 16
) -> Model:
    """A text-to-text model whose failures become null rather than a lost task.

    Only rows that fail alone are null, for the caller to ``coalesce`` with a fallback.
    """
    return column_model(make_predict, "string", batch_size)


def column_model(
    make_predict: Callable[[], Callable[..., Sequence]], return_type: str, batch_size: int = 64
) -> Model:
    """A model of any columns, row tuples in and values out, with the same rule for failures.

    ``predict`` gets one list per column. Use it for scores or vectors of a model that
    may fail on some rows; a missing vector keeps a document out of the corpus, a
    missing score ranks last.
    """
    @F.pandas_udf(return_type)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        predict = make_predict()

        def rows(part: Sequence[tuple]) -> Sequence:
            return predict(*map(list, zip(*part)))

        for columns in batches:
            given = columns if isinstance(columns, tuple) else (columns,)  # one column comes bare
            values = list(zip(*(c.tolist() for c in given)))
            out = [x for lo in range(0, len(values), batch_size) for x in bisected(rows, values[lo:lo + batch_size])]
            yield pd.Series(out, dtype=object)

    return run


def lead_summary(text: Column) -> Column:
    """Stand-in summary: the first three sentences, or the whole text."""
    lead = trim_blanks(F.regexp_extract(text, r"^((?:[^.!?]*[.!?]+\s*){1,3})", 1))
    return F.when(lead == "", trim_blanks(text)).otherwise(lead)


def summarise(prompt_or_text: Column, model: Model, fallback: str = NO_SUMMARY) -> Column:
    """A model's trimmed summary, or a fixed text where it failed."""
    return F.coalesce(trim_blanks(model(prompt_or_text)), F.lit(fallback))


def term_share(question: Column, passage: Column) -> Column:
    """Stand-in reranker: share of distinct search terms found in the passage."""
    def share(pair: Column) -> Column:
        found = F.filter(pair["terms"], lambda t: F.contains(pair["text"], t))
        return F.size(found) / F.size(pair["terms"])

    terms = F.array_distinct(search_terms(question))
    return let(F.struct(terms.alias("terms"), F.lower(passage).alias("text")), share)
