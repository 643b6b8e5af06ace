"""Token counts of sections or fields, by the spans of tokens of whole documents.

A document is encoded once; every token covers a run of its bytes. ``section_counts``
takes the lines of a document as its sections, each with its line feed; a token that
crosses a boundary counts for the line in which it begins, so counts add up to the
document's. ``attributed_counts`` joins tokens to any stretches of the texts that a
table names, by one of three rules for tokens that cross a boundary.

Defined results: a null or empty text has no line; repeated rows are counted each
for itself; a null key stays null, and joins with no stretch; an empty table gives an
empty one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.arrow_text import slices
from belegwerk.llm.packing import piece_encoder


def section_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, section, start, n_bytes, n_tokens)``, one row for each section from 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = piece_encoder(path)
            token_bytes = np.array(own.size)
            for lo, hi, body, at in slices(batch.column(1)):
                ids, _ = own.encode(batch.column(1).slice(lo, hi - lo))
                size = token_bytes[ids]
                token = np.cumsum(size) - size  # first byte: tokens tile the texts
                starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], np.flatnonzero(body == 0x0A) + 1]))
                starts = starts[starts < len(body)]
                counts = np.diff(np.append(np.searchsorted(token, starts), len(token)))
                row = np.searchsorted(at, starts, "right") - 1
                first = np.searchsorted(row, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                    pa.array((np.arange(len(row)) - first[row]).astype(np.int32)), pa.array(starts - at[row]),
                    pa.array(np.diff(np.append(starts, len(body)))), pa.array(counts),
                ], ["key", "section", "start", "n_bytes", "n_tokens"])

    schema = f"key {kind}, section int, start long, n_bytes long, n_tokens long"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


RULES = ("begin", "majority", "each")


def attributed(start: np.ndarray, end: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str) -> np.ndarray:
    """How many of the tokens ``[start, end)``, which tile a text, each stretch ``[begin, stop)`` gets."""
    first = np.searchsorted(end, begin, "right")  # the first token that ends after the stretch begins
    last = np.searchsorted(start, stop, "left")  # the first one that begins at or after its end
    count = np.maximum(last - first, 0)
    if rule == "each":
        return np.where(begin < stop, count, 0)
    if rule == "begin":
        return np.where(begin < stop, last - np.searchsorted(start, begin, "left"), 0)
    out = np.where(begin < stop, count, 0)
    # Only a stretch's first and last token can lie partly outside.
    for token, once in ((first, np.ones(len(out), bool)), (last - 1, last - 1 > first)):
        some = np.flatnonzero((out > 0) & once)
        t = token[some]
        inside = np.minimum(end[t], stop[some]) - np.maximum(start[t], begin[some])
        size = end[t] - start[t]
        own = (2 * inside > size) | ((2 * inside == size) & (start[t] >= begin[some]))
        out[some] -= ~own
    return out


def attributed_counts(
    docs: DataFrame, stretches: DataFrame, path: str, rule: str = "begin", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, section, begin, end, n_tokens)`` of every stretch of a document that is there.

    ``stretches(key, section, begin, end)`` are code points ``[begin, end)`` of the texts: fields,
    sections, spans of any kind, which may overlap or leave gaps; beyond the text they
    are cut off, and one that is empty, turned or null has no tokens. A token counts, by
    ``begin``, where its first byte lies; by ``majority``, where more than half of its bytes lie, or
    half and the first of them; by ``each``, wherever any byte lies. The first two give a token to
    at most one of several stretches that do not overlap.
    """
    if rule not in RULES:
        raise ValueError(f"no rule {rule}: {RULES}")
    kinds = [stretches.schema[c].dataType.simpleString() for c in ("section", "begin", "end")]
    listed = F.array_sort(F.collect_list(F.struct("begin", "end", "section")))
    own = stretches.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(listed.alias("spans"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(own, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = piece_encoder(path)
            token_bytes = np.array(coder.size)
            for lo, hi, body, at in slices(batch.column(1)):
                ids, _ = coder.encode(batch.column(1).slice(lo, hi - lo))
                size = token_bytes[ids]
                end = np.cumsum(size)
                spans = batch.column(2).slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), pc.list_value_length(spans).to_numpy())
                inner = spans.flatten()
                parts = {c: inner.field(c) for c in ("begin", "end", "section")}
                letters = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))  # where each character begins
                base = np.searchsorted(letters, at)
                edges = []
                for c in ("begin", "end"):
                    place = np.maximum(parts[c].cast(pa.int64()).fill_null(0).to_numpy(), 0)
                    edges.append(letters[np.minimum(base[row] + place, base[row + 1])])
                begin, stop = edges
                blank = ~(parts["begin"].is_valid().to_numpy(zero_copy_only=False) & parts["end"].is_valid().to_numpy(zero_copy_only=False))
                count = attributed(end - size, end, begin, np.where(blank, begin, stop), rule)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(row)), parts["section"], parts["begin"], parts["end"], pa.array(count),
                ], ["key", "section", "begin", "end", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, section {kinds[0]}, begin {kinds[1]}, end {kinds[2]}, n_tokens long"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
