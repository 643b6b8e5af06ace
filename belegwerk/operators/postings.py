"""Keyword index as a table of postings, full-text match and cover density."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.fixed_values import COVER_WEIGHT
from belegwerk.functions.text import Stemmer, german_stop_words, known_config, lexemes, tokens
from belegwerk.session import LIMITS, Limits, input_size, materialise, sized, top_k

ROWS_PER_BATCH = 1 << 14
STRETCH = 1 << 18  # tokens that are gathered together


class _Gather:
    """Gathers the positions of every lexeme of a text from the text's list of tokens.

    The postings leave in the order of the texts, a text's lexemes by their first place. A
    file then names each key once, in a run, and the positions of neighbours are near each other.
    """

    def __init__(self, key: str, stop: tuple[str, ...], stemmed: bool, stretch: int = STRETCH):
        self.key, self.stop, self.stemmed, self.stretch = key, stop, stemmed, stretch

    def _group(self, keys: pa.RecordBatch, lists: pa.ListArray, stemmer: Stemmer) -> pa.Table:
        row = pc.list_parent_indices(lists).to_numpy()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        pos = np.arange(1, len(row) + 1) - (np.cumsum(size) - size)[row]
        words = lists.flatten()
        kept = pc.invert(pc.is_in(words, pa.array(self.stop, pa.string())))
        words = words.filter(kept)
        rows = pa.table({
            "lexeme": stemmer.stem(words) if self.stemmed else words,
            "row": pa.array(row).filter(kept), "pos": pa.array(pos, pa.int32()).filter(kept),
            "at": np.flatnonzero(kept),
        })
        grouped = rows.group_by(["lexeme", "row"], use_threads=False).aggregate([("pos", "list"), ("at", "min")])
        grouped = grouped.take(np.argsort(grouped["at_min"].to_numpy()))
        own = [c.take(grouped["row"].combine_chunks()) for c in keys.columns]
        return pa.table([grouped["lexeme"], own[0], grouped["pos_list"], *own[1:]], ["lexeme", self.key, "positions", *keys.schema.names[1:]])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stemmer = Stemmer()
        for batch in batches:
            keys, lists = batch.select(batch.schema.names[:-1]), batch.column(batch.num_columns - 1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                fit = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.stretch, "right"))
                hi = max(lo + 1, fit)
                found = self._group(keys.slice(lo, hi - lo), lists[lo:hi], stemmer)
                yield from found.combine_chunks().to_batches(ROWS_PER_BATCH)
                lo = hi


def build_postings(
    df: DataFrame, text: str = "content", key: str = "id", config: str = "german", kept: tuple[str, ...] = ()
) -> DataFrame:
    """``(lexeme, <key>, positions[, <kept>])`` with sorted 1-based token positions.

    ``key`` is unique. The tokens of a text are one list, so they are
    gathered where they are, in Arrow batches; nothing is shuffled, and the postings come in
    the order of the texts.
    """
    schema = T.StructType([
        T.StructField("lexeme", T.StringType()), df.schema[key],
        T.StructField("positions", T.ArrayType(T.IntegerType())), *(df.schema[c] for c in kept),
    ])
    known_config(config)
    gather = _Gather(key, german_stop_words() if config != "simple" else (), config == "german")
    return df.select(key, *kept, tokens(F.col(text)).alias("tokens")).mapInArrow(gather.__call__, schema)


# One fold over the merged positions of all lexemes. It keeps, per lexeme, the
# last place seen; once all are seen, the earliest of them opens a cover that
# ends here. A cover counts only when its opening moved, so with its first end.
_COVER_DENSITY = """
aggregate(
  transform(
    array_sort(flatten(transform({positions}, (ps, lex) ->
      transform(ps, p -> named_struct('pos', p, 'lex', lex))))),
    (m, nth) -> named_struct('pos', m.pos, 'nth', nth, 'lex', m.lex)),
  named_struct(
    'last', transform({positions}, ps -> named_struct('pos', -1, 'nth', -1)),
    'opened', -1, 'score', 0.0D),
  (state, place) -> transform(array(
    transform(state.last, (v, lex) ->
      if(lex = place.lex, named_struct('pos', place.pos, 'nth', place.nth), v))),
    last -> transform(array(array_min(last)), first -> named_struct(
      'last', last,
      'opened', greatest(state.opened, first.pos),
      'score', state.score + if(first.pos > 0 and first.pos > state.opened,
         {weight}D / (1 + (place.pos - first.pos) - (place.nth - first.nth)), 0.0D)))[0])[0],
  state -> round(state.score, 9))
"""


def cover_density(positions: str, weight: float = COVER_WEIGHT) -> Column:
    """Cover density of ``array<array<int>>``: sorted positions per lexeme."""
    return F.expr(_COVER_DENSITY.format(positions=positions, weight=weight))


@dataclass(frozen=True)
class LexemeSets:
    """Distinct lexeme sets of questions, as rows, and the questions that ask each.

    Questions with the same lexemes have the same matches, so every set is ranked once.
    Questions without lexemes are in no set.
    """

    members: DataFrame  # (set_id, n, lexeme)
    askers: DataFrame  # (set_id, qid)


def lexeme_sets(questions: DataFrame, text: str, config: str, limits: Limits = LIMITS) -> LexemeSets:
    wanted = F.array_sort(F.collect_set("lexeme")).alias("wanted")
    asked = materialise(lexemes(questions, text, ["qid"], config).groupBy("qid").agg(wanted))
    sets = materialise(asked.select("wanted").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    members = sets.select("set_id", F.size("wanted").alias("n"), F.explode("wanted").alias("lexeme"))
    return LexemeSets(members, sized(asked.join(sets, "wanted").select("set_id", "qid"), limits))


def match_sets(
    sets: LexemeSets, postings: DataFrame, key: str, k: int | None, limits: Limits = LIMITS
) -> DataFrame:
    """Texts that hold all lexemes of a set: ``(qid, <key>, score)``.

    Candidates come from the rarest lexeme of every set; the other lexemes are
    looked up in the candidates' postings, the only ones that are shuffled, by ``key``. A lexeme
    that a third of all texts hold is therefore never expanded, and no join key is hot. The tables of the
    questions are written and broadcast where they are small; beyond that the same joins
    shuffle.
    """
    words = sets.members.select("lexeme").distinct()
    words = sized(words.withColumn("word", F.monotonically_increasing_id()), limits)
    needed = postings.join(words, "lexeme").select("lexeme", "word", key, "positions")
    counts = needed.groupBy("lexeme").agg(F.count(F.lit(1)).alias("texts"))
    rarest = sets.members.join(counts, "lexeme").groupBy("set_id", "n").agg(
        F.count(F.lit(1)).alias("found"), F.min_by("lexeme", F.struct("texts", "lexeme")).alias("lexeme")
    )
    rarest = sized(rarest.filter("found = n").select("set_id", "n", "lexeme"), limits)
    # A lone lexeme is its own cover at every place: weight times frequency.
    alone = needed.join(rarest.filter("n = 1"), "lexeme").select(
        "set_id", key, F.round(F.lit(COVER_WEIGHT) * F.size("positions"), 9).alias("score")
    )
    if k is not None:
        alone = top_k(alone, k, ["set_id"], [F.desc("score"), F.asc(key)]).drop("rank")
    several = rarest.filter("n > 1")
    members = sets.members.join(several.select("set_id"), "set_id", "left_semi").join(words, "lexeme")
    members = sized(members.groupBy("set_id", "n").agg(F.collect_list("word").alias("members")), limits)
    candidates = materialise(needed.select("lexeme", key).join(several.select("set_id", "lexeme"), "lexeme").select("set_id", key))
    texts = held_together(_of_candidates(needed, candidates, key, limits), key).repartition(key).groupBy(key).agg(
        F.collect_list(F.struct("words", "ends", "places")).alias("parts")
    ).select(key, F.expr(_HELD).alias("held"))
    asked = F.filter("held", lambda h: F.array_contains("members", h["word"]))
    hits = (
        candidates.join(texts, key).join(members, "set_id")
        .select("set_id", key, "n", F.transform(asked, lambda h: h["positions"]).alias("positions"))
        .filter(F.size("positions") == F.col("n"))
        .select("set_id", key, cover_density("positions").alias("score"))
    )
    if k is not None:
        hits = top_k(hits, k, ["set_id"], [F.desc("score"), F.asc(key)]).drop("rank")
    return hits.unionByName(alone).join(sets.askers, "set_id").select("qid", key, "score")


def held_together(postings: DataFrame, key: str) -> DataFrame:
    """``(<key>, words, ends, places)``: neighbouring postings ``(word, <key>, positions)`` of one text as one row.

    The positions of the ``n``-th word are the places up to ``ends[n]``. Stored postings
    lie by text, so a shuffle sends a key about once a text, and numbers besides.
    """
    schema = T.StructType([
        postings.schema[key], T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, positions = batch.column(0), batch.column(2)
            code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            cuts = np.append(starts, batch.num_rows)
            ends = np.append(0, np.cumsum(pc.list_value_length(positions).to_numpy()))
            own = ends[1:] - np.repeat(ends[starts], np.diff(cuts))
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(starts)),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(1)),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends[cuts], pa.int32()), positions.flatten()),
            ], [key, "words", "ends", "places"])

    return postings.select(key, "word", "positions").mapInArrow(run, schema)


# The words and positions of a text, from the rows of its postings.
_HELD = """
flatten(transform(parts, p -> transform(p.words, (w, n) -> named_struct('word', w, 'positions',
  if(n = 0, slice(p.places, 1, p.ends[0]), slice(p.places, p.ends[n - 1] + 1, p.ends[n] - p.ends[n - 1]))))))
"""


def _of_candidates(needed: DataFrame, candidates: DataFrame, key: str, limits: Limits) -> DataFrame:
    """Postings of the candidates, with some of other texts whose key has the same short hash.

    If even the hashes are more than may be broadcast, all postings stay.
    """
    near = materialise(candidates.select(F.hash(key).alias("near")).distinct())
    if 8 * input_size(near) > limits.bytes:
        return needed
    return needed.join(F.broadcast(near), F.hash(needed[key]) == near["near"], "left_semi")


def fts_rank(
    questions: DataFrame, postings: DataFrame, text: str, key: str = "id",
    config: str = "german", k: int | None = None, limits: Limits = LIMITS,
) -> DataFrame:
    """All-lexemes match with cover density: ``(qid, <key>, score)``.

    ``k`` keeps the best rows per question (score, then key). A question whose
    text has no lexeme matches nothing.
    """
    return match_sets(lexeme_sets(questions, text, config, limits), postings, key, k, limits)


def fts_match(
    questions: DataFrame, postings: DataFrame, text: str, key: str = "id",
    config: str = "german", limits: Limits = LIMITS,
) -> DataFrame:
    """Pairs ``(qid, <key>)`` whose text holds every lexeme of the question."""
    return fts_rank(questions, postings, text, key, config, None, limits).drop("score")
