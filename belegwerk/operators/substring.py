"""Any-of substring match: literal lists, and a table of terms against texts."""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from belegwerk.operators.question_block import QuestionBlock
from belegwerk.session import LIMITS, Limits, materialise, sized, top_k

ROWS_PER_BATCH = 1 << 16
LOT = 1 << 20  # characters that are searched together


def any_literal(text: Column, terms: Iterable[str], wildcards: bool = False) -> Column:
    """Case-insensitive match of any literal term.

    With ``wildcards`` the characters ``%`` and ``_`` inside a term match freely;
    a backslash is taken as itself.
    """
    if wildcards:
        tests = [text.ilike("%" + t.replace("\\", "\\\\") + "%") for t in terms]
    else:
        tests = [F.contains(F.lower(text), F.lower(F.lit(t))) for t in terms]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def any_term(text: Column, terms: Column, wildcards: bool = False) -> Column:
    """Case-insensitive match of any term of an array on the same row."""
    if wildcards:
        def like(t: Column) -> Column:
            plain = F.replace(F.lower(t), F.lit("\\"), F.lit("\\\\"))
            return F.like(F.lower(text), F.concat(F.lit("%"), plain, F.lit("%")))

        return F.exists(terms, like)
    low = F.lower(text)
    return F.exists(terms, lambda t: F.contains(low, F.lower(t)))


def any_marker(text: Column, markers: Iterable[str]) -> Column:
    """Case-sensitive match of any marker."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


class _Patterns:
    """Terms cut into literal pieces, which one automaton finds in a single pass over many texts.

    A term without wildcards is one piece. With them, ``%`` cuts a term into segments that
    follow each other with any gap, ``_`` stands for one character. A segment lies where its
    longest piece does and its other characters agree; the first fit of each segment
    leaves most to the rest. Single characters, which lie everywhere, are compared instead. ``words`` are distinct.
    """

    def __init__(self, words: list[str], wildcards: bool):
        self.terms = len(words)
        self.always = np.array([i for i, w in enumerate(words) if not w.strip("%" if wildcards else "")], np.int64)
        own: dict[str, int] = {}  # the term that is this piece
        self.wild: list[tuple[int, list[str]]] = []
        leads: set[str] = set()
        for i, w in enumerate(words):
            if not w.strip("%" if wildcards else ""):
                continue
            if not wildcards or not ("%" in w or "_" in w):
                own[w] = i
                continue
            segments = [s for s in w.split("%") if s]
            self.wild.append((i, segments))
            leads.update(max(s.split("_"), key=len) for s in segments)
        self.single = {piece: i for piece, i in own.items() if len(piece) == 1}
        pieces = sorted(piece for piece in leads | set(own) if len(piece) > 1)
        self.number = {piece: n for n, piece in enumerate(pieces)}
        self.length = np.array([len(piece) for piece in pieces], np.int64)
        self.own = np.array([own.get(piece, -1) for piece in pieces], np.int64)
        self.longest = max((len(w) for w in words), default=0)
        self.finder = ahocorasick.Automaton()
        for piece, n in self.number.items():
            self.finder.add_word(piece, n)
        if pieces:
            self.finder.make_automaton()

    def found(self, text: str) -> set[int]:
        """The terms that a lower-cased text holds."""
        return set(self.pairs([text])[1].tolist())

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and terms, sorted and each pair once, of the terms that lower-cased texts hold."""
        lot = _Lot(self, texts)
        rows, terms = [np.repeat(np.arange(len(texts)), len(self.always))], [np.tile(self.always, len(texts))]
        if len(self.number):
            literal = self.own[lot.piece]
            rows.append(lot.row[literal >= 0])
            terms.append(literal[literal >= 0])
        lone = [(i, np.unique(lot.of_piece(c)[0])) for c, i in self.single.items()]
        for i, held in [*lone, *((i, lot.follow(segments)) for i, segments in self.wild)]:
            rows.append(held)
            terms.append(np.full(len(held), i))
        pairs = np.unique(np.concatenate(rows) * self.terms + np.concatenate(terms))
        return np.divmod(pairs, max(self.terms, 1))


class _Lot:
    """Texts that are searched together, and where the pieces lie in them."""

    def __init__(self, patterns: _Patterns, texts: list[str]):
        self.patterns = patterns
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.wide = int(self.size.max(initial=0)) + patterns.longest + 2
        self.body = "\0".join(texts)
        self.known: dict[str, np.ndarray] = {}
        found = np.zeros(0, np.int64)
        if len(patterns.number):
            found = np.fromiter(itertools.chain.from_iterable(patterns.finder.iter(self.body)), np.int64)
        end, piece = found[0::2], found[1::2]
        row = np.searchsorted(self.start, end, "right") - 1
        begin = end - patterns.length[piece] + 1 - self.start[row]
        inside = (begin >= 0) & (end - self.start[row] < self.size[row])  # else it reaches into a neighbour
        order = np.flatnonzero(inside)[np.argsort(piece[inside], kind="stable")]
        self.piece, self.row, self.begin = piece[order], row[order], begin[order]
        self.cut = np.searchsorted(self.piece, np.arange(len(patterns.number) + 1))

    @functools.cached_property
    def chars(self) -> np.ndarray:
        return np.frombuffer(self.body.encode("utf-32-le"), np.uint32)

    def of_piece(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        """Row and begin of every place of a literal piece."""
        if len(piece) > 1:
            n = self.patterns.number[piece]
            own = slice(self.cut[n], self.cut[n + 1])
            return self.row[own], self.begin[own]
        at = np.flatnonzero(self.chars == ord(piece))
        row = np.searchsorted(self.start, at, "right") - 1
        begin = at - self.start[row]
        inside = begin < self.size[row]  # else it stands between texts
        return row[inside], begin[inside]

    def places(self, segment: str) -> np.ndarray:
        """``row * wide + begin`` of every place of a segment, in order."""
        if segment not in self.known:
            lead = max(segment.split("_"), key=len)
            gap = 0 if lead == segment else next(m.start() for m in re.finditer("[^_]+", segment) if m.group() == lead)
            row, begin = self.of_piece(lead)
            begin = begin - gap
            if lead != segment:
                fit = (begin >= 0) & (begin + len(segment) <= self.size[row])
                row, begin = row[fit], begin[fit]
                for k, c in enumerate(segment):
                    if c != "_" and not gap <= k < gap + len(lead):
                        same = self.chars[self.start[row] + begin + k] == ord(c)
                        row, begin = row[same], begin[same]
            self.known[segment] = row * self.wide + begin
        return self.known[segment]

    def follow(self, segments: list[str]) -> np.ndarray:
        """The rows whose text holds the segments one after the other."""
        row, at = np.arange(len(self.size)), np.zeros(len(self.size), np.int64)
        for segment in segments:
            if segment.strip("_"):
                places = self.places(segment)
                nth = np.searchsorted(places, row * self.wide + at)
                some = nth < len(places)
                row, place = row[some], places[nth[some]]
                here = place // self.wide == row
                row, at = row[here], place[here] % self.wide
            at = at + len(segment)
        return row[at <= self.size[row]]


def lots_of(texts: list[str], most: int = LOT) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of some ``most`` characters together, one text at least."""
    lo = size = 0
    for hi, text in enumerate(texts):
        if size and size + len(text) > most:
            yield lo, hi
            lo, size = hi, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


class _Matcher:
    """Finds the distinct terms of each row's lower-cased text, many texts in one pass.

    Without ``askers`` a row gains ``term_ids``, the numbers of its terms. With it, the places
    of each term's questions among ``qids``, a row becomes one row per question it answers, or gains the
    list of their ``qids``.
    """

    def __init__(self, terms, askers=None, qids: pa.Array | None = None, wildcards: bool = False, ids: np.ndarray | None = None):
        self.terms, self.askers, self.qids, self.wildcards, self.ids = terms, askers, qids, wildcards, ids

    def _find(self, batches: Iterator[pa.RecordBatch]):
        patterns = _Patterns(self.terms.value, self.wildcards)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            rest = batch.drop_columns(["__text"])
            for lo, hi in lots_of(texts):
                yield rest.slice(lo, hi - lo), *patterns.pairs(texts[lo:hi])

    def term_lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, terms in self._find(batches):
            yield batch.append_column("term_ids", _listed(rows, pa.array(self.ids[terms], pa.int64()), batch.num_rows))

    def _answered(self, batches: Iterator[pa.RecordBatch]):
        ends, who = self.askers.value
        count = np.diff(ends)
        for batch, rows, terms in self._find(batches):
            n = count[terms]
            at = np.arange(n.sum()) + np.repeat(ends[terms] - (np.cumsum(n) - n), n)
            hit = np.zeros((batch.num_rows, len(self.qids)), bool)
            hit[np.repeat(rows, n), who[at]] = True
            yield batch, *np.nonzero(hit)

    def question_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, who in self._answered(batches):
            for lo in range(0, len(at), ROWS_PER_BATCH):
                part = batch.take(pa.array(at[lo:lo + ROWS_PER_BATCH]))
                asked = self.qids.take(pa.array(who[lo:lo + ROWS_PER_BATCH]))
                yield pa.RecordBatch.from_arrays(
                    [asked] + part.columns, names=["qid"] + part.schema.names
                )

    def question_lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, who in self._answered(batches):
            lists = _listed(at, self.qids.take(pa.array(who)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([lists] + batch.columns, names=["qids"] + batch.schema.names)


def _listed(rows: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """One list a row, of the values that go with its number; ``rows`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _lowered(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.filter(F.col(text).isNotNull()).select(*keep, F.lower(text).alias("__text"))


class AskedTerms:
    """Distinct lower-cased terms of a table ``(qid, terms)``, and the questions that ask each."""

    def __init__(self, questions: DataFrame, limits: Limits = LIMITS):
        # Lower-casing happens in Spark, where the texts are lower-cased too.
        rows = questions.select("qid", F.explode("terms").alias("term")).select("qid", F.lower("term").alias("term"))
        rows = materialise(rows.filter("term is not null").distinct())
        self.limits = limits
        self.words = materialise(rows.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
        self.askers = sized(rows.join(self.words, "term").select("term_id", "qid"), limits)

    def lots(self) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Numbers and terms, as many at a time as may be broadcast."""
        size = self.words.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
        n = max(1, -(-size // self.limits.bytes))
        for k in range(n):
            lot = self.words.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k).toArrow()
            yield lot["term_id"].to_numpy(), lot["term"].to_pylist()


def term_hits(df: DataFrame, text: str, keep: list[str], terms: AskedTerms, wildcards: bool = False) -> DataFrame:
    """The ``keep`` columns plus ``term_ids``: which of the asked terms the text holds.

    Linear in the text however many terms there are. A row comes once for each lot of
    terms, of which there is one unless the terms are more than may be broadcast.
    """
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("term_ids", T.ArrayType(T.LongType()))]
    )
    sc = df.sparkSession.sparkContext
    parts = []
    for ids, words in terms.lots():
        matcher = _Matcher(sc.broadcast(words), wildcards=wildcards, ids=ids)
        parts.append(_lowered(df, text, keep).mapInArrow(matcher.term_lists, schema))
    return functools.reduce(DataFrame.unionByName, parts).filter(F.size("term_ids") > 0)


class _FirstPerTerm:
    """Keeps, per task, the ``k`` rows of every term that come first in an order.

    Rows carry ``term_ids`` and order columns; a row leaves the task once per
    term it is among the first for. Arrow batches are reduced as they come, so a
    task holds at most ``k`` rows per term however often a term occurs.
    """

    def __init__(self, k: int, order: list[str]):
        self.k, self.order = k, order

    def _reduce(self, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in self.order])
        return rows.take(pa.array(self._kept(rows["term_id"].to_numpy())))

    def _kept(self, term: np.ndarray) -> np.ndarray:
        """Positions of the first ``k`` occurrences of every term."""
        by_term = np.argsort(term, kind="stable")
        ordered = term[by_term]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        place = np.arange(len(ordered)) - np.repeat(start, np.diff(np.r_[start, len(ordered)]))
        return by_term[place < self.k]

    def _first(self, batch: pa.RecordBatch) -> pa.Table:
        batch = batch.sort_by([(c, "ascending") for c in self.order])
        lists = batch.column("term_ids")
        term = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        kept = self._kept(term)
        out = pa.Table.from_batches([batch.drop_columns(["term_ids"]).take(pa.array(row[kept]))])
        return out.append_column("term_id", pa.array(term[kept], pa.int64()))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = self._first(batch)
                best = rows if best is None else self._reduce(pa.concat_tables([best, rows]))
        if best is not None:
            yield from best.combine_chunks().to_batches()


def first_per_term(hits: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The first ``k`` rows of every term: the columns of ``hits`` with ``term_id``.

    ``hits`` has ``term_ids`` and otherwise only order columns. Tasks reduce to
    ``k`` rows per term before the shuffle, so a term that a third of all texts
    hold costs no more than any other.
    """
    schema = T.StructType(
        [f for f in hits.schema.fields if f.name != "term_ids"]
        + [T.StructField("term_id", T.LongType())]
    )
    local = hits.mapInArrow(_FirstPerTerm(k, order).__call__, schema)
    return top_k(local, k, ["term_id"], [F.asc(c) for c in order]).drop("rank")


def match_terms(
    questions: DataFrame, df: DataFrame, text: str, keep: list[str],
    terms: str = "terms", limits: Limits = LIMITS, wildcards: bool = False, listed: bool = False,
) -> DataFrame:
    """Rows ``(qid, *keep)`` whose text holds any term of the question.

    Terms match literally, but for case; with ``wildcards`` their ``%`` stands for any
    characters and ``_`` for one (a backslash is taken as itself).

    ``questions(qid, terms array<string>)``. The texts are read once and never shuffled
    while the questions are within the limits: a pair comes out once, by the questions of each
    term, which are broadcast. Beyond them the terms found are joined to who asks them. With ``listed`` the
    pairs of a row may come as ``(qids, *keep)``, its questions in one list, within the limits.
    """
    asked = questions.select("qid", F.transform(terms, F.lower).alias("terms"))
    size = F.sum(F.octet_length(F.array_join("terms", " ")))
    rows, total = asked.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if rows > limits.rows or total > limits.bytes:
        found = AskedTerms(asked, limits)
        hits = term_hits(df, text, keep, found, wildcards).select(*keep, F.explode("term_ids").alias("term_id"))
        return hits.join(found.askers, "term_id").select("qid", *keep).distinct()
    sc = df.sparkSession.sparkContext
    block = QuestionBlock(asked, limits)
    words, asking = block.askers
    qids = block.table["qid"].combine_chunks().unique()
    place = {q: i for i, q in enumerate(qids.to_pylist())}
    who = np.array([place[q] for some in asking for q in some], np.int64)
    ends = np.append(0, np.cumsum([len(some) for some in asking], dtype=np.int64))
    matcher = _Matcher(sc.broadcast(words), sc.broadcast((ends, who)), qids, wildcards)
    qid, kept = questions.schema["qid"], [df.schema[c] for c in keep]
    if listed:
        schema = T.StructType([T.StructField("qids", T.ArrayType(qid.dataType)), *kept])
        return _lowered(df, text, keep).mapInArrow(matcher.question_lists, schema)
    return _lowered(df, text, keep).mapInArrow(matcher.question_rows, T.StructType([qid, *kept]))


class _Extents:
    """Counts the pairs of a task per question, with the smallest and the largest key.

    A task holds one entry a question, and hands them on when they are more than ``most``.
    """

    def __init__(self, schema: pa.Schema, most: int = 1 << 17):
        self.schema, self.most = schema, most

    def _of_batch(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        qids, keys = batch.columns
        coded = keys.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        places = pa.array(place).take(coded.indices)
        if pa.types.is_list(qids.type):
            places, qids = places.take(pc.list_parent_indices(qids)), qids.flatten()
        rows = pa.table({"qid": qids, "place": places})
        found = rows.group_by("qid").aggregate([("place", "min"), ("place", "max"), ([], "count_all")])
        keys = coded.dictionary.take(pa.array(order))
        first, last = (keys.take(found[c].combine_chunks()).to_pylist() for c in ("place_min", "place_max"))
        return zip(found["qid"].to_pylist(), found["count_all"].to_pylist(), first, last)

    def _out(self, extents: dict) -> Iterator[pa.RecordBatch]:
        columns = [list(extents), *map(list, zip(*extents.values()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extents: dict = {}
        for batch in batches:
            for qid, n, first, last in self._of_batch(batch):
                m, low, high = extents.get(qid, (0, None, None))
                firsts, lasts = [k for k in (low, first) if k is not None], [k for k in (high, last) if k is not None]
                extents[qid] = m + n, min(firsts, default=None), max(lasts, default=None)
            if len(extents) > self.most:
                yield from self._out(extents)
                extents = {}
        if extents:
            yield from self._out(extents)


def extents_per_question(pairs: DataFrame, key: str) -> DataFrame:
    """``(qid, n, first, last)``: number of pairs ``(qid, <key>)`` and smallest and largest key, a string.

    The pairs of a key may also come as one row ``(qids, <key>)``. Spark sorts all rows for the smallest of strings; here a task passes over its pairs
    once and hands on a row a question, so no disk is taken however many pairs there are.
    """
    listed = "qids" in pairs.columns
    kind = pairs.schema["qids"].dataType.elementType if listed else pairs.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind)]).add("n", T.LongType()).add("first", T.StringType()).add("last", T.StringType())
    local = pairs.select("qids" if listed else "qid", key).mapInArrow(_Extents(to_arrow_schema(schema)).__call__, schema)
    return local.groupBy("qid").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
