"""Toxic spans by a linear-chain conditional random field over the words of a sentence.

Labels come per document, so tokens are labelled first: a word or word beginning
is telling when it is much more frequent, by documents, in toxic than in clean
labelled texts, and the telling words of toxic texts are the toxic tokens. The
field is trained on sentences of a bounded sample; forward-backward marginals of
every word of every text give the spans and, aggregated, the document's score.

Defined results: a null or empty text has no span and the score of a text without
any toxic word; repeated rows each get the same score; an empty table gives an
empty one; without both classes among the learnable labels, or without a word that
tells them apart, no word and no text is toxic.
Only the named columns are read; labels never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.arrow_text import LOWER, slices, words
from belegwerk.llm.hashing import RunHash, mix
from belegwerk.llm.labelled import fresh, held_out, logistic, training_sample, with_text_column
from belegwerk.session import materialise, small_batches

BITS = 18
PREFIXES = (3, 4, 5)
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?\n")] = True


@dataclass
class Tokens:
    """The words of a slice: byte runs, text rows, chains and feature hashes."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of the first word of each chain
    own: np.ndarray  # (words, 1 + prefixes) hashes of the word and its beginnings
    features: np.ndarray  # (words, n) indices into the weights


def tokenize(body: np.ndarray, at: np.ndarray) -> Tokens:
    """Words (letters and digits), cut into chains at sentence ends and text ends."""
    body = LOWER[body]
    starts, ends, row = words(body, at, WORD_BYTES)
    n = len(starts)
    stops = np.zeros(len(body) + 1, np.int64)
    np.cumsum(SENTENCE_END[body], out=stops[1:])
    opens = np.ones(n, bool)
    if n:
        opens[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    run = RunHash(body)
    word = run.of(starts, ends)
    own = np.stack([word, *(mix(run.of(starts, np.minimum(starts + k, ends)) + np.uint64(k)) for k in PREFIXES)], 1)
    tail = mix(run.of(np.maximum(ends - 3, starts), ends) + np.uint64(77))
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:] = np.where(opens[1:], np.uint64(0), word[:-1])
    after[:-1] = np.where(opens[1:], np.uint64(0), word[1:])
    all_ = np.concatenate([own, np.stack([
        tail, mix(before + np.uint64(1001)), mix(after + np.uint64(2002))], 1)], 1)
    return Tokens(starts, ends, row, np.flatnonzero(opens), own, (all_ >> np.uint64(64 - BITS)).astype(np.int32))


class Chains:
    """Chains of any lengths, walked step by step all at once."""

    def __init__(self, first: np.ndarray, total: int):
        length = np.diff(np.append(first, total))
        order = np.argsort(-length, kind="stable")
        self.first, self.length, self.total = first[order], length[order], total
        self.most = int(self.length[0]) if len(length) else 0
        steps = np.arange(self.most)
        self.active = np.searchsorted(-self.length, -steps, "left")  # chains longer than each step

    def at(self, step: int) -> np.ndarray:
        return self.first[:self.active[step]] + step


@dataclass
class Field:
    """Weights of the toxic state's features and of moves between the states."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0

    def odds(self, features: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward odds of the toxic state, and each word's own."""
        local = np.exp(np.clip(self.weights[features].sum(1), -25, 25))
        (stay, enter), (leave, remain) = np.exp(np.clip(self.moves, -10, 10))
        ahead, back = np.ones(chains.total), np.ones(chains.total)
        for step in range(chains.most):
            i = chains.at(step)
            if step == 0:
                ahead[i] = local[i] * np.exp(self.start)
            else:
                p = ahead[i - 1]
                ahead[i] = local[i] * (enter + remain * p) / (stay + leave * p)
        for step in range(chains.most - 2, -1, -1):
            i = chains.at(step + 1)
            q = local[i] * back[i]
            back[i - 1] = (leave + remain * q) / (stay + enter * q)
        return ahead, back, local

    def marginals(self, features: np.ndarray, chains: Chains) -> np.ndarray:
        ahead, back, _ = self.odds(features, chains)
        odds = np.minimum(ahead * back, 1e12)
        return odds / (1 + odds)


def train(features: np.ndarray, tags: np.ndarray, first: np.ndarray, rounds: int = 40,
          rate: float = 0.5, ridge: float = 1e-6) -> Field:
    """Maximum likelihood by full-batch AdaGrad on tagged chains."""
    model = Field()
    n = len(tags)
    if not n or not tags.any():
        model.start = -12.0
        model.moves[:, 1] = -12.0
        return model
    chains = Chains(first, n)
    inner = np.ones(n, bool)
    inner[first] = False
    right = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[right - 1], tags[right]), 1)
    at_start = tags[first].sum()
    flat, width = features.ravel(), features.shape[1]
    past, past_moves, past_start = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(rounds):
        ahead, back, local = model.odds(features, chains)
        odds = np.minimum(ahead * back, 1e12)
        p = odds / (1 + odds)
        gradient = np.bincount(flat, np.repeat(p - tags, width), 1 << BITS) / n + ridge * model.weights
        both = np.stack([np.ones(len(right)), ahead[right - 1]], 1)[:, :, None] * np.exp(model.moves)[None]
        both = both * np.stack([np.ones(len(right)), local[right] * back[right]], 1)[:, None, :]
        expected = (both / both.sum((1, 2), keepdims=True)).sum(0)
        moves = (expected - seen) / n + ridge * model.moves
        start = (p[first].sum() - at_start) / n
        past += gradient ** 2
        past_moves += moves ** 2
        past_start += start ** 2
        model.weights -= rate * gradient / np.sqrt(past)
        model.moves -= rate * moves / np.sqrt(past_moves)
        model.start -= rate * start / np.sqrt(past_start)
    return model


def aggregate(highest: np.ndarray, expected: np.ndarray) -> np.ndarray:
    p = np.clip(highest, 1e-5, 1 - 1e-5)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p)), np.log1p(expected)], 1)


def surprise(toxic: Column, clean: Column, share: float) -> Column:
    """Log-likelihood ratio of the counts against chance, with ``share`` of the texts toxic."""
    n = toxic + clean

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(F.lit(0.0))

    return 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))


def telling(sample: DataFrame, ratio: float = 20.0, least: int = 3, chance: float = 18.0) -> np.ndarray:
    """Hashes of words and beginnings that toxic texts of the sample have much more often.

    Their share of the toxic texts is at least ``ratio`` times that of the clean ones,
    and the log-likelihood ratio is at least ``chance``: so words that a small
    sample has in a few toxic texts by chance are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, body, at in slices(batch.column(0)):
                t = tokenize(body, at)
                pairs = np.stack([np.repeat(t.row, t.own.shape[1]).astype(np.uint64), t.own.ravel()], 1)
                if not len(pairs):
                    continue
                pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
                new = np.ones(len(pairs), bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(1)
                pairs = pairs[new]
                toxic = labels[lo + pairs[:, 0].astype(np.int64)]
                first = np.flatnonzero(np.append(True, pairs[1:, 1] != pairs[:-1, 1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(pairs[first, 1].view(np.int64)), pa.array(np.add.reduceat(toxic, first).astype(np.int64)),
                    pa.array(np.add.reduceat(1 - toxic, first).astype(np.int64)),
                ], ["h", "toxic", "clean"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.uint64)
    counts = sample.select("text", "label").mapInArrow(run, "h long, toxic long, clean long").groupBy("h").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    found = counts.filter(
        (F.col("toxic") >= least)
        & (F.col("toxic") / sizes[1] >= ratio * (F.col("clean") + 1) / sizes[0])
        & (surprise(F.col("toxic"), F.col("clean"), sizes[1] / (sizes[0] + sizes[1])) >= chance)
    ).select("h").toArrow()
    return np.sort(np.asarray(found.column(0).to_numpy()).astype(np.int64).view(np.uint64))


def sentences(sample: DataFrame, known: np.ndarray, most: int = 40_000, longest: int = 64) -> tuple[np.ndarray, ...]:
    """Tagged training chains: features, tags and first words of at most ``most`` sentences.

    Half of them have a toxic token. They are drawn by text and sentence, so a sentence
    that many texts share is drawn as often as it occurs; of a longer sentence the
    stretch around its first toxic token is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            draw = batch.column(2).to_numpy().view(np.uint64)
            for lo, _, body, at in slices(batch.column(0)):
                t = tokenize(body, at)
                tags = np.isin(t.own, known).any(1) & (labels[lo + t.row] == 1) if len(known) else np.zeros(len(t.row), bool)
                ends = np.append(t.first, len(t.row))[1:]
                rows = []
                for a, b in zip(t.first.tolist(), ends.tolist()):
                    toxic = np.flatnonzero(tags[a:b])
                    order = int(mix(t.own[a:b, 0].sum(keepdims=True) ^ draw[lo + t.row[a]])[0] >> np.uint64(1))
                    if b - a > longest:
                        a = max(a, a + (int(toxic[0]) if len(toxic) else 0) - longest // 2)
                        b = min(b, a + longest)
                    rows.append((bool(len(toxic)), order, t.features[a:b].tobytes(), tags[a:b].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.bool_(), pa.int64(), pa.binary(), pa.binary()))],
                        ["toxic", "h", "features", "tags"],
                    )

    found = sample.select("text", "label", F.xxhash64("doc_id")).mapInArrow(run, "toxic boolean, h long, features binary, tags binary")
    halves = [
        found.filter(F.col("toxic") == side).orderBy("h", "features").limit(most // 2).toArrow() for side in (True, False)
    ]
    tags = [np.frombuffer(b, bool) for half in halves for b in half.column("tags").to_pylist()]
    data = b"".join(b for half in halves for b in half.column("features").to_pylist())
    width = len(PREFIXES) + 4
    first = np.cumsum([0, *map(len, tags)])[:-1]
    flat = np.concatenate(tags).astype(np.int64) if tags else np.zeros(0, np.int64)
    return np.frombuffer(data, np.int32).reshape(-1, width), flat, first.astype(np.int64)


TAGS = "struct<highest:double,expected:double,spans:array<struct<begin:long,end:long>>>"


def tag(docs: DataFrame, model: Field, name: str = "tags", text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``highest``, ``expected`` and ``spans`` of every whole text.

    ``spans`` are the offending stretches as code point offsets: neighbouring
    words with a marginal of at least ``least``. ``highest`` is the largest
    marginal, ``expected`` the sum of those of at least ``least``.
    """
    packed = model.weights.astype(np.float32)
    own = Field(packed, model.moves, model.start)

    def one(body: np.ndarray, at: np.ndarray) -> pa.StructArray:
        t, n = tokenize(body, at), len(at) - 1
        p = own.marginals(t.features, Chains(t.first, len(t.row)))
        highest = np.zeros(n)
        np.maximum.at(highest, t.row, p)
        hit = np.flatnonzero(p >= least)
        expected = np.bincount(t.row[hit], p[hit], n)
        points = np.zeros(len(body) + 1, np.int64)
        np.cumsum((body & 0xC0) != 0x80, out=points[1:])
        opens = np.ones(len(hit), bool)
        opens[1:] = (hit[1:] != hit[:-1] + 1) | (t.row[hit[1:]] != t.row[hit[:-1]])
        from_ = np.flatnonzero(opens)
        to = np.append(from_, len(hit))[1:] - 1
        row = t.row[hit[from_]]
        begin = points[t.starts[hit[from_]]] - points[at[row]]
        end = points[t.ends[hit[to]]] - points[at[row]]
        bounds = np.searchsorted(row, np.arange(n + 1))
        spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
        return pa.StructArray.from_arrays(
            [pa.array(highest), pa.array(expected, pa.float64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)],
            ["highest", "expected", "spans"],
        )

    def work(texts: pa.Array) -> pa.Array:
        parts = [one(body, at) for _, _, body, at in slices(texts)]
        return pa.concat_arrays(parts) if parts else one(np.zeros(0, np.uint8), np.zeros(1, np.int64))

    return with_text_column(docs, name, TAGS, work, text)


@dataclass(frozen=True)
class Detector:
    """A trained field and the rule from a document's marginals to its score."""

    field: Field
    rule: tuple[float, float, float]

    def score(self, docs: DataFrame, name: str = "_toxic") -> DataFrame:
        """``docs`` with a struct of the score and the spans of every whole text.

        The score is the logistic function of the highest marginal's log odds and
        the log of the expected number of toxic words.
        """
        constant, by_odds, by_count = self.rule
        tags = fresh(docs, "_tags")
        p = F.least(F.greatest(F.col(tags)["highest"], F.lit(1e-5)), F.lit(1 - 1e-5))
        z = constant + by_odds * F.log(p / (1 - p)) + by_count * F.log1p(F.col(tags)["expected"])
        return tag(docs, self.field, tags).withColumn(
            name, F.struct((1 / (1 + F.exp(-z))).alias("score"), F.col(tags)["spans"].alias("spans"))
        ).drop(tags)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> Detector:
    """Train on at most ``per_class`` learnable documents of each class.

    The field uses 40,000 of their sentences, the rule their marginals.
    """
    small_batches(docs.sparkSession)
    chosen = training_sample(labels, "toxic", per_class)
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    known = telling(sample)
    model = train(*sentences(sample, known))
    seen = tag(sample, model, "t").select("doc_id", "label", "t.highest", "t.expected").toPandas()
    seen = seen.drop_duplicates("doc_id").sort_values("doc_id")
    y = seen["label"].to_numpy(float)
    if len(np.unique(y)) < 2 or not len(known):
        return Detector(model, (-6.0, 1.0, 0.0))
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    share = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    x = aggregate(seen["highest"].to_numpy(), seen["expected"].to_numpy())
    return Detector(model, tuple(logistic(x, y, 1e-4, weight=weight).tolist()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 6000) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` of every document."""
    docs = docs.select("doc_id", "text")
    return learn(docs, labels, per_class).score(docs).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_toxic.score").alias("score"),
        (F.col("_toxic.score") >= threshold).cast("int").alias("predicted"), F.col("_toxic.spans").alias("spans"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 6000) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, unchanged."""
    name = fresh(docs, "_toxic")
    scored = learn(docs, labels, per_class).score(docs, name)
    return scored.filter(F.col(name)["score"] < threshold).drop(name)
