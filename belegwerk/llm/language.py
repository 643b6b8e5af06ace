"""Languages of mixed texts: scripts narrow the candidates, Viterbi labels the words.

1. Learnable documents give, for each language, counts of hashed features of their
   words (the word, its beginning and end, and runs of two and three characters), and
   the scripts that the language is written in.
2. A word can only be of the languages of its script; its score in each is the log
   likelihood of its features, as far as it lies below the best one.
3. Viterbi finds the labelling of a text's words of the largest total, where each
   change of language costs ``penalty``. Neighbouring words of one label are a span.
   The language of a text is the one of most letters, the score their share.

Long texts are exact too: blocks of words are summed up as tables from the label before
the block to the label at its end, these are joined, and then every block is walked
from its known start. So no walk is longer than a block, whatever the text.

Defined results: a text that is null or has no letter has no span, ``und`` and score 0,
as has every text where nothing was learned. Letters of a script that no learned
language uses favour none. Of equal totals the language first by name wins. Repeated
rows each get the same result, an empty table an empty one. Languages of documents
without id are not learned from. Only the named columns are read; labels, sources and
ids never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.arrow_text import slices
from belegwerk.llm.hashing import RunHash, mix
from belegwerk.llm.labelled import held_out
from belegwerk.llm.scripts import SCRIPTS, Words, words_of
from belegwerk.session import materialise, top_k

BITS = 16  # hashed features of each language
BLOCK = 512  # words that one walk takes
SLICE = 1 << 19  # bytes of text at once: a code point costs about fifty of arrays
UNKNOWN = "und"


def features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of chosen words, and the place of their word in ``which``."""
    starts, ends = words.starts[which], words.ends[which]
    run = RunHash(words.points)
    size = ends - starts
    word = np.arange(len(which))
    parts = [
        (run.of(starts, ends), 1, word),
        (run.of(starts, np.minimum(starts + 2, ends)), 2, word),
        (run.of(np.maximum(ends - 2, starts), ends), 3, word),
        (run.of(starts, np.minimum(starts + 3, ends)), 4, word),
        (run.of(np.maximum(ends - 3, starts), ends), 5, word),
    ]
    for n in (2, 3):
        each = np.maximum(size - n + 1, 0)
        owner = np.repeat(word, each)
        begin = np.repeat(starts, each) + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        parts.append((run.of(begin, begin + n), 5 + n, owner))
    codes = np.concatenate([mix(h ^ np.uint64(kind << 32)) >> np.uint64(64 - BITS) for h, kind, _ in parts])
    return codes.astype(np.int64), np.concatenate([owner for _, _, owner in parts])


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of every different word, and which of them each word is."""
    code = RunHash(words.points).of(words.starts, words.ends)
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return first, which


def feature_counts(sample: DataFrame) -> DataFrame:
    """``(lang, code, n)`` over the words of ``(lang, text)``; scripts have codes from -1 down, in letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            own = langs.indices.to_numpy()
            total = {}
            for lo, _, body, at in slices(batch.column(1), SLICE):
                words = words_of(body, at)
                if not len(words.starts):
                    continue
                first, which = distinct(words)
                code, place = features(words, first)
                kind = own[lo + words.row]
                for k in np.unique(kind).tolist():
                    mine = kind == k
                    times = np.bincount(which[mine], minlength=len(first))
                    counts = np.bincount(code, times[place], 1 << BITS)
                    letters = np.bincount(words.script[mine], words.letters[mine], len(SCRIPTS))
                    had = total.get(k, (0, 0))
                    total[k] = had[0] + counts, had[1] + letters
            for k, (counts, letters) in total.items():
                codes, scripts = np.flatnonzero(counts), np.flatnonzero(letters)
                n = len(codes) + len(scripts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([langs.dictionary[k].as_py()] * n, pa.string()), pa.array(np.append(codes, -1 - scripts)),
                    pa.array(np.append(counts[codes], letters[scripts]).astype(np.int64)),
                ], ["lang", "code", "n"])

    found = sample.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Learned languages in order, log likelihoods by feature, and their scripts."""

    languages: list[str]
    table: np.ndarray  # (features, languages), float32
    scripts: np.ndarray  # (scripts, languages), bool

    def scores(self, words: Words) -> np.ndarray:
        """``(words, languages)``: how far each language lies below the best one, at most ``worst``."""
        n = len(self.languages)
        first, which = distinct(words)
        code, place = features(words, first)
        raw = np.empty((len(first), n), np.float32)
        for k in range(n):
            raw[:, k] = np.bincount(place, self.table[code, k], len(first))
        open_ = self.scripts[words.script[first]]
        open_ = open_ | ~open_.any(1, keepdims=True)
        raw[~self.scripts[words.script[first]].any(1)] = 0
        raw = np.where(open_, raw, -np.inf)
        raw -= raw.max(1, keepdims=True)
        return np.maximum(raw, np.float32(-100))[which]


def learn(docs: DataFrame, per_language: int = 2000, smooth: float = 0.5, least_share: float = 0.01) -> Model:
    """Count features of at most ``per_language`` learnable documents of each language.

    They are drawn by a hash of the id. A language is written in the scripts of at
    least ``least_share`` of its letters.
    """
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")
    )
    keys = usable.select("doc_id", "lang").distinct()
    drawn = top_k(keys, per_language, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")])
    # Written, so that Spark knows the size of the keys and moves the texts only if there are very many.
    drawn = materialise(drawn.select("doc_id", "lang"))
    sample = materialise(usable.join(drawn, ["doc_id", "lang"], "left_semi"))
    found = feature_counts(sample).toArrow()  # languages times features
    names = sorted(set(found.column("lang").to_pylist()))
    own = np.searchsorted(np.array(names, object), found.column("lang").to_pylist()) if names else np.zeros(0, np.int64)
    code, n = (found.column(c).to_numpy() for c in ("code", "n"))
    counts, letters = np.zeros((1 << BITS, len(names))), np.zeros((len(SCRIPTS), len(names)))
    counts[code[code >= 0], own[code >= 0]] = n[code >= 0]
    letters[-1 - code[code < 0], own[code < 0]] = n[code < 0]
    total = counts.sum(0) + smooth * len(counts)
    share = letters / np.maximum(letters.sum(0), 1)
    return Model(names, np.log((counts + smooth) / total).astype(np.float32), share >= least_share)


def walk(scores: np.ndarray, first: np.ndarray, size: np.ndarray, value: np.ndarray, penalty: float,
         back: np.ndarray | None = None) -> np.ndarray:
    """Best totals at the end of every chain, all chains a step at a time.

    ``value`` holds the best totals before each chain's first word, changes included.
    ``back`` gets, for each word and label, the label before it.
    """
    order = np.argsort(-size, kind="stable")
    first, size, value = first[order], size[order], value[order]
    labels = np.arange(scores.shape[1])
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        at = first[:live] + step
        own = value[:live]
        if step:
            best = own.argmax(-1)
            change = np.take_along_axis(own, best[..., None], -1) - penalty
            moved = change > own
            if back is not None:
                back[at] = np.where(moved, best[..., None], labels)
            own = np.where(moved, change, own)
        value[:live] = own + (scores[at] if own.ndim == 2 else scores[at][:, None])
    out = np.empty_like(value)
    out[order] = value
    return out


def switched(value: np.ndarray, penalty: float) -> np.ndarray:
    """Best totals before the next word, for each label it may have."""
    return np.maximum(value, value.max(-1, keepdims=True) - penalty)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, block: int = BLOCK) -> np.ndarray:
    """The label of every word; ``first`` holds the first word of each text."""
    total, n = scores.shape
    if not total:
        return np.zeros(0, np.int64)
    scores = scores.astype(np.float64)
    size = np.diff(np.append(first, total))
    blocks = -(-size // block)
    text = np.repeat(np.arange(len(first)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[text] + number * block
    length = np.minimum(size[text] - number * block, block)
    value = np.zeros((len(text), n))  # before each block
    later = np.flatnonzero(number > 0)
    feeds = np.flatnonzero(np.append(number[1:] > 0, False))  # blocks with another after them
    if len(later):
        start = np.where(np.eye(n, dtype=bool), 0.0, -penalty)
        table = np.zeros((len(text), n, n))  # from the label before a block to the one at its end
        inner = feeds[number[feeds] > 0]
        table[inner] = walk(scores, begin[inner], length[inner], np.repeat(start[None], len(inner), 0), penalty)
        heads = feeds[number[feeds] == 0]
        ends = np.zeros((len(text), n))
        ends[heads] = walk(scores, begin[heads], length[heads], value[heads], penalty)
        for turn in range(1, int(blocks.max())):  # blocks, not words
            now = np.flatnonzero(number == turn)
            value[now] = switched(ends[now - 1], penalty)
            ends[now] = (ends[now - 1][:, :, None] + table[now]).max(1)
    back = np.zeros((total, n), np.int16)
    end = walk(scores, begin, length, value.copy(), penalty, back)
    out = np.empty(total, np.int64)
    # The last block of a text ends at its best label, any other where the next one asks.
    for turn in range(int(blocks.max()) - 1, -1, -1):
        now = np.flatnonzero(number == turn)
        last = number[now] == blocks[text[now]] - 1
        label = end[now].argmax(1)
        if (~last).any():
            rest = now[~last]
            asked = out[begin[rest + 1]]
            stay = end[rest, asked] >= end[rest].max(1) - penalty
            label[~last] = np.where(stay, asked, end[rest].argmax(1))
        trace(out, back, begin[now], length[now], label)
    return out


def trace(out: np.ndarray, back: np.ndarray, begin: np.ndarray, length: np.ndarray, label: np.ndarray) -> None:
    """Follow the labels of chains from their ends to their starts."""
    order = np.argsort(-length, kind="stable")
    begin, length, label = begin[order], length[order], label[order].copy()
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, "left"))
        at = begin[:live] + length[:live] - 1 - step
        out[at] = label[:live]
        label[:live] = back[at, label[:live]]


SPANS = "array<struct<begin:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` of every whole text.

    ``spans`` are stretches of neighbouring words of one language, as code point
    offsets; what lies between two spans belongs to neither.
    """
    names = np.array([*model.languages, UNKNOWN], object)

    def one(ids: pa.Array, body: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n, known = len(at) - 1, len(model.languages)
        words = words_of(body, at)
        count = len(words.starts) if known else 0
        new = np.ones(count, bool)
        new[1:] = words.row[1:count] != words.row[:max(count - 1, 0)]
        label = viterbi(model.scores(words), np.flatnonzero(new), penalty) if count else np.zeros(0, np.int64)
        row, letters = words.row[:count], words.letters[:count]
        share = np.bincount(row * max(known, 1) + label, letters, n * max(known, 1)).reshape(n, -1)
        whole = share.sum(1)
        best = np.where(whole > 0, share.argmax(1), known)
        score = share.max(1) / np.maximum(whole, 1)
        new[1:] |= label[1:] != label[:-1]
        opens = np.flatnonzero(new)
        closes = np.append(opens, count)[1:] - 1
        bounds = np.searchsorted(row[opens], np.arange(n + 1))
        spans = pa.StructArray.from_arrays([
            pa.array(words.starts[opens] - words.at[row[opens]], pa.int64()),
            pa.array(words.ends[closes] - words.at[row[opens]], pa.int64()),
            pa.array(names[label[opens]], pa.string()),
        ], ["begin", "end", "lang"])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(names[best], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)],
            ["doc_id", "lang_pred", "score", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, at in slices(batch.column(1), SLICE * 8 // max(8, len(model.languages))):
                yield one(batch.column(0).slice(lo, hi - lo), body, at)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans {SPANS}")


def classify(docs: DataFrame, per_language: int = 2000, penalty: float = 12.0) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, spans)``: learned from ``lang``, told for every text."""
    found = identify(docs, learn(docs, per_language), penalty)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")
