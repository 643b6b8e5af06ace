"""Lempel-Ziv phrase fingerprints and their likeness.

A text is parsed into phrases: each is the shortest run of code points that was no
phrase before. The set of phrases is hashed and kept as a minimum-hash signature,
so the share of equal places of two signatures estimates how many phrases two
texts have in common: the more one text helps to compress the other, the more.

Defined results: a null text is empty; an empty text has no phrase and a signature
of its own, like only to itself; a row without an id comes last; rows with one id
follow each other by text; an empty table gives an empty one. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.hashing import RunHash, mix

PLACES = 128
_SEEDS = mix(np.arange(1, PLACES + 1, dtype=np.uint64)) >> np.uint64(32)
_SEEDS = _SEEDS.astype(np.uint32)
EMPTY = np.full(PLACES, 0xFFFFFFFF, np.uint32)


def parse(text: str, known: set[str], open_: str = "") -> tuple[list[str], str]:
    """New phrases of ``text``, added to ``known``, and the unfinished last one."""
    found, w = [], open_
    add, keep = known.add, found.append
    for c in text:
        w += c
        if w not in known:
            add(w)
            keep(w)
            w = ""
    return found, w


def signature(phrases: list[str], so_far: np.ndarray = EMPTY) -> np.ndarray:
    """Least hash of every place over the phrases and what came before."""
    if not phrases:
        return so_far
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    points = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = (RunHash(points).of(np.append(0, ends[:-1]), ends) >> np.uint64(32)).astype(np.uint32)
    for lot in range(0, len(h), 2048):
        x = h[lot:lot + 2048, None] ^ _SEEDS
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        so_far = np.minimum(so_far, x.min(0))
    return so_far


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places, 0 to 1."""
    return float((a == b).mean())


def fingerprint(text: str) -> str:
    return signature(parse(text, set())[0]).tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint)`` of every whole text, as hexadecimal places."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["key", "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


class Halved:
    """A text, its signature, and the parse of its first half to go on from."""

    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.cut = len(text) // 2
        self.known: set[str] = set()
        head, self.open = parse(text[:len(text) - self.cut], self.known)
        self.head = signature(head)
        tail, _ = parse(text[len(text) - self.cut:], self.known, self.open)
        self.known.difference_update(tail)
        self.own = signature(tail, self.head)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text whose last half is replaced by the beginning of ``other``."""
        tail, _ = parse(other[:self.cut], self.known, self.open)
        return self.text[:len(self.text) - self.cut] + other[:self.cut], signature(tail, self.head)


COLUMNS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against its edit by the next one, ids descending, and the next one.

    Texts are cut into ranges of ids of about equal numbers and each range streams
    past in order, so texts are shuffled once; the first text of a range also goes
    to the range before it, and the very first to the last range.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    share = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = docs.agg(F.percentile_approx(key, share)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        """Range of each id: 0 holds the largest ids, the last one those without."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(known, len(cuts) - np.searchsorted(cuts, values, "left"), len(cuts) + 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place(batch.column(0)), pa.int32())], ["id", "place"])

    ids = docs.select(F.col(key).alias("id"))
    firsts = ids.mapInArrow(places, f"id {kind}, place int").groupBy("place").agg(F.max("id").alias("id"))
    firsts = sorted((r["place"], r["id"]) for r in firsts.collect())  # one row for each range
    before = {place: (firsts[n - 1][0]) for n, (place, _) in enumerate(firsts)}
    first_id = dict(firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = place(batch.column(0))
            keys = batch.column(0).to_pylist()
            extra = [n for n, (p, k) in enumerate(zip(own.tolist(), keys)) if k == first_id[p]]
            to = np.append(own, [before[int(own[n])] for n in extra]).astype(np.int32)
            rows = pa.array(np.append(np.arange(len(own)), extra).astype(np.int64))
            role = np.append(np.zeros(len(own)), np.ones(len(extra))).astype(np.int32)
            out = batch.take(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(role), out.column(0), out.column(1)], ["place", "role", "id", "text"]
            )

    def row(item: Halved, following: Halved) -> tuple:
        text, edited = item.edited(following.text)
        return (
            item.key, len(item.text), hashlib.sha256(text.encode()).hexdigest(), item.own.tobytes().hex(),
            edited.tobytes().hex(), likeness(item.own, edited), likeness(item.own, following.own),
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_place, closed = None, None, False

        def pack(rows: list[tuple], own: pa.DataType) -> pa.RecordBatch:
            types = [own, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            return pa.RecordBatch.from_arrays(
                list(map(pa.array, zip(*rows), types)),
                ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            done = []
            for n in range(batch.num_rows):
                at, role, key_, text_ = (batch.column(c)[n].as_py() for c in range(4))
                if role and (closed or at != last_place):
                    continue  # a further row with the id of the first one
                item = Halved(key_, text_ or "")
                if last is not None and at == last_place:
                    done.append(row(last, item))
                last, last_place, closed = (None, at, True) if role else (item, at, False)
                if len(done) >= 256:
                    yield pack(done, batch.schema.field(2).type)
                    done = []
            if done:
                yield pack(done, batch.schema.field(2).type)

    dealt = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        deal, f"place int, role int, id {kind}, text string"
    )
    ordered = dealt.repartition(ranges, "place").sortWithinPartitions("place", "role", F.desc_nulls_last("id"), "text")
    return ordered.mapInArrow(walk, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)
