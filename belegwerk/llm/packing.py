"""Best-fit-decreasing packing of token pieces into sequences of one capacity.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus holds)
and each piece finds its place by its rank among the pieces of its length.

Defined results: a null text counts as empty; every document ends with ``end_id``
and so has at least one piece; repeated rows are packed each for itself; an empty
table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.llm.arrow_text import slices
from belegwerk.llm.byte_bpe import Encoder
from belegwerk.session import small_batches


class PieceEncoder(Encoder):
    """Encodes distinct words by the tiktoken library: the same ids, sooner."""

    def __init__(self, path: str):
        super().__init__(path)
        self.core = tiktoken.Encoding(
            "words", pat_str="", mergeable_ranks=self.token, special_tokens={}
        )._core_bpe.encode_single_piece
        made = [self.rank[t] for t in sorted(self.token.values())]
        if made != sorted(made):
            raise ValueError("ids do not follow the order of the merges")

    def encode_words(self, distinct: list[bytes]) -> None:
        for word in distinct:
            self.known[word] = array("i", self.core(word)).tobytes()


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(key, piece, start, length, ids)``: every document's ids, cut where too long.

    Only documents above ``capacity`` tokens are cut; all pieces but the first
    are full. ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    small_batches(docs.sparkSession)
    out = docs.select(key, text)
    kind = out.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(1)):
                ids, at = piece_encoder(path).encode(batch.column(1).slice(lo, hi - lo))
                rows, numbers, starts, lengths, blobs = [], [], [], [], []
                bounds = at.tolist()
                for row in range(hi - lo):
                    own = np.append(ids[bounds[row]:bounds[row + 1]].astype("<u4"), end)
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(lo + row)
                        numbers.append(n)
                        starts.append(a)
                        lengths.append(b - a)
                        blobs.append(own[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary()),
                ], ["key", "piece", "start", "length", "ids"])

    schema = f"key {kind}, piece int, start long, length long, ids binary"
    return out.mapInArrow(run, schema).withColumnRenamed("key", key)


class OpenBins:
    """Groups of equal bins by remaining capacity, under a segment tree.

    A node counts the groups below it, so the tightest capacity that holds a
    piece is found in logarithmic time.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, by: int) -> None:
        node = self.leaves + remaining
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            self.groups[remaining].append((first, bins))
            self._add(remaining, 1)

    def pop(self, remaining: int) -> tuple[int, int]:
        self._add(remaining, -1)
        return self.groups[remaining].pop()

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size``."""
        node = self.leaves + size
        while not self.count[node]:
            while node & 1:  # a right child: what lies right of it is right of its parent
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Runs ``(length, rank_from, rank_to, first_bin, per_bin, offset)``.

    The pieces of one length with a rank in the run fill the bins from
    ``first_bin`` on, ``per_bin`` each, from ``offset`` on. Exactly the bins
    that placing piece after piece would give: a piece that best fits a bin
    makes it tighter, so its equals follow until it is full.
    """
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = bins.pop(room)
            per = room // length
            full = min(many, left // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                bins.push(room - per * length, first, full)
            first, many = first + full, many - full
            if many and 0 < left < per:
                runs.append((length, rank, rank + left, first, per, capacity - room))
                bins.push(room - left * length, first, 1)
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            bins.push(room, first, many)
    return runs


def place(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, as few sequences as best fit gives.

    ``pieces`` is read twice and must give the same rows each time: pass a
    stored table. The driver sees one number per length; a length that most
    pieces share is ranked in salted parts.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    runs = spark.createDataFrame(
        best_fit_decreasing(histogram, capacity),
        "length long, _from long, _to long, _first long, _per long, _offset long",
    )
    within = Window.partitionBy("length", "_salt").orderBy(key, "piece")
    ranked = salted.withColumn("_k", F.row_number().over(within) - 1).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_k"))
    r, p = runs.alias("r"), ranked.alias("p")
    hit = (F.col("p.length") == F.col("r.length")) & F.col("p._rank").between(F.col("r._from"), F.col("r._to") - 1)
    at = F.col("p._rank") - F.col("r._from")
    # At most a few runs per length and open group: bounded by the capacity alone.
    return p.join(F.broadcast(r), hit).select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        (F.col("r._first") + F.floor(at / F.col("r._per"))).cast("long").alias("sequence_id"),
        (F.col("r._offset") + F.pmod(at, F.col("r._per")) * F.col("p.length")).cast("long").alias("offset"),
    )


def sequences(pieces: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves.

    ``key`` must name one document in both tables. A group holds at most the
    capacity's ids.
    """
    spots = placed.select(key, "piece", "sequence_id", "offset")
    parts = pieces.select(key, "piece", "ids").join(spots, [key, "piece"])
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(whole.alias("parts")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids")
    )
