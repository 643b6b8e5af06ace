"""Exact Jaccard join of texts on word shingles, by signature trees.

1. Every text becomes its set of shingle hashes; equal sets are one class.
2. Two sets that link share one of their first ``n - ceil(p n) + 1`` elements in any
   fixed order, so sets meet at those keys. Shingles that a sample of the texts shows
   to be frequent come last in the order; that decides the cost, never the result.
3. At each key a signature tree over the sets' bitmaps gives the pairs that may link,
   reduced to spanning pairs; their components are the candidate clusters.
4. In each cluster a signature tree over the whole sets tests pairs exactly until all
   are linked or told apart. Links between classes give the components.

Groups whose sets have more than ``CELL`` units of ``UNIT`` shingles are split into blocks,
and each pair of blocks is a cell of its own: memory stays bounded, however many or long
the texts are, and no pair is lost. Only spanning pairs leave a task, never all pairs of
a group.

Defined results: null and empty texts and those without words have no shingles, link
with nothing and are their own component; a row without an id links with nothing and
has no component; repeated rows are one class. Rows with one id are one document, for
which the row of the least set stands (by size, then by hash): all of them get its
component, each its own number of shingles. An empty table gives an empty one. Ids are
integers. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.arrow_text import flat, slices, spread, strings
from belegwerk.llm.components import connected_components
from belegwerk.llm.hashing import mix
from belegwerk.llm.shingles import ROWS, shingle_sets
from belegwerk.llm.signature_tree import Signatures, bitmap, join_group, needed
from belegwerk.llm.vectors import join_labels
from belegwerk.session import materialise, small_batches

CELL, UNIT = 2048, 512  # units of a block, shingles of a unit: 8 MB of hashes
WORK = 8 << 20  # bytes of groups worked on at once
SAMPLED = 64  # one text in so many shows which shingles are frequent
FREQUENT = 3  # texts of the sample that have a frequent shingle
MOST_FREQUENT = 100_000  # frequent shingles that the order knows, the commonest first


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of common shingles, at most ``MOST_FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, body, at in slices(batch.column(0), rows=ROWS):
                codes, counts = np.unique(shingle_sets(body, at, size)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLED)) == 0).select("text")
    counts = sample.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).toArrow()
    return np.sort(top.column("code").to_numpy().astype(np.int64).view(np.uint64))


def set_hashes(codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order of its elements."""
    out = []
    for k in (1, 2):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(0xA5A5 * k)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def text_sets(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, n, s1, s2, keys, sig)``: set size, set hashes, prefix keys and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, at in slices(batch.column(1), rows=ROWS):
                codes, bounds = shingle_sets(body, at, size)
                n = np.diff(bounds)
                common = np.isin(codes, frequent)
                owner = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((codes, common, owner))
                rank = np.arange(len(codes)) - np.repeat(bounds[:-1], n)
                prefix = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                first = rank < prefix[owner]
                keys = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(prefix)), pa.int32()), pa.array(codes[order][first].view(np.int64))
                )
                s1, s2 = set_hashes(codes, bounds)
                sig = [bitmap(codes[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(s1), pa.array(s2), keys, pa.array(sig, pa.binary())],
                    ["doc_id", "n", "s1", "s2", "keys", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, s1 long, s2 long, keys array<long>, sig binary"
    )


def shared_rows(rows: DataFrame) -> DataFrame:
    """``(key, id, n, place)`` of keys that more than one row has.

    ``place`` adds up the units of the rows before it with the same key. Rows stream past
    in the order of their key; one row is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, alone = None, 0, True  # the last row, its place, whether it is its key's first
        for batch in batches:
            key, ids, n = (batch.column(c).to_numpy() for c in range(3))
            if not len(key):
                continue
            if held is not None:
                key, ids, n = (np.append(h, c) for h, c in zip(held, (key, ids, n)))
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            units = -(-n // UNIT)
            place = np.cumsum(units) - units
            start = np.flatnonzero(first)
            place -= np.repeat(place[start], np.diff(np.append(start, len(key))))
            run_on = np.cumsum(first) == 1
            if held is not None:
                place += np.where(run_on, before, 0)
                first[0] = alone
            shared = ~first | np.append(key[1:] == key[:-1], False)
            shared[-1] = False  # decided with the next batch
            out = np.flatnonzero(shared)
            held, before, alone = (key[-1:], ids[-1:], n[-1:]), int(place[-1]), bool(first[-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (key, ids, n, place)], ["key", "id", "n", "place"])
        if held is not None and not alone:
            yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array([before], pa.int64())], ["key", "id", "n", "place"])

    return rows.select("key", "id", "n").repartition("key").sortWithinPartitions("key", "id").mapInArrow(
        run, "key long, id long, n long, place long"
    )


def into_cells(rows: DataFrame, cell: int) -> DataFrame:
    """``(key, i, j, id)`` with cell numbers ``i <= j``; a group of up to ``cell`` units is one cell.

    Needs ``key``, ``id`` and ``place``. A row of a larger group goes to every cell of its block.
    """
    large = rows.filter(F.col("place") >= cell).groupBy("key").agg((F.max("place") / cell + 1).cast("int").alias("blocks"))
    own = F.floor(F.col("place") / cell).cast("int")
    return rows.join(large, "key", "left").select("key", "id", own.alias("own"), F.explode(
        F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    ).alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id")


class Classes:
    """Classes of the ids of one batch of groups, as positions; merged pair by pair."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.position = np.unique(ids, return_inverse=True)
        self.label = np.arange(len(self.ids))

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.label[self.position[rows]]

    def merge(self, x: np.ndarray, y: np.ndarray) -> None:
        join_labels(self.label, self.position[x], self.position[y])

    def spanning(self) -> pa.RecordBatch:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[moved]), pa.array(self.ids[self.label[moved]])], ["a", "b"])


def by_group(
    rows: DataFrame, payload: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]
) -> DataFrame:
    """Apply ``work`` to whole groups ``(key, i, j)``, some at a time, as they stream past.

    ``work`` gets a table and the first row of each group; it returns pairs of ids. It gets
    groups of ``WORK`` bytes together, or one that is larger.
    """

    def group_starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in ("key", "i", "j"):
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def some(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts, table.num_rows)[1:]
        most = max(1, table.num_rows * WORK // max(1, table.nbytes))  # rows
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, "right")))
            yield work(table.slice(starts[lo], ends[hi - 1] - starts[lo]), starts[lo:hi] - starts[lo])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, waiting = 0, 1
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < waiting:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table)
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield from some(table.slice(0, cut), starts[:-1])
            rest = table.slice(cut)
            held, count = rest.to_batches(), rest.num_rows
            waiting = 2 * count  # a long group is not looked at again for every batch
        if count:
            table = pa.Table.from_batches(held)
            yield from some(table, group_starts(table))

    ordered = rows.select("key", "i", "j", "id", *payload).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return ordered.mapInArrow(run, "a long, b long")


def small_and_large(starts: np.ndarray, total: int, most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row pairs of all groups of up to ``most`` rows, and the rows of each larger group."""
    size = np.diff(np.append(starts, total))
    x, y = [], []
    for n in range(2, most + 1):
        own = starts[size == n]
        if len(own):
            i, j = np.triu_indices(n, 1)
            x.append((own[:, None] + i).ravel())
            y.append((own[:, None] + j).ravel())
    empty = np.zeros(0, np.int64)
    large = [np.arange(s, s + n) for s, n in zip(starts[size > most].tolist(), size[size > most].tolist())]
    return np.concatenate([empty, *x]), np.concatenate([empty, *y]), large


def link_classes(docs: DataFrame, size: int = 5, percent: int = 80, cell: int = CELL) -> tuple[DataFrame, ...]:
    """Sets of all rows, of all documents, and of all classes, and the links between those.

    ``(doc_id, n, s1, s2)`` twice, ``(id, n, s1, s2)`` with the smallest document of each set,
    and spanning links ``(a, b)`` of classes with a similarity of at least ``percent``.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = text_sets(docs, size, percent, frequent_shingles(docs, size))
    sets = materialise(sets.withColumn("row", F.monotonically_increasing_id()))
    known = sets.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    own = known.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "row")).alias("own")).select("doc_id", "own.*")
    own = materialise(own)
    reps = own.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    # A class goes by its smallest document; ``row`` finds the set of that one.
    alone = materialise(reps.join(own.select(F.col("doc_id").alias("id"), "row"), "id"))
    keys = known.select(F.col("row").alias("id"), "n", F.explode("keys").alias("key"))
    # Copies leave first, so that only classes count for the size of a group.
    some = shared_rows(keys).withColumnRenamed("id", "row").join(alone.select("row", "id"), "row")
    shared = materialise(shared_rows(some))
    bitmaps = known.select("row", "n", "sig").join(alone.select("row", "id"), "row").drop("row")
    members = into_cells(shared, cell).join(bitmaps, "id")

    def candidates(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        classes = Classes(table.column("id").to_numpy())
        signatures = Signatures(table.column("n").to_numpy(), table.column("sig").to_pylist())
        x, y, large = small_and_large(starts, table.num_rows, 16)
        for lot in range(0, len(x), 1 << 16):
            a, b = x[lot:lot + (1 << 16)], y[lot:lot + (1 << 16)]
            apart = classes.of(a) != classes.of(b)
            a, b = a[apart], b[apart]
            may = signatures.may_link(a, b, percent)
            classes.merge(a[may], b[may])
        for rows in large:
            join_group(signatures, rows, percent, classes.of, classes.merge)
        return classes.spanning()

    near = connected_components(by_group(members, ["n", "sig"], candidates)).withColumnRenamed("component_id", "key")
    near = materialise(near.join(alone, "id").select("key", "id", "n", "s1", "s2"))
    return sets.drop("keys", "sig", "row"), own.drop("row"), alone.drop("row"), exact_links(docs, near, size, percent, cell)


def exact_links(docs: DataFrame, clusters: DataFrame, size: int, percent: int, cell: int) -> DataFrame:
    """Spanning links ``(a, b)`` within clusters ``(key, id, n, s1, s2)``, tested on whole sets."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for lo, hi, body, at in slices(batch.column(5), rows=ROWS):
                codes, bounds = shingle_sets(body, at, size)
                found = np.stack([np.diff(bounds), *set_hashes(codes, bounds)], 1)
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                # Of rows with one id, those of the set that stands for it; repeated rows come together.
                fits = (found == np.stack([batch.column(c).slice(lo, hi - lo).to_numpy() for c in (1, 2, 3)], 1)).all(1)
                fit = np.flatnonzero(fits)
                fit = fit[np.append(True, ids[fit][1:] != ids[fit][:-1])[:len(fit)]]
                if len(fit) and ids[fit[0]] == last:
                    fit = fit[1:]
                if not len(fit):
                    continue
                last = ids[fit[-1]]
                n = np.diff(bounds)[fit]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[fit]), batch.column(4).slice(lo, hi - lo).take(pa.array(fit)),
                    strings(codes[spread(bounds[fit], n)].view(np.uint8), np.append(0, np.cumsum(8 * n))),
                ], ["id", "cells", "codes"])

    def links(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        classes = Classes(table.column("id").to_numpy())
        body, at = flat(table.column("codes"))
        sets = [body[a:b].view(np.uint64) for a, b in zip(at.tolist(), at[1:].tolist())]
        sizes = np.diff(at) // 8
        signatures = Signatures(sizes, [bitmap(s) for s in sets])

        def test(x: np.ndarray, y: np.ndarray) -> None:
            for a, b in zip(x.tolist(), y.tolist()):
                pair = np.array([a]), np.array([b])
                if classes.of(pair[0])[0] == classes.of(pair[1])[0]:
                    continue
                one, other = (sets[a], sets[b]) if sizes[a] <= sizes[b] else (sets[b], sets[a])
                spot = np.minimum(np.searchsorted(other, one), len(other) - 1)
                if (other[spot] == one).sum() >= needed(sizes[a], sizes[b], percent):
                    classes.merge(*pair)

        for rows in (np.arange(s, e) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows])):
            join_group(signatures, rows, percent, classes.of, test)
        return classes.spanning()

    # Hashes are made of each text once and travel once, to all cells of their set.
    cells = into_cells(shared_rows(clusters), cell).groupBy("id").agg(F.collect_list(F.struct("key", "i", "j")).alias("cells"))
    # One plan at every size: clusters grow with the input, so they are never broadcast.
    chosen = clusters.join(cells, "id").select("id", "n", "s1", "s2", "cells").hint("shuffle_merge")
    rows = chosen.join(docs.withColumnRenamed("doc_id", "id"), "id").select("id", "n", "s1", "s2", "cells", "text")
    kind = "id long, cells array<struct<key:long,i:int,j:int>>, codes binary"
    sets = rows.mapInArrow(whole, kind).select("id", F.explode("cells").alias("cell"), "codes").select("id", "cell.*", "codes")
    return materialise(by_group(sets, ["codes"], links))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, cell: int = CELL) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    sets, own, classes, links = link_classes(docs, size, percent, cell)
    found = classes.join(connected_components(links), "id", "left").select(
        "n", "s1", "s2", F.coalesce("component_id", "id").alias("component_id")
    )
    named = own.join(materialise(found), ["n", "s1", "s2"]).select("doc_id", "component_id")
    return sets.join(named, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component, unchanged: one of each group.

    Rows without an id stay; rows with one id stay or go together.
    """
    found = near_duplicates(docs, size, percent)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
