"""Merkle manifest of a table: a root per group and one over the groups, with proofs.

Every row is a leaf, the SHA-256 of its fields. In each group the leaves ascend by id.
While several nodes remain, every two neighbours (a last one alone) become the hash of
their digests. The roots of the groups, in order of the group, are reduced alike.

1. Ids become bitmaps: words of 64 ids, OR-combined for each group before and after the
   shuffle; words without ids do not exist. A directory of counts, four levels of 14
   bits, gives the leaves before each word. So a rank query, the count before the word
   plus the bits below the id, is the leaf's coordinate; no group is ever sorted.
2. Leaves are dealt by coordinate to slot arrays of ``SLOTS`` and put at their place;
   an array is reduced to one node, those are dealt to the next arrays, and so on.
3. Paths come back down the same way; with the path of its array, each leaf's proof is
   read off the array once more.

Rows with one id follow each other by leaf digest, equal ones in any order (they are
equal). Rows without an id come first, as one such run. Those runs are ranked by leading
digest bits first, so that a hot id is spread over many tasks; fully equal rows are
counted before any shuffle.

Defined results: a null field is ``-``, an empty text ``0:``; an empty table gives an
empty result; a null group comes before all others. Ids are integers, the group is a
string. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.session import materialise

SLOTS_BITS = 10
SLOTS = 1 << SLOTS_BITS  # nodes of one slot array
WORD_BITS, STEP = 6, 14  # ids of a bitmap word, words below a place of the directory
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def node(*digests: bytes) -> bytes:
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def exclusive(count: str, by: list[str], order: str) -> Column:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0).cast("long"))


def bitmap_directory(ids: DataFrame) -> DataFrame:
    """``(g, word, bits, start, more)`` of ``(g, doc_id, rows)``: a bitmap of each group's ids.

    ``start`` is the number of rows before the word, ``more`` lists the ids of the word
    that have several rows.
    """
    place = F.col("doc_id").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    several = F.when(F.col("rows") > 1, F.struct(place.alias("place"), (F.col("rows") - 1).alias("extra")))
    words = materialise(
        ids.select("g", F.shiftright("doc_id", WORD_BITS).alias("word"), "rows",
                   F.expr(f"shiftleft(1L, cast(doc_id & {(1 << WORD_BITS) - 1} as int))").alias("bit"), several.alias("several"))
        .groupBy("g", "word").agg(
            F.bit_or("bit").alias("bits"), F.sum("rows").alias("rows"), F.collect_list("several").alias("more"),
        )
    )
    # Every window sees at most 2**STEP places of one level, whatever the ids are.
    level = words.select("g", F.shiftright("word", STEP).alias("p1"), "rows").groupBy("g", "p1").agg(F.sum("rows").alias("rows"))
    level = materialise(level.select("g", "p1", F.shiftright("p1", STEP).alias("p2"), F.shiftright("p1", 2 * STEP).alias("p3"), "rows"))
    top = level.groupBy("g", "p3").agg(F.sum("rows").alias("rows")).select("g", "p3", exclusive("rows", ["g"], "p3").alias("s3"))
    middle = level.groupBy("g", "p3", "p2").agg(F.sum("rows").alias("rows")).select(
        "g", "p3", "p2", exclusive("rows", ["g", "p3"], "p2").alias("s2")
    ).join(top, ["g", "p3"]).select("g", "p2", (F.col("s2") + F.col("s3")).alias("s2"))
    low = level.select("g", "p2", "p1", exclusive("rows", ["g", "p2"], "p1").alias("s1")).join(middle, ["g", "p2"]).select(
        "g", "p1", (F.col("s1") + F.col("s2")).alias("s1")
    )
    own = words.withColumn("p1", F.shiftright("word", STEP)).withColumn("s0", exclusive("rows", ["g", "p1"], "word"))
    return own.join(low, ["g", "p1"]).select("g", "word", "bits", (F.col("s0") + F.col("s1")).alias("start"), "more")


def rank(word: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` with ``first``: the rows of the group with a smaller id, by one rank query each."""
    place = F.col("doc_id").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    below = F.expr(f"bit_count(bits & ~shiftleft(-1L, cast(doc_id & {(1 << WORD_BITS) - 1} as int)))")
    extra = F.aggregate(
        F.filter("more", lambda m: m["place"] < place), F.lit(0).cast("long"), lambda s, m: s + m["extra"]
    )
    asked = ids.withColumn("word", F.shiftright("doc_id", WORD_BITS))
    return asked.join(word, ["g", "word"]).withColumn("first", F.col("start") + below + extra).select(*ids.columns, "first")


def coordinates(leaves: DataFrame) -> DataFrame:
    """``(g, doc_id, leaf, tampered, index)``: every leaf and its place in its group."""
    rows = materialise(leaves.groupBy("g", "doc_id", "leaf").agg(
        F.count(F.lit(1)).alias("copies"), F.first("tampered").alias("tampered")
    ))
    ids = materialise(rows.groupBy("g", "doc_id").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("kinds")))
    known = ids.filter("doc_id is not null")
    # Rows without an id come before all others of their group.
    nameless = ids.filter("doc_id is null").select("g", F.col("rows").alias("nameless"))
    first = rank(bitmap_directory(known.select("g", "doc_id", "rows")), known.select("g", "doc_id", "rows", "kinds"))
    first = first.join(nameless, "g", "left").select(
        "g", "doc_id", "kinds", (F.col("first") + F.coalesce("nameless", F.lit(0))).alias("first")
    ).unionByName(ids.filter("doc_id is null").select("g", "doc_id", "kinds", F.lit(0).cast("long").alias("first")))
    first = first.withColumnRenamed("g", "g_").withColumnRenamed("doc_id", "id_")
    placed = rows.join(first, (F.col("g") == F.col("g_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).drop("g_", "id_")
    lone = placed.filter("kinds = 1").withColumn("before", F.lit(0).cast("long"))
    # Several leaves of one id: by leading digest bits, then by digest.
    several = placed.filter("kinds > 1").withColumn("lead", F.substring("leaf", 1, 4))
    leads = several.groupBy("g", "doc_id", "lead").agg(F.sum("copies").alias("n")).withColumn(
        "ahead", exclusive("n", ["g", "doc_id"], "lead")
    ).select(F.col("g").alias("g_"), F.col("doc_id").alias("id_"), F.col("lead").alias("lead_"), "ahead")
    several = several.join(
        leads, (F.col("g") == F.col("g_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("lead") == F.col("lead_"))
    ).withColumn("before", F.col("ahead") + exclusive("copies", ["g", "doc_id", "lead"], "leaf"))
    both = lone.unionByName(several.select(lone.columns))
    return both.select(
        "g", "doc_id", "leaf", "tampered", (F.col("first") + F.col("before")).alias("from"), "copies"
    ).select("g", "doc_id", "leaf", "tampered", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("copies") - 1)).alias("index"))


def levels_of(nodes: list[bytes], most: int) -> list[list[bytes]]:
    """The nodes of a slot array and of each level above, at most ``most`` of those."""
    levels = [nodes]
    for _ in range(most):
        below = levels[-1]
        levels.append([node(*below[k:k + 2]) for k in range(0, len(below), 2)])
    return levels


def depth_of(count: int) -> int:
    """Levels until one of ``count`` nodes is left."""
    return (count - 1).bit_length()


def path_of(levels: list[list[bytes]], place: int) -> bytes:
    """Siblings of a node, level by level: ``l`` or ``r`` and the digest, ``.`` where it is alone."""
    steps = []
    for level in levels[:-1]:
        other = place ^ 1
        steps.append(b"." if other >= len(level) else (b"r" if other > place else b"l") + level[other])
        place >>= 1
    return b"".join(steps)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and its path give."""
    at = 0
    while at < len(path):
        side, other = path[at:at + 1], path[at + 1:at + 65]
        if side == b".":
            digest, at = node(digest), at + 1
        else:
            digest, at = node(other, digest) if side == b"l" else node(digest, other), at + 65
    return digest


def siblings(path: bytes) -> bytes:
    """The digests of a path, one after another."""
    return path.translate(None, b"lr.")


KEPT = {"doc_id": "array<long>", "tampered": "array<string>"}


def slot_arrays(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each slot array of ``(g, index, count, digest)``: its nodes in place and its root.

    ``count`` is the number of nodes of the group's whole level. Columns of ``keep`` stay
    beside the nodes.
    """

    def reduce(table: pa.Table) -> pa.Table:  # at most SLOTS rows
        place = pa.array(np.argsort(table.column("index").to_numpy()))  # indices of an array are all there, once
        table = table.take(place)
        slots = [d.encode() for d in table.column("digest").to_pylist()]
        count = table.column("count")[0].as_py()
        top = levels_of(slots, min(SLOTS_BITS, depth_of(count)))[-1][0]
        return pa.table({
            "g": pa.array([table.column("g")[0].as_py()], pa.string()), "block": [table.column("block")[0].as_py()], "count": [count],
            "root": [top.decode()], "slots": [b"".join(slots)], **{c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in keep},
        })

    dealt = nodes.withColumn("block", F.shiftright("index", SLOTS_BITS)).select("g", "block", "count", "index", "digest", *keep)
    kind = "g string, block long, count long, root string, slots binary" + "".join(f", {c} {KEPT[c]}" for c in keep)
    return materialise(dealt.groupBy("g", "block").applyInArrow(reduce, kind))


def array_levels(slots: bytes, count: int) -> list[list[bytes]]:
    return levels_of([slots[k:k + 64] for k in range(0, len(slots), 64)], min(SLOTS_BITS, depth_of(count)))


def paths(arrays: DataFrame, upper: DataFrame) -> DataFrame:
    """``(g, index, path, root)`` of every slot, from ``upper``: the same of the arrays' roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, count, slots, path, root in zip(*(c.to_pylist() for c in batch.columns)):
                levels = array_levels(slots, count)
                n = len(levels[0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([g] * n, pa.string()), pa.array([block * SLOTS + k for k in range(n)], pa.int64()),
                    pa.array([(path_of(levels, k) + path.encode()).decode() for k in range(n)], pa.string()),
                    pa.array([root] * n, pa.string()),
                ], ["g", "index", "path", "root"])

    above = upper.withColumnRenamed("index", "block").withColumnRenamed("root", "top")
    rows = arrays.join(above, ["g", "block"]).select("g", "block", "count", "slots", "path", "top")
    return materialise(rows.mapInArrow(run, "g string, index long, path string, root string"))


def reduce_groups(leaves: DataFrame, most: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Slot arrays of ``(g, index, count, digest)``, and ``(g, index, path, root)`` of their roots.

    ``most`` is the largest count of a group. ``path`` and ``root`` are the group's.
    """
    passes = [slot_arrays(leaves, keep)]
    while most > SLOTS:
        most = -(-most // SLOTS)
        passes.append(slot_arrays(passes[-1].select(
            "g", F.col("block").alias("index"), F.expr(f"(count + {SLOTS - 1}) div {SLOTS}").alias("count"), F.col("root").alias("digest")
        )))
    upper = passes[-1].select("g", F.col("block").alias("index"), F.lit("").alias("path"), "root")
    for arrays in passes[:0:-1]:
        upper = paths(arrays, upper)
    return passes[0], upper


PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, path string")


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path)`` of every row.

    ``path`` lists the siblings from the leaf up to the root with their sides. A row is
    verified by folding ``tampered``, its leaf as read again (null: unchanged), along it.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(*FIELDS).select(
        F.col("doc_id").cast("long").alias("doc_id"), group.alias("g"), leaf_of().alias("leaf"), tampered.alias("tampered")
    )
    placed = materialise(coordinates(leaves))
    sizes = materialise(placed.groupBy("g").agg(F.count(F.lit(1)).alias("count")))
    most, groups = sizes.agg(F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).first()
    arrays, upper = reduce_groups(
        placed.join(sizes, "g").withColumnRenamed("leaf", "digest"), most, ("doc_id", "tampered")
    )
    # One row for each group. Text order is bytewise; the key of the null group is the least.
    subroots = upper.groupBy("g").agg(F.first("root").alias("digest")).withColumn(
        "index", F.row_number().over(Window.orderBy("g")).cast("long") - 1
    )
    subroots = materialise(subroots)
    over_all, top = reduce_groups(
        subroots.select(F.lit("").alias("g"), "index", F.lit(groups).cast("long").alias("count"), "digest"), groups
    )
    roots = paths(over_all, top).select("index", F.col("path").alias("onward"), F.col("root").alias("top"))
    ends = materialise(subroots.join(roots, "index").select("g", F.col("digest").alias("subroot"), "onward", "top"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for count, slots, ids, again, path, subroot, onward, root in zip(*(c.to_pylist() for c in batch.columns)):
                levels = array_levels(slots, count)
                above, rows = (path + onward).encode(), []
                for k, digest in enumerate(levels[0]):
                    whole = path_of(levels, k) + above
                    folded = fold(again[k].encode() if again[k] else digest, whole).decode()
                    rows.append((
                        ids[k], digest.decode(), subroot, root, node(siblings(whole)).decode(), folded, folded == root, whole.decode(),
                    ))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [
                    "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"
                ])

    above = upper.select("g", F.col("index").alias("block"), "path")
    rows = arrays.join(above, ["g", "block"]).join(ends, "g")
    return rows.select("count", "slots", "doc_id", "tampered", "path", "subroot", "onward", "top").mapInArrow(prove, PROOFS)


def audit(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest, verified against a copy in which rows have been tampered with.

    Where ``every`` divides the CRC-32 of the id as text, ``n_chars`` is one more.
    """
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    again = F.when(hit, leaf_of(n_chars=F.col("n_chars") + 1))
    return manifest(docs, again).drop("path")
