"""Near-duplicate vectors by quantised tile products with proven error bounds.

Unit vectors are rounded to 8-bit integers times a scale per vector; the length
of the rounding error is kept. For two vectors the product of the integers times
the scales misses the true cosine by at most ``ea * |b'| + eb`` (``e`` the error
lengths, ``b'`` the rounded vector), so a pair whose product plus that bound lies
below the threshold is none; only the others are computed in double precision.

Vectors are compared block by block: every pair of blocks is a cell of its own,
all cells of about the same bounded size. Identical vectors are one class first.

Defined results: null, empty and zero vectors and those with null or non-finite
components link with nothing and are their own component; so do rows without an
id, which are never kept; vectors of different length do not link; repeated rows
are vectors of their own that link with each other; an empty table gives an empty
one. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.components import connected_components
from belegwerk.session import materialise

BLOCK = 8192
TILE = 1024
PAIRS = 1 << 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scales, error lengths and lengths of the rounded vectors."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(unit - rounded, axis=1), np.linalg.norm(rounded, axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Index pairs with a cosine of at least ``threshold``, in bounded lots.

    With ``b`` None the pairs ``i < j`` within ``a``. Integer products fit a
    float32 exactly up to 1,040 dimensions; longer vectors use float64.
    """
    same = b is None
    b = a if same else b
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ea, _ = quantise(a / na[:, None])
    qb, sb, eb, lb = quantise(b / nb[:, None])
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(qb.T).astype(kind)
    slack = 1e-5  # far above the rounding of the single precision sums below
    for top in range(0, len(a), TILE):
        rows = slice(top, top + TILE)
        about = qa[rows].astype(kind) @ right
        about *= sa[rows, None].astype(kind)
        about *= sb[None].astype(kind)
        about += ea[rows, None].astype(kind) * lb[None].astype(kind)
        about += eb[None].astype(kind)
        i, j = np.nonzero(about >= threshold - slack)
        i += top
        if same:
            i, j = i[i < j], j[i < j]
        for lot in range(0, len(i), PAIRS):
            x, y = i[lot:lot + PAIRS], j[lot:lot + PAIRS]
            exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            hit = exact >= threshold
            yield x[hit], y[hit]


def join_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the classes of linked indices in place; the smallest index names a class."""
    while len(x):
        rx, ry = label[x], label[y]
        open_ = rx != ry
        if not open_.any():
            return
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(rx, ry)[open_], np.minimum(rx, ry)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    # By a power of two, which is exact: squares of very large or small entries stay in range.
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0, keepdims=True))[1])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` of every vector; exact for any labels.

    ``block`` bounds the vectors of a block and so the memory of a cell.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(key).alias("id"),
        F.when(F.col(key).isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.col(vector)).alias("v"),
    )
    # One class per distinct vector, combined before the shuffle.
    classes = materialise(
        rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    blocks = max(4, -(-classes.count() // block))
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks))
    cells = classes.select("rep", "n", "v", F.size("v").alias("dim"), own.alias("own")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).select(
        "rep", "n", "v", "dim", "own",
        F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"),
    )

    def cell(keys: tuple, table: pa.Table) -> pa.Table:
        i, j = keys[1].as_py(), keys[2].as_py()
        table = table.sort_by("rep")
        ids, n = (table.column(c).to_numpy() for c in ("rep", "n"))
        side = table.column("own").to_numpy()
        matrix = _matrix(table)
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(left) and len(right):
            for x, y in near_pairs(matrix[left], None if i == j else matrix[right], threshold):
                x, y = left[x], right[y]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                join_labels(label, x, y)
        some = np.flatnonzero(links)
        return pa.table({"a": ids[some], "b": ids[label[some]], "links": links[some]})

    pairs = materialise(
        cells.groupBy("dim", "i", "j").applyInArrow(cell, f"a {kind}, b {kind}, links long")
    )
    linked = pairs.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(pairs).withColumnRenamed("id", "rep")
    found = classes.join(linked, "rep", "left").join(component, "rep", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    # Vectors that are none take no part in the join, where their nulls would meet in one task.
    named = rows.filter("v is not null").join(found, "v", "left").select("id", "n_links", "component_id")
    none = rows.filter("v is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(kind).alias("component_id"))
    return named.unionByName(none).select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )
