"""Connected components of a table of links, by alternating star steps.

Each step hangs the neighbours of a vertex on its smallest neighbour; in the end
every vertex hangs on the smallest of its component. Minima are combined before
the shuffle, no list of neighbours is ever built, and each round is written to
the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.session import materialise


def _edges(df: DataFrame) -> DataFrame:
    return df.filter(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component_id)`` for every id that has a link to another one.

    ``component_id`` is the smallest id reachable, itself included. Null ends,
    loops and repeated links change nothing; no links give an empty table.
    """
    pair = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = materialise(_edges(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
                edges.select("v", "v").distinct()
            )
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _edges(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(_edges(moved.unionByName(least.select("u", F.col("m").alias("v")))))
