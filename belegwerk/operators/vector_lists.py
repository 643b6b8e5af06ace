"""Clustered vector table: lists of near vectors, and joins that read only some of them.

The centroids are fitted once, on a bounded sample; every vector goes to the list of the
nearest one. Stored lists are folders of their own, so a search reads only those it needs.
Each list knows its radius, the widest angle between its centroid and a vector in it: a
question farther from the centroid than the radius plus the angle of the threshold finds
nothing there. That rule keeps the result exact; ``nprobe`` trades it for speed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.fixed_values import VECTOR_LISTS
from belegwerk.operators.question_block import unit_rows
from belegwerk.operators.vector_join import vector_join
from belegwerk.session import LIMITS, Limits

SAMPLE = 100_000  # vectors that the centroids are fitted on
PART = 1 << 16  # vectors of a list that one task compares with a block of questions


@dataclass(frozen=True)
class VectorLists:
    """Chunks with ``list_id``; unit centroids, widest angle and vectors of each list."""

    chunks: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def stored(snap) -> VectorLists | None:
        """The lists of a snapshot of a stored corpus, if it has any.

        Centroids and radii are one row a list and batch, whatever the number of vectors.
        """
        rows = sorted((r.list_id, r.centroid) for r in snap.read("centroids").collect()) if snap.of("centroids") else []
        if not rows:
            return None
        centroids = np.array([c for _, c in rows])
        lists = VectorLists(snap.read("vectors"), centroids, np.zeros(len(rows)), np.zeros(len(rows), np.int64))
        return lists.measured(snap.read("radii"))

    def measured(self, radii: DataFrame) -> VectorLists:
        radius, sizes = self.radius.copy(), self.sizes.copy()
        for r in radii.groupBy("list_id").agg(F.max("radius").alias("radius"), F.sum("vectors").alias("n")).collect():
            radius[r.list_id], sizes[r.list_id] = r.radius, r.n
        return replace(self, radius=radius, sizes=sizes)


def directed(chunks: DataFrame) -> DataFrame:
    """Chunks whose vector has a direction; the others match nothing."""
    length = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return chunks.filter((F.size("embedding") > 0) & (length > 0) & (length < float("inf")))


def fit_centroids(
    chunks: DataFrame, k: int = VECTOR_LISTS, seed: int = 1, iterations: int = 10, sample: int = SAMPLE
) -> np.ndarray:
    """Unit centroids, fitted by cosine on about ``sample`` vectors drawn by hash."""
    usable = directed(chunks).select("id", "embedding")
    total = usable.count()
    if total > sample:
        usable = usable.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)) < sample)
    features = usable.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=iterations).fit(features)
    centers = np.array(model.clusterCenters())
    return centers / np.linalg.norm(centers, axis=1)[:, None]


def assign_lists(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, parent_id, embedding[, document], list_id)``: every vector in the list of its nearest centroid.

    One pass over the vectors, no shuffle; vectors without direction belong to no list.
    """
    kept = [c for c in ("id", "parent_id", "embedding", "document") if c in chunks.columns]
    schema = T.StructType([chunks.schema[c] for c in kept]).add("list_id", T.IntegerType())
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = unit_rows(batch.column("embedding"), dim)
            nearest = (rows @ centroids.T).argmax(1).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
            yield batch.append_column("list_id", pa.array(nearest))

    narrow = directed(chunks).filter(F.size("embedding") == dim)
    return narrow.select(kept).mapInArrow(run, schema)


def radii_of(listed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(list_id, radius, vectors)`` of chunks with their lists; reduced in the tasks."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosine, count = np.full(len(centroids), 2.0), np.zeros(len(centroids), np.int64)
        for batch in batches:
            rows, _ = unit_rows(batch.column("embedding"), dim)
            own = batch.column("list_id").to_numpy()
            np.minimum.at(cosine, own, (rows * centroids[own]).sum(1))
            count += np.bincount(own, minlength=len(centroids))
        some = np.flatnonzero(count)
        angle = np.arccos(np.clip(cosine[some], -1.0, 1.0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(angle), pa.array(count[some])], ["list_id", "radius", "vectors"]
        )

    found = listed.select("embedding", "list_id").mapInArrow(run, "list_id int, radius double, vectors long")
    return found.groupBy("list_id").agg(F.max("radius").alias("radius"), F.sum("vectors").alias("vectors"))


def build_vector_lists(
    chunks: DataFrame, k: int = VECTOR_LISTS, seed: int = 1, iterations: int = 10
) -> VectorLists:
    """Cluster chunk vectors by cosine, without storing them; see ``plans.vector_index``."""
    centroids = fit_centroids(chunks, k, seed, iterations)
    listed = assign_lists(chunks, centroids)
    lists = VectorLists(listed, centroids, np.zeros(len(centroids)), np.zeros(len(centroids), np.int64))
    return lists.measured(radii_of(listed, centroids))


def nearest_lists(lists: VectorLists, nprobe: int) -> Callable[[np.ndarray], dict]:
    """Route every question to its ``nprobe`` nearest lists (approximate)."""
    centroids = lists.centroids

    def route(questions: np.ndarray) -> dict[int, np.ndarray]:
        near = questions @ centroids.T
        place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
        return {i: place[:, i] < nprobe for i in range(near.shape[1])}

    return route


def reachable_lists(lists: VectorLists, min_similarity: float) -> Callable[[np.ndarray], dict]:
    """Route every question to all lists that can hold a hit (exact).

    A vector in a list lies within the list's radius of its centroid, so its
    angle to the question is at least the centroid's angle less the radius.
    """
    limit = np.arccos(np.clip(min_similarity, -1.0, 1.0))
    centroids, radius, sizes = lists.centroids, lists.radius, lists.sizes

    def route(questions: np.ndarray) -> dict[int, np.ndarray]:
        angle = np.arccos(np.clip(questions @ centroids.T, -1.0, 1.0))
        return {i: angle[:, i] - radius[i] <= limit + 1e-6 for i in range(angle.shape[1]) if sizes[i]}

    return route


def _routed(route: Callable[[np.ndarray], dict], dim: int, vector: Column) -> Column:
    """``array<int>``: the lists that each question goes to."""

    def run(vectors: pa.Array) -> pa.Array:
        out: list[list[int]] = [[] for _ in range(len(vectors))]
        fits = [k for k, v in enumerate(vectors.to_pylist()) if v is not None and len(v) == dim]
        if fits:
            rows, good = unit_rows(vectors.take(pa.array(fits)), dim)
            for v, asked in route(rows).items():
                for k in np.flatnonzero(asked & good).tolist():
                    out[fits[k]].append(v)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(vector)


def list_join(
    questions: DataFrame, lists: VectorLists, min_similarity: float, k: int | None,
    nprobe: int | None = None, limits: Limits = LIMITS, group: str | None = None,
) -> DataFrame:
    """``vector_join`` over a clustered table.

    With ``nprobe`` only the nearest lists are read; without it all lists that
    the threshold cannot rule out, which gives the exact result. A table of questions beyond
    the limits meets the lists by key, large lists in parts.
    """
    if nprobe is None:
        route = reachable_lists(lists, min_similarity)
    else:
        route = nearest_lists(lists, nprobe)
    parts = F.array(*[F.lit(max(1, -(-int(n) // PART))) for n in lists.sizes])
    shards = [
        _routed(route, lists.centroids.shape[1], F.col("embedding")), F.col("list_id"),
        F.element_at(parts, F.col("shard") + 1),
    ]
    return vector_join(questions, lists.chunks, min_similarity, k, limits, route, shards, group)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: hits of the exact join, and how many of them were found."""
    keys = found.select("qid", "chunk_id").withColumn("hit", F.lit(1))
    return exact.join(keys, ["qid", "chunk_id"], "left").agg(
        F.count("*").alias("expected"), F.count("hit").alias("found")
    )
