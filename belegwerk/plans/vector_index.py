"""The stored vector lists of a corpus: fitted once, kept up by ingestion and deletion."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from belegwerk.fixed_values import VECTOR_LISTS
from belegwerk.operators.vector_lists import SAMPLE, assign_lists, fit_centroids, radii_of
from belegwerk.sources.store import CENTROIDS, Folder, Snapshot, listed, snapshot, write_batch


def index_vectors(
    spark: SparkSession, path: str, k: int = VECTOR_LISTS, seed: int = 1, iterations: int = 10, sample: int = SAMPLE
) -> None:
    """Cluster the vectors of the corpus at ``path`` into lists and store them.

    Centroids are fitted on at most about ``sample`` vectors; every vector is in a list.
    From then on each ingested batch is dealt to the same lists. Calling it again fits
    anew and replaces all lists, in one commit.
    """
    snap = snapshot(spark, path)
    centroids = fit_centroids(snap.read("chunks"), k, seed, iterations, sample)
    table = _frame(spark, centroids)
    added = [write_batch(path, "centroids", table.coalesce(1), f"fit-{uuid.uuid4().hex}")]
    for batch in sorted(snap.batches()):  # batches, not documents; compact joins small ones
        rows = sum(f.rows for f in snap.of("chunks", [batch]))
        found = assign_lists(snap.read("chunks", [batch]), centroids)
        folder = write_batch(path, "vectors", listed(found, rows, centroids.shape[1]), batch)
        vectors = Snapshot(spark, path, (folder,)).read("vectors")
        added += [folder, write_batch(path, "radii", radii_of(vectors, centroids), batch)]
    removed: list[Folder] = [f for t in ("centroids", "vectors", "radii") for f in snap.of(t)]
    snap.commit(added, removed)


def _frame(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], CENTROIDS)
