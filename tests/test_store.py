"""Commits are whole or nothing; batches, deletion, compaction and lists keep to one state."""

import re

import pytest
from pyspark.sql import functions as F

from belegwerk.operators.vector_join import vector_join
from belegwerk.operators.vector_lists import VectorLists, list_join
from belegwerk.plans import search
from belegwerk.plans.ingest import ingest
from belegwerk.plans.vector_index import index_vectors
from belegwerk.sources import store
from belegwerk.sources.store import (
    TABLES, Snapshot, compact, delete_from_store, read_chunks, read_errors, read_parents, snapshot, vacuum,
)


def documents(spark, *rows):
    return spark.createDataFrame(rows, "title string, text string")


def titles(spark, path):
    return sorted(r.title for r in read_parents(spark, path).select("title").distinct().collect())


def state(spark, path):
    """All rows of all tables but for the names of batches."""
    snap = snapshot(spark, path)
    return {
        t: sorted(map(repr, snap.read(t).drop("batch", "bucket", "created_at", "failed_at").collect()))
        for t in TABLES if t not in ("radii", "centroids")
    }


@pytest.fixture()
def path(spark, tmp_path):
    root = str(tmp_path / "corpus")
    ingest(documents(spark, ("a.txt", "Der Leuchtturm steht am Meer."), ("b.txt", "Ein Boot fährt.")), root, batch="one")
    ingest(documents(spark, ("c.txt", "Noch ein Leuchtturm."), ("d.txt", None)), root, batch="two")
    return root


class Died(Exception):
    pass


@pytest.mark.parametrize("writes", range(8))
def test_a_delete_that_dies_changes_nothing(spark, path, monkeypatch, writes):
    before, left = state(spark, path), [writes]
    real = store._rewrite

    def dying(*args):
        if not left[0]:
            raise Died
        left[0] -= 1
        return real(*args)

    def no_commit(*args):
        raise Died

    monkeypatch.setattr(store, "_rewrite", dying)
    monkeypatch.setattr(Snapshot, "commit", no_commit)
    doomed = documents(spark, ("a.txt", ""), ("c.txt", "")).select("title")
    with pytest.raises(Died):
        delete_from_store(spark, path, doomed)
    assert state(spark, path) == before
    monkeypatch.undo()
    delete_from_store(spark, path, doomed)
    assert titles(spark, path) == ["b.txt"]
    ids = {r.id for r in read_chunks(spark, path).collect()}
    found = state(spark, path)
    assert {r.id for r in snapshot(spark, path).read("postings").collect()} == ids
    assert len(found["families"]) == 1 and {r.title for r in snapshot(spark, path).read("title_postings").collect()} <= {"b.txt"}


def test_an_ingestion_that_dies_shows_nothing(spark, path, monkeypatch):
    before = state(spark, path)

    def no_commit(*args):
        raise Died

    monkeypatch.setattr(Snapshot, "commit", no_commit)
    fresh = documents(spark, ("e.txt", "Neu."), ("f.txt", "Auch neu."))
    with pytest.raises(Died):
        ingest(fresh, path, batch="three")
    assert state(spark, path) == before
    monkeypatch.undo()
    for _ in range(2):  # a repeated batch replaces itself
        ingest(fresh, path, batch="three")
        assert titles(spark, path) == ["a.txt", "b.txt", "c.txt", "e.txt", "f.txt"]
        assert read_chunks(spark, path).count() == 5


def test_readers_keep_their_snapshot(spark, path):
    parents, chunks = read_parents(spark, path), read_chunks(spark, path)
    delete_from_store(spark, path, documents(spark, ("a.txt", "")).select("title"))
    assert parents.count() == 3 and chunks.count() == 3
    assert read_parents(spark, path).count() == 2


def test_failed_documents_leave_the_others_whole(spark, tmp_path):
    root = str(tmp_path / "corpus")

    def model(text):
        return F.when(~F.contains(text, F.lit("kaputt")), F.array(F.lit(1.0).cast("float")))

    ingest(documents(spark, ("x", "gut"), ("y", "kaputt"), ("z", None)), root, embedding_model=model)
    assert titles(spark, root) == ["x"] and read_chunks(spark, root).count() == 1
    assert sorted((r.title, r.error) for r in read_errors(spark, root).collect()) == [("y", "no vector"), ("z", "no text")]
    assert sum(f.rows for f in snapshot(spark, root).of("chunks")) == 1


def test_compaction_keeps_rows_and_results(spark, path):
    for k in range(3):
        ingest(documents(spark, (f"k{k}.txt", f"Leuchtturm {k} mit Licht.")), path, batch=f"k{k}")
    before = state(spark, path)
    asked = documents(spark, ("1", "Leuchtturm"), ("2", "Boot")).toDF("qid", "question")

    def found():
        rows = search.hybrid_search(asked, search.stored_corpus(spark, path)).select("qid", "parent_id", "fused_rank", "final_score")
        return sorted(map(tuple, rows.collect()))

    hits = found()
    assert compact(spark, path) == 5
    assert state(spark, path) == before and found() == hits and len(snapshot(spark, path).of("chunks")) == 1
    assert compact(spark, path) == 0
    ingest(documents(spark, ("k0.txt", "Leuchtturm 0 mit Licht.")), path, batch="k0")  # replayed
    assert titles(spark, path) == ["a.txt", "b.txt", "c.txt", "k0.txt", "k1.txt", "k2.txt"]
    assert vacuum(spark, path) > 10 and found() == hits


def test_two_rewriters_are_noticed(spark, path):
    snap = snapshot(spark, path)
    old = snap.of("parents", ["one"])
    delete_from_store(spark, path, documents(spark, ("a.txt", "")).select("title"))
    with pytest.raises(RuntimeError):
        store._replace(snap, [], old)


def test_empty_corpus(spark, tmp_path):
    root = str(tmp_path / "none")
    assert read_parents(spark, root).count() == 0 and vacuum(spark, root) == 0 and compact(spark, root) == 0
    delete_from_store(spark, root, documents(spark, ("a", "")).select("title"))
    assert VectorLists.stored(snapshot(spark, root)) is None


def clustered(spark, n, dim=16, centers=8, seed=3):
    """Vectors in tight clusters, as documents whose text names a row of a table."""
    import numpy as np

    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (centers, dim))
    table = middle[r.integers(0, centers, n)] + r.normal(0, 0.05, (n, dim))
    return table.astype(float).tolist()


def test_stored_lists_follow_and_prune(spark, tmp_path):
    root, table = str(tmp_path / "corpus"), clustered(spark, 300)

    def model(text):
        return F.expr(f"array({', '.join('array(' + ', '.join(f'{x}f' for x in row) + ')' for row in table)})")[
            F.regexp_extract(text, r"(\d+)", 1).cast("int")
        ]

    def docs(lo, hi):
        return documents(spark, *[(f"t{k}", f"nummer {k}") for k in range(lo, hi)])

    ingest(docs(0, 200), root, embedding_model=model, batch="one")
    index_vectors(spark, root, k=8)
    ingest(docs(200, 300), root, embedding_model=model, batch="two")
    delete_from_store(spark, root, docs(50, 60).select("title"))
    lists = VectorLists.stored(snapshot(spark, root))
    chunks = read_chunks(spark, root)
    assert lists.chunks.count() == chunks.count() == 290
    asked = spark.createDataFrame([(k, table[k]) for k in range(0, 290, 60)], "qid long, embedding array<double>")
    for limits in (search.LIMITS, search.Limits(rows=2)):
        exact = sorted(map(tuple, vector_join(asked, chunks, 0.9, 20, limits).collect()))
        hits = list_join(asked, lists, 0.9, 20, limits=limits)
        assert sorted(map(tuple, hits.collect())) == exact and len(exact) > 60
    one = list_join(asked.limit(1), lists, 0.9, 20)
    plan = one._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[[^\]]*list_id#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert pruned and all(len((some or one_).split(",")) < 4 for some, one_ in pruned)
    index_vectors(spark, root, k=4)
    again = VectorLists.stored(snapshot(spark, root))
    assert len(again.centroids) == 4 and again.chunks.count() == 290
    assert sorted(map(tuple, list_join(asked, again, 0.9, 20).collect())) == exact
