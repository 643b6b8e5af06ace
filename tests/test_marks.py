"""Deletions that write marks: what they cost, and that readers, compaction and vacuum heed them."""

import os

import pytest
from pyspark.sql import functions as F

from belegwerk.operators.vector_lists import VectorLists
from belegwerk.plans.ingest import ingest
from belegwerk.plans.vector_index import index_vectors
from belegwerk.session import Limits
from belegwerk.sources import store
from belegwerk.sources.store import compact, delete_from_store, listed, read_chunks, read_parents, snapshot, vacuum
from tests.test_store import state, titles


def texts(spark, lo, hi):
    return spark.createDataFrame([(f"{n}.txt", f"Leuchtturm {n} " * (n % 50 + 1)) for n in range(lo, hi)], "title string, text string")


@pytest.fixture()
def path(spark, tmp_path):
    root = str(tmp_path / "corpus")
    ingest(texts(spark, 0, 60), root, batch="one")
    index_vectors(spark, root, k=3)
    ingest(texts(spark, 60, 90), root, batch="two")
    return root


def named(spark, *numbers):
    return spark.createDataFrame([(f"{n}.txt",) for n in numbers] + [(None,)], "title string")


def files(root):
    kept = [os.path.join(at, f) for at, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    return {f for f in kept if "/log/" not in f and "/marks/" not in f}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_deletion_of_a_few_documents_writes_no_batch_anew(spark, path):
    before = files(path)
    delete_from_store(spark, path, named(spark, 3, 4, 70))
    assert files(path) == before
    left = [f"{n}.txt" for n in range(90) if n not in (3, 4, 70)]
    assert titles(spark, path) == sorted(left)
    snap = snapshot(spark, path)
    ids = {r.id for r in snap.read("chunks").collect()}
    assert all({r.id for r in snap.read(t).select("id").collect()} == ids for t in ("postings", "vectors"))
    assert {r.first_chunk for r in snap.read("families").collect()} <= ids
    assert {r.parent_id for r in snap.read("families").collect()} == {r.id for r in snap.read("parents").collect()}
    assert {r.title for r in snap.read("title_postings").collect()} == set(left)
    assert {(f.batch, f.rows) for f in snap.of("parents")} == {("one", 58), ("two", 29)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all("hashpartitioning" not in plan_of(snap.read(t)) for t in store.MARKED_BY)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_title_comes_again_and_goes_again(spark, path):
    delete_from_store(spark, path, named(spark, 3, 4, 70))
    ingest(texts(spark, 2, 5), path, batch="three")
    assert titles(spark, path) == sorted(f"{n}.txt" for n in range(90) if n != 70)
    assert {r.batch for r in read_parents(spark, path).filter("title in ('3.txt', '4.txt')").collect()} == {"three"}
    delete_from_store(spark, path, named(spark, 4, 5))
    assert titles(spark, path) == sorted(f"{n}.txt" for n in range(90) if n not in (4, 5, 70))
    before, rows = state(spark, path), read_chunks(spark, path).count()
    assert compact(spark, path) == 3 and state(spark, path) == before
    assert not any(f.marks for f in snapshot(spark, path).folders) and sum(f.rows for f in snapshot(spark, path).of("chunks")) == rows
    vacuum(spark, path)
    assert state(spark, path) == before and not os.listdir(f"{path}/marks")
    assert compact(spark, path) == 0
    delete_from_store(spark, path, named(spark, 6))
    assert compact(spark, path) == 1 and "6.txt" not in titles(spark, path)


def test_vacuum_leaves_files_that_count_with_marks(spark, path):
    delete_from_store(spark, path, named(spark, 3))
    before, there = state(spark, path), files(path)
    vacuum(spark, path)
    assert state(spark, path) == before and files(path) == there
    delete_from_store(spark, path, named(spark, 4), erase=True)
    vacuum(spark, path)
    assert {r.title for r in spark.read.parquet(f"{path}/parents").filter("batch = 'one'").select("title").collect()} == {
        f"{n}.txt" for n in range(60) if n not in (3, 4)}


@pytest.mark.parametrize("why", ["many", "deletions", "no key", "same hash"])
def test_what_marks_cannot_stand_for_is_rewritten(spark, path, monkeypatch, why):
    if why == "many":
        monkeypatch.setattr(store, "LIMITS", Limits(bytes=1))
    if why == "deletions":
        monkeypatch.setattr(store, "MOST_MARKS", 1)
        delete_from_store(spark, path, named(spark, 7))
    if why == "no key":
        snap = snapshot(spark, path)
        old = snap.of("postings", ["one"])
        new = store.write_batch(path, "postings", snap.read("postings", ["one"]).drop("batch").withColumn("doc", F.lit(None).cast("long")), "one")
        snap.commit([new], old)
    if why == "same hash":
        monkeypatch.setattr(store, "document_key", lambda: F.lit("one"))
    delete_from_store(spark, path, named(spark, 3, 4, 70))
    gone = (3, 4, 70, 7) if why == "deletions" else (3, 4, 70)
    assert titles(spark, path) == sorted(f"{n}.txt" for n in range(90) if n not in gone)
    snap = snapshot(spark, path)
    ids = {r.id for r in snap.read("chunks").collect()}
    assert all({r.id for r in snap.read(t).select("id").collect()} == ids for t in ("postings", "vectors"))
    assert any(not f.marks for f in snap.of("chunks"))


def test_vectors_are_dealt_to_lists_without_a_shuffle(spark, path):
    vectors = VectorLists.stored(snapshot(spark, path)).chunks.repartition(8).drop("batch").localCheckpoint()
    dealt = listed(vectors, 1 << 20, 64)
    assert "Exchange" not in plan_of(dealt) and dealt.rdd.getNumPartitions() == 4
    parts = dealt.select(F.spark_partition_id().alias("p"), "list_id").collect()
    assert all(a.p != b.p or a.list_id <= b.list_id for a, b in zip(parts, parts[1:]))
