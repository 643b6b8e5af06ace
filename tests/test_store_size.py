"""What an ingestion writes stays small: ids of postings once a stretch, texts not shuffled, no leftovers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from belegwerk.functions.text import Stemmer
from belegwerk.operators import postings, substring
from belegwerk.operators.chunking import first_children, split_children
from belegwerk.plans import ingest as plan
from belegwerk.sources.store import compact, delete_documents, snapshot


def texts(spark, n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghiklmnorstu", k=draw.randint(3, 9))) for _ in range(2000)]
    rows = [(f"{i}.txt", " ".join(draw.choices(words, k=draw.randint(50, 300)))) for i in range(n)]
    return spark.createDataFrame(rows, "title string, text string").repartition(2)


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


@pytest.mark.parametrize("small", [0, 20_000])
def test_postings_take_a_few_bytes_each(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(plan, "SMALL_BATCH", small)
    path = str(tmp_path / "corpus")
    for k in range(2):
        plan.ingest(texts(spark, 300, k).withColumn("title", F.concat(F.lit(f"{k}-"), "title")), path, method="fixed")
    rows = snapshot(spark, path).read("postings").drop("batch")
    before = sorted(map(repr, rows.collect()))
    assert size(f"{path}/postings") < 16 * len(before)  # an id alone has 64
    old = size(f"{path}/postings")
    assert compact(spark, path) == 2
    assert sorted(map(repr, snapshot(spark, path).read("postings").drop("batch").collect())) == before
    assert size(f"{path}/postings") < 2.2 * old  # with the files that no longer count


def test_an_ingestion_leaves_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    made = []

    def kept(df):
        made.append(real(df))
        return made[-1]

    real = plan.materialise
    monkeypatch.setattr(plan, "materialise", kept)
    plan.ingest(texts(spark, 40), str(tmp_path / "corpus"), method="fixed")
    left = [df for df in made if "text" in df.columns and any(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())]
    assert made and not left


def test_one_row_of_each_title(spark):
    rows = [("a", "x"), ("a", "y"), ("a", None), ("b", None), ("b", None), ("c", "z"), (None, "p"), (None, "q"), ("d", None)]
    found = plan.once_each(spark.createDataFrame(rows, "title string, text string").repartition(3))
    first = min("xy", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    null = min("pq", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", first), ("b", None), ("c", "z"), (None, null), ("d", None)], key=repr)


@pytest.mark.parametrize("stretch", [1, 7, 1 << 18])
def test_postings_of_stretches_equal_brute_force(spark, monkeypatch, stretch):
    docs = texts(spark, 12).select(F.col("title").alias("id"), F.col("text").alias("content"))
    docs = docs.unionByName(spark.createDataFrame([("none", None), ("blank", " "), ("stop", "und oder")], "id string, content string"))
    monkeypatch.setattr(postings._Gather.__init__, "__defaults__", (stretch,))
    found = {(r.lexeme, r.id): r.positions for r in postings.build_postings(docs, config="simple").collect()}
    expected = {}
    for r in docs.collect():
        for n, word in enumerate((r.content or "").split(), 1):
            expected.setdefault((word, r.id), []).append(n)
    assert found == expected
    kept = {r.id for r in postings.build_postings(docs).collect()}
    assert not kept & {"none", "blank", "stop"}


def test_a_task_remembers_a_bounded_number_of_words():
    import pyarrow as pa

    stemmer = Stemmer()
    for lo in range(0, 300_000, 10_000):
        stemmer.stem(pa.array([f"wort{n}en" for n in range(lo, lo + 10_000)]))
    assert len(stemmer.known) <= 80_000


def test_only_postings_of_candidates_are_looked_up(spark):
    rows = [(f"t{i}", "rare often" if i == 7 else "often word") for i in range(40)]
    index = postings.build_postings(spark.createDataFrame(rows, "id string, content string"), config="simple")
    rare = index.filter("lexeme = 'rare'").select("id")
    found = postings._of_candidates(index, rare, "id", postings.LIMITS)
    assert sorted((r.id, r.lexeme) for r in found.collect()) == [("t7", "often"), ("t7", "rare")]
    asked = spark.createDataFrame([("q", "often rare"), ("r", "rare"), ("s", "rare word"), ("u", "word often")], "qid string, words string")
    for limits in (postings.LIMITS, postings.Limits(rows=1, bytes=1)):
        hits = {(r.qid, r.id) for r in postings.fts_match(asked, index, "words", config="simple", limits=limits).collect()}
        assert hits == {("q", "t7"), ("r", "t7")} | {("u", f"t{i}") for i in range(40) if i != 7}


def test_the_postings_of_a_text_lie_together(spark):
    docs = texts(spark, 30).select(F.col("title").alias("id"), F.col("text").alias("content")).coalesce(1)
    ids = [r.id for r in postings.build_postings(docs).collect()]
    assert 1 + sum(a != b for a, b in zip(ids, ids[1:])) == len(set(ids)) == 30


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["fixed", "recursive"])
def test_first_chunks_need_no_shuffle(spark, method):
    long = texts(spark, 20).select(F.col("title").alias("id"), F.col("text").alias("full_text"))
    blocks = long.unionByName(spark.createDataFrame([("blank", ""), ("short", "x")], "id string, full_text string"))
    found = first_children(blocks, method)
    assert "hashpartitioning" not in plan_of(found)
    expected = split_children(blocks, method).groupBy("parent_id").agg(F.min("id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert {r.parent_id for r in found.collect()} >= {"short"} and "blank" not in {r.parent_id for r in found.collect()}


@pytest.mark.parametrize("most", [1, 1 << 17])
def test_extents_equal_sorted_minimum(spark, monkeypatch, most):
    draw = random.Random(3)
    rows = [(draw.randrange(40), draw.choice(["a", "B", "ä", "zz", "", "\U0001f600", None])) for _ in range(500)] + [(99, None)]
    pairs = spark.createDataFrame(rows, "qid long, id string").repartition(3)
    monkeypatch.setattr(substring._Extents.__init__, "__defaults__", (most,))
    found = substring.extents_per_question(pairs, "id")
    assert "Sort" not in plan_of(found).split("MapInArrow")[1]
    expected = pairs.groupBy("qid").agg(F.count("*"), F.min("id"), F.max("id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_deleting_a_few_documents_shuffles_no_chunks(spark):
    parents = spark.range(100).selectExpr("string(id) id", "concat(id % 50, '.txt') title")
    chunks = spark.range(500).selectExpr("string(id) id", "string(id % 101) parent_id")
    doomed = spark.createDataFrame([("7.txt",), ("7.txt",), (None,)], "title string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, left = delete_documents(parents, chunks, doomed)
        assert "hashpartitioning" not in plan_of(left) and "hashpartitioning" not in plan_of(kept)
        assert kept.count() == 98 and {r.parent_id for r in left.collect()} == {str(n) for n in range(101)} - {"7", "57"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_postings_of_a_text_are_shuffled_together(spark):
    docs = texts(spark, 30).select(F.col("title").alias("id"), F.col("text").alias("content")).coalesce(2)
    index = postings.build_postings(docs).withColumn("word", F.xxhash64("lexeme"))
    expected = sorted((r.id, r.word, tuple(r.positions)) for r in index.collect())

    def held(rows):
        parts = postings.held_together(rows, "id").groupBy("id").agg(F.collect_list(F.struct("words", "ends", "places")).alias("parts"))
        out = parts.select("id", F.explode(F.expr(postings._HELD)).alias("h")).collect()
        return sorted((r.id, r.h.word, tuple(r.h.positions)) for r in out)

    assert postings.held_together(index, "id").count() == 30
    assert held(index) == expected and held(index.orderBy("lexeme")) == expected
