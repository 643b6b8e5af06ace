"""Both ways of the similarity join against brute force; one scan for any number of questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk.operators import retrieval, vector_join as module
from belegwerk.operators.question_block import QuestionBlock
from belegwerk.operators.vector_join import vector_join
from belegwerk.session import LIMITS, Limits


def tables(spark, questions, chunks):
    q = spark.createDataFrame(questions, "qid long, embedding array<float>")
    c = spark.createDataFrame(chunks, "id long, parent_id long, embedding array<float>")
    return q, c


def brute(questions, chunks, least, k):
    out = []
    for qid, q in questions:
        hits = []
        for key, parent, v in chunks:
            if q is None or v is None or len(q) != len(v) or not np.any(q) or not np.any(v):
                continue
            a, b = np.array(q, np.float32).astype(float), np.array(v, np.float32).astype(float)
            score = round(float(a @ b / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())), 9)
            if score > least:
                hits.append((-score, key, parent))
        out += [(qid, key, parent, -s, n + 1) for n, (s, key, parent) in enumerate(sorted(hits)[:k])]
    return sorted((q, c, p, round(s, 7), r) for q, c, p, s, r in out)


def rows(df):
    return sorted((r.qid, r.chunk_id, r.parent_id, round(r.score, 7), r["rank"]) for r in df.collect())


def some(n, dim, seed, copies=0):
    r = np.random.default_rng(seed)
    out = r.normal(0, 1, (n, dim)).round(1).tolist()
    return out + [out[0]] * copies


@pytest.mark.parametrize("limits", [LIMITS, Limits(rows=7), Limits(rows=1), Limits(bytes=200)])
def test_every_way_gives_the_same(spark, limits):
    questions = list(enumerate(some(25, 8, 1, 5)))
    chunks = [(k, k % 7, v) for k, v in enumerate(some(150, 8, 2, 40))]
    chunks += [(900, 1, None), (901, 1, []), (902, 1, [0.0] * 8), (903, 1, [1.0] * 9)]
    q, c = tables(spark, questions, chunks)
    assert rows(vector_join(q, c, 0.2, 6, limits)) == brute(questions, chunks, 0.2, 6)


def test_odd_questions_in_blocks(spark):
    questions = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0, 3.0]), (6, [2.0, 4.0])]
    chunks = [(1, 1, [1.0, 2.0]), (2, 1, [3.0, 2.0, 1.0]), (3, 2, None), (4, 2, [0.5, 1.0])]
    q, c = tables(spark, questions, chunks)
    assert rows(vector_join(q, c, 0.1, 3, Limits(rows=2))) == brute(questions, chunks, 0.1, 3)
    assert vector_join(q.limit(0), c, 0.1, 3).collect() == []
    assert vector_join(q, c.limit(0), 0.1, 3, Limits(rows=2)).collect() == []


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet")


def test_one_scan_of_the_chunks(spark, tmp_path):
    q, c = tables(spark, list(enumerate(some(300, 8, 5))), [(k, 0, v) for k, v in enumerate(some(400, 8, 6))])
    for name, df in (("q", q), ("c", c)):
        df.write.parquet(str(tmp_path / name))
    q, c = (spark.read.parquet(str(tmp_path / name)) for name in "qc")
    many = vector_join(q, c, 0.3, 5, Limits(rows=10))  # 60 blocks
    assert scans(many) == 2
    assert rows(many) == rows(vector_join(q, c, 0.3, 5))


def test_large_chunks_are_not_copied_for_each_block(spark, tmp_path):
    asked = list(enumerate(some(290, 8, 5))) + [(n, [1.0, float(n)]) for n in range(290, 296)] + [(296, None), (297, []), (298, [0.0] * 8), (298, [1.0] * 8)]
    q, c = tables(spark, asked, [(k, k % 9, v) for k, v in enumerate(some(400, 8, 6) + some(20, 2, 7))])
    c.withColumn("document", F.concat(F.lit("d"), "parent_id")).write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    small = Limits(rows=40, bytes=2400 * 8)  # eight blocks, and chunks beyond what may be copied
    many = vector_join(q, c, 0.3, 5, small)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dim" not in plan and 8 <= scans(many) <= 16
    assert rows(many) == rows(vector_join(q, c, 0.3, 5, Limits(rows=40)))

    def best(limits):
        hits = vector_join(q, c, 0.3, 5, limits, group="document")
        top = hits.groupBy("qid", "parent_id").agg(F.max("score").alias("s")).collect()
        return {n: sorted((-round(r.s, 7), r.parent_id) for r in top if r.qid == n)[:5] for n in range(300)}

    assert best(small) == best(Limits(rows=40))


def test_floor_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "PENDING_HITS", 8)
    scorer_rows = some(500, 4, 9, 30)
    batch_q = np.array(some(3, 4, 8))
    import pyarrow as pa

    unit = batch_q / np.linalg.norm(batch_q, axis=1)[:, None]
    scorer = module._Scorer(unit, pa.array([0, 1, 2]), 0.1, 3)
    table = pa.table({"id": list(range(530)), "parent_id": [0] * 530, "embedding": pa.array(scorer_rows, pa.list_(pa.float32()))})
    out = [h for b in table.to_batches(max_chunksize=25) for h in scorer.feed(b)] + list(scorer.flush())
    found = {}
    for hit in pa.Table.from_batches(out).to_pylist():
        found.setdefault(hit["qid"], []).append((-hit["score"], hit["chunk_id"], hit["parent_id"]))
    got = sorted((q, c, p, round(-s, 7), n + 1) for q, hits in found.items() for n, (s, c, p) in enumerate(sorted(hits)[:3]))
    assert got == brute(list(enumerate(batch_q.tolist())), [(k, 0, v) for k, v in enumerate(scorer_rows)], 0.1, 3)


def test_documents_leave_a_task_at_most_k_times(spark):
    r = np.random.default_rng(4)
    parents = spark.createDataFrame(
        [(p, f"t{p % 23:02}", f"u{p % 3}", "x", None) for p in range(200)], "id long, title string, source_url string, full_text string, summary string"
    )
    chunks = [(k, int(r.integers(200)), v) for k, v in enumerate(some(3000, 6, 7))]
    questions = list(enumerate(some(4, 6, 11)))
    q, c = tables(spark, questions, chunks)
    block = QuestionBlock(q)
    want = {}
    for qid, _, parent, score, _ in brute(questions, chunks, 0.1, 10_000):
        key = (qid, f"t{parent % 23:02}", f"u{parent % 3}")
        want[key] = max(score, want.get(key, 0))
    k = 5
    branch = retrieval.document_vector_branch(q, parents, c, 0.1, k=k)
    got = {(x.qid, x.title, x.source_url): round(x.score, 7) for x in branch.collect()}
    for qid in range(4):
        best = sorted(((-s, t, u) for (q_, t, u), s in want.items() if q_ == qid))[:k]
        found = sorted(((-s, t, u) for (q_, t, u), s in got.items() if q_ == qid))[:k]
        assert found == best
    hits = module.block_hits(block, c.coalesce(3).withColumn("document", F.concat(F.lit("d"), F.col("parent_id") % 23)), 0.1, k, group="document")
    per_task = hits.groupBy("qid", F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task == k
