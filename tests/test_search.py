"""Vector join, keyword ranking and fusion against brute force and fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk.operators import assemble, retrieval
from belegwerk.operators.postings import build_postings, fts_match, fts_rank
from belegwerk.operators.substring import match_terms
from belegwerk.operators.vector_join import vector_join
from belegwerk.operators.vector_lists import build_vector_lists, list_join
from belegwerk.plans import search
from belegwerk.plans.answer import Dialogue, answer_requests
from belegwerk.plans.corpus_build import build_corpus
from belegwerk.session import Limits

QUESTION = "qid long, embedding array<float>"
CHUNK = "id long, parent_id long, embedding array<float>"


def vectors(n, seed, dim=8):
    rows = np.random.default_rng(seed).normal(size=(n, dim))
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)


def brute(questions, chunks, t, k):
    out = {}
    for q, a in enumerate(questions.astype(float)):
        hits = []
        for c, b in enumerate(chunks.astype(float)):
            s = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
            if s > t:
                hits.append((-s, c))
        out[q] = [c for _, c in sorted(hits)[:k]]
    return {q: h for q, h in out.items() if h}


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("limits", [Limits(), Limits(rows=4, bytes=1 << 20)])
def test_vector_join_equals_brute_force(spark, limits):
    q, c = vectors(11, 1), vectors(300, 2)
    c[100:200] = c[0]  # a group of copies that holds a third of all rows
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], QUESTION)
    chunks = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(c)], CHUNK).repartition(5)
    assert ranked(vector_join(questions, chunks, 0.2, 7, limits)) == brute(q, c, 0.2, 7)


def test_vector_join_edges(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], QUESTION)
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [3.0, 4.0]), (3, 1, [0.601, 0.8]), (4, 1, [0.0, 0.0]),
            (5, 1, None), (6, 1, [1.0, 0.0, 0.0]), (7, 1, [2.0, 0.0])]
    chunks = spark.createDataFrame(rows, CHUNK)
    hits = vector_join(questions, chunks, 0.6)
    assert sorted((r.qid, r.chunk_id) for r in hits.collect()) == [(1, 1), (1, 3), (1, 7)]
    nothing = vector_join(questions.filter("qid > 1"), chunks, 0.6, 5)
    assert nothing.count() == 0


def test_lists_are_exact_without_nprobe_and_with_all_lists(spark):
    q, c = vectors(9, 3), vectors(200, 4)
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], QUESTION)
    chunks = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(c)], CHUNK)
    lists = build_vector_lists(chunks, k=12)
    wanted = brute(q, c, 0.5, 5)
    assert ranked(list_join(questions, lists, 0.5, 5)) == wanted
    assert ranked(list_join(questions, lists, 0.5, 5, nprobe=12)) == wanted
    few = ranked(list_join(questions, lists, 0.5, 5, nprobe=1))
    assert all(set(h) <= set(range(200)) for h in few.values())


def cover_density(positions):
    """Brute force over all intervals of matched positions."""
    places = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    covers = []
    for (a, _), (b, _) in itertools.product(places, places):
        if a <= b and all(any(a <= p <= b for p in ps) for ps in positions):
            covers.append((a, b))
    minimal = [c for c in covers
               if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
    score = 0.0
    for a, b in set(minimal):
        matched = sum(a <= p <= b for p, _ in places)
        score += 0.1 / (1 + (b - a) - (matched - 1))
    return round(score, 9)


def test_cover_density_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = np.array(["rot", "blau", "grün", "gelb", "grau", "weiß"])
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 25))) for _ in range(120)]
    texts += ["rot rot rot", "rot blau", "rot grau blau", "blau"]
    asked = ["rot", "rot blau", "gelb blau rot", "grün rot grün", "der die das", "schwarz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(3)
    questions = spark.createDataFrame(list(enumerate(asked)), "qid int, words string")
    index = build_postings(docs, config="stopped")
    got = {(r.qid, r.id): r.score
           for r in fts_rank(questions, index, "words", config="stopped").collect()}
    want = {}
    for q, text in enumerate(asked):
        lex = sorted(set(text.split()) - {"der", "die", "das"})
        for d, doc in enumerate(texts):
            places = [[i + 1 for i, w in enumerate(doc.split()) if w == x] for x in lex]
            if lex and all(places):
                want[q, d] = cover_density(places)
    assert got == pytest.approx(want, abs=1e-8) and got.keys() == want.keys()
    assert got[0, 120] == pytest.approx(0.3) and got[1, 121] == pytest.approx(0.1)
    assert got[1, 122] == pytest.approx(0.05)
    pairs = {(r.qid, r.id) for r in fts_match(questions, index, "words", config="stopped").collect()}
    assert pairs == set(want)


@pytest.mark.parametrize("limits", [Limits(), Limits(rows=2, bytes=1 << 20)])
def test_match_terms(spark, limits):
    texts = ["Ein Haus", "haus und Hof", None, "HOFHUND", ""]
    asked = [["haus"], ["hof", "ein"], [""], ["x"], ["Hof"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    questions = spark.createDataFrame(list(enumerate(asked)), "qid int, terms array<string>")
    got = sorted((r.qid, r.id) for r in match_terms(questions, df, "t", ["id"], limits=limits).collect())
    want = [(q, d) for q, terms in enumerate(asked) for d, t in enumerate(texts)
            if t is not None and any(x.lower() in t.lower() for x in terms)]
    assert got == want


PARENT = "id string, title string, source_url string, full_text string, summary string"


@pytest.fixture(scope="module")
def small(spark):
    parents = spark.createDataFrame([
        ("p1", "rot.txt", "u/rot 1", "rot wie blut", "s1"),
        ("p2", "rot.txt", "u/rot 2", "ein roter Faden", None),
        ("p3", "blau.txt", "u/blau", "blau", "s3"),
    ], PARENT)
    chunks = spark.createDataFrame([
        ("c1", "p1", "rot wie", [1.0, 0.0]), ("c2", "p1", "blut", [0.8, 0.6]),
        ("c3", "p2", "faden", [0.9, 0.1]), ("c4", "p3", "blau", [0.0, 1.0]),
    ], "id string, parent_id string, content string, embedding array<float>")
    return search.Corpus(parents, chunks)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "qid long, question string, embedding array<float>")


def test_keyword_branch_admits_children_of_matching_parents(spark, small):
    rows = search.keyword_search(asked(spark, (1, "rot", [0.0, 0.0])), small).collect()
    assert sorted((r.chunk_id, round(r.score, 6)) for r in rows) == [("c1", 0.1), ("c2", 0.0), ("c3", 0.0)]


def test_hybrid_takes_the_best_score_of_both_branches(spark, small):
    rows = search.hybrid_search(asked(spark, (1, "rot", [1.0, 0.0])), small).orderBy("fused_rank").collect()
    assert [(r.parent_id, r.fused_rank) for r in rows] == [("p1", 1), ("p2", 2)]
    assert rows[0].final_score == 1.0


def test_documents_are_unique_by_title(spark, small):
    found = search.document_search(asked(spark, (1, "rot", [1.0, 0.0])), small).collect()
    assert [(r.pos, r.title, r.url) for r in found] == [(1, "rot.txt", "u/rot%201")]


def test_passages_and_missing_ones(spark, small):
    got = {r.qid: r for r in search.passage_answers(
        asked(spark, (1, "rot", [1.0, 0.0]), (2, "zzz", [0.0, 0.0])), small).collect()}
    assert got[2].context == "Keine relevanten Dokumente gefunden." and got[2].documents == []
    assert got[1].context.startswith("\n### QUELLE: rot.txt\nDOKUMENT-INFO (Zusammenfassung): s1\n")
    assert "(Zusammenfassung): None\n" in got[1].context
    assert [d.title for d in got[1].documents] == ["rot.txt"]


def test_blocks_give_the_same_answers(spark, small):
    questions = asked(spark, *[(i, w, [1.0, 0.0]) for i, w in enumerate("rot blau faden rot".split())])
    whole = search.hybrid_search(questions, small)
    cut = search.hybrid_search(questions, small, search.Settings(limits=Limits(rows=1, bytes=1 << 20)))
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_rerank_keeps_fused_order_on_ties(spark):
    rows = [(1, "rot", f"p{i}", f"t{i}", "u", "rot", None, 1.0 - i / 10, i) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "qid long, question string, parent_id string, title string, "
                                     "source_url string, full_text string, summary string, "
                                     "final_score double, fused_rank int")
    top = assemble.rerank(df).orderBy("pos").collect()
    assert [r.parent_id for r in top] == [f"p{i}" for i in range(1, 7)]


def test_answers_by_route(spark, small):
    requests = spark.createDataFrame([
        (1, "rot?", ""), (2, "Hallo, wie geht es", ""), (3, "Welche Dokumente zu blau", ""),
        (4, "### Task: titel", ""),
    ], "qid long, message string, history string")
    rows = {r.qid: r for r in answer_requests(requests, small, models=Dialogue()).collect()}
    assert [rows[i].intent for i in (1, 2, 3, 4)] == ["RAG", "SMALLTALK", "SEARCH", None]
    assert rows[4].answer == "### Task: titel" and rows[2].references == ""
    assert rows[3].references.endswith("- [blau.txt](u/blau)\n")


def test_hybrid_holds_all_vector_parents(spark):
    docs = spark.createDataFrame(
        [(f"d{i}.txt", f"Der Bericht {i} nennt Funk {i % 7} und Netz {i % 5}. " * 9) for i in range(40)],
        "title string, text string")
    parents, chunks = build_corpus(docs)
    corpus = search.Corpus(parents, chunks)
    questions = spark.createDataFrame([(1, "Funk 3 Bericht"), (2, "Netz 4")], "qid long, question string")
    found = {(r.qid, r.parent_id) for r in search.hybrid_search(questions, corpus).collect()}
    from belegwerk.operators.question_block import prepare_questions

    hits = vector_join(prepare_questions(questions), chunks, search.PASSAGE_MIN_SIMILARITY, 25)
    best = retrieval.best_per_parent(hits)
    again = retrieval.best_per_parent(best.withColumnRenamed("final_score", "score"))
    assert {(r.qid, r.parent_id) for r in best.collect()} <= found
    assert sorted(best.collect()) == sorted(again.collect())


def test_parents_of_many_terms_are_cut_before_the_shuffle(spark):
    rows = [(q, f"p{n:03}", f"c{n:03}") for q in (1, 2, None) for n in range(40) for _ in range(n % 4)] + [(3, "p1", "c1")]
    found = spark.createDataFrame(rows, "qid long, parent_id string, first_chunk string").repartition(4)
    got = retrieval.first_parents(found, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("dense_rank(") < plan.rindex("Exchange") and "hashpartitioning(qid#" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "parent_id" in x.split("hashpartitioning(")[1].split(")")[0]]
    want = [(q, p) for q in (1, 2, None) for p in sorted({p for a, p, _ in rows if a == q})[:5]] + [(3, "p1")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
