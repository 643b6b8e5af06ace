"""Wildcard terms against regular expressions, alone and through the searches."""

import random
import re

import pytest

from belegwerk.operators.retrieval import document_title_branch
from belegwerk.operators.substring import _Patterns, extents_per_question, lots_of, match_terms
from belegwerk.plans import search
from belegwerk.session import Limits


def brute(term, text):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term)
    return re.search(pattern, text, re.S) is not None


@pytest.mark.parametrize("seed", range(3))
def test_patterns_equal_regular_expressions(seed):
    r = random.Random(seed)
    terms = sorted({"".join(r.choice("ab%_c\\") for _ in range(r.randrange(7))) for _ in range(120)})
    found = _Patterns(terms, True)
    for _ in range(300):
        text = "".join(r.choice("abc\\\n") for _ in range(r.randrange(12)))
        assert found.found(text) == {i for i, t in enumerate(terms) if brute(t, text)}, text


@pytest.mark.parametrize("wildcards", [True, False])
def test_many_texts_are_searched_together(wildcards):
    """Terms may hold the character that stands between texts; no place reaches into a neighbour."""
    r = random.Random(7)
    for letters in ("ab", "ab\0", "abé😀", "abcdefg"):
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(60)] + ["", ""]
        terms = sorted({"".join(r.choice(letters + "%__") for _ in range(r.randrange(6))) for _ in range(60)})
        rows, found = _Patterns(terms, wildcards).pairs(texts)
        expected = [(i, n) for i, x in enumerate(texts) for n, t in enumerate(terms) if (brute(t, x) if wildcards else t in x)]
        assert list(zip(rows.tolist(), found.tolist())) == expected


def test_only_the_longest_piece_of_a_segment_is_searched():
    """Else a place is listed for every character that is a piece of some term."""
    patterns = _Patterns(["l_uchtturm", "m_er", "a_b", "x"], True)
    assert sorted(patterns.finder.keys()) == ["er", "uchtturm"]
    assert patterns.found("am leuchtturm: a b") == {0, 2} and patterns.found("meer, x") == {1, 3}


def test_lots_of_texts():
    assert list(lots_of(["abc", "", "defg", "h" * 20, "i"], 8)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(lots_of([])) == []


def test_without_wildcards_terms_are_literal():
    terms = ["", "10%", "a_b", "%"]
    assert _Patterns(terms, False).found("10% and axb") == {0, 1, 3}


def test_matches_of_questions(spark):
    texts = spark.createDataFrame([(1, "Der Leuchtturm\nam Meer"), (2, "10% RABATT"), (3, None), (4, "")], "id long, full_text string")
    asked = spark.createDataFrame([(1, ["l_uchtt%meer"]), (2, ["10%rab"]), (3, ["%"]), (4, ["meer%turm"]), (5, ["_"]), (6, [])], "qid long, terms array<string>")
    got = sorted(map(tuple, match_terms(asked, texts, "full_text", ["id"], wildcards=True).collect()))
    assert got == [(1, 1), (2, 2), (3, 1), (3, 2), (3, 4), (5, 1), (5, 2)]
    listed = match_terms(asked, texts, "full_text", ["id"], wildcards=True, listed=True)
    assert sorted((r.id, sorted(r.qids)) for r in listed.collect()) == [(1, [1, 3, 5]), (2, [2, 3, 5]), (4, [3])]
    pairs = match_terms(asked, texts, "full_text", ["id"], wildcards=True).selectExpr("qid", "string(id) as id")
    told = [sorted(map(tuple, extents_per_question(df, "id").collect())) for df in (pairs, listed.selectExpr("qids", "string(id) as id"))]
    assert told[0] == told[1] == [(1, 1, "1", "1"), (2, 1, "2", "2"), (3, 3, "1", "4"), (5, 2, "1", "2")]


def test_all_titles_of_a_question_without_a_shuffle_of_pairs(spark):
    parents = spark.createDataFrame(
        [("Fahrplan_2024.txt", "u"), ("Fahrplan_2024.txt", "u"), ("notiz.txt", "u"), ("notiz.txt", None), (None, "u")], "title string, source_url string"
    )
    asked = spark.createDataFrame([(1, ["fahr", "plan", "FAHR"]), (2, ["notiz", "2024", None]), (None, ["txt"]), (3, [])], "qid long, terms array<string>")
    found = document_title_branch(asked, parents, k=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan
    expected = {(1, "Fahrplan_2024.txt", "u"), (2, "Fahrplan_2024.txt", "u"), (2, "notiz.txt", "u"), (2, "notiz.txt", None),
                *((None, t, u) for t, u in (("Fahrplan_2024.txt", "u"), ("notiz.txt", "u"), ("notiz.txt", None)))}
    for rows in (found, document_title_branch(asked, parents, k=None, limits=Limits(rows=1))):
        got = [(r.qid, r.title, r.source_url) for r in rows.collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_settings_reach_both_searches(spark):
    parents = spark.createDataFrame(
        [("p1", "fahrplan_2024.txt", "u", "Abfahrt am Gleis", None), ("p2", "notiz.txt", "u", "Kein Bezug", None)],
        "id string, title string, source_url string, full_text string, summary string",
    )
    chunks = spark.createDataFrame([("c1", "p1", "Abfahrt am Gleis", None), ("c2", "p2", "Kein Bezug", None)], "id string, parent_id string, content string, embedding array<float>")
    asked = spark.createDataFrame([(1, "abf%gleis"), (2, "fahr%2024")], "qid long, question string")
    corpus = search.Corpus(parents, chunks)
    for wild, hits, docs in ((False, [], []), (True, [(1, "c1")], [(2, "fahrplan_2024.txt")])):
        settings = search.Settings(wildcards=wild)
        assert sorted((r.qid, r.chunk_id) for r in search.keyword_search(asked, corpus, settings).collect()) == hits
        assert sorted((r.qid, r.title) for r in search.document_search(asked, corpus, settings).collect()) == docs
