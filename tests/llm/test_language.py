"""Viterbi against all labellings, words against regular expressions, and held-out accuracy."""

import itertools

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from belegwerk.llm import language
from belegwerk.llm.scripts import SCRIPTS, words_of

TEXTS = [
    "", " \n", "123 $%", "One two", "étaient naïve Straße", "нет да yes", "mixедword", "漢字かな交じり文 と english", "éa ́b",
    "नमस्ते दुनिया", "́start", "ไทย", "𝔘𝔫𝔦 x", "don't stop-it", "Ünïcodë", "áбв",
]
# Letters of one script with their marks; a mark without a letter before it is no word.
PATTERN = regex.compile(r"\p{L}\p{M}*")


def slow_words(text):
    table = language.words_of.__globals__["tables"]()
    out = []
    for m in PATTERN.finditer(text):
        script = int(table.script[ord(m.group()[0])])
        if out and out[-1][1] == m.start() and out[-1][2] == script and not table.unspaced[script]:
            out[-1] = (out[-1][0], m.end(), script)
        else:
            out.append((m.start(), m.end(), script))
    return out


def test_words():
    raw = [t.encode() for t in TEXTS]
    at = np.cumsum([0, *map(len, raw)])
    found = words_of(np.frombuffer(b"".join(raw), np.uint8), at)
    for k, text in enumerate(TEXTS):
        own = found.row == k
        got = list(zip((found.starts[own] - found.at[k]).tolist(), (found.ends[own] - found.at[k]).tolist(), found.script[own].tolist()))
        assert got == slow_words(text), text
        assert found.letters[own].sum() == len(regex.findall(r"\p{L}", text))


def total(scores, labels, penalty):
    return sum(scores[i, k] for i, k in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_viterbi_finds_the_best_labelling(block):
    r = np.random.default_rng(block)
    sizes = [1, 7, 3, 2, 6, 1]
    first = np.cumsum([0, *sizes])[:-1]
    for penalty in (0.0, 0.7, 5.0):
        scores = r.normal(0, 1, (sum(sizes), 3))
        got = language.viterbi(scores, first, penalty, block)
        for a, n in zip(first, sizes):
            own = scores[a:a + n]
            best = max(itertools.product(range(3), repeat=n), key=lambda x: total(own, x, penalty))
            assert total(own, got[a:a + n], penalty) == pytest.approx(total(own, best, penalty))


def test_blocks_change_nothing():
    r = np.random.default_rng(9)
    first = np.array([0, 900, 901])
    scores = r.normal(0, 1, (4000, 4))
    want = language.viterbi(scores, first, 2.0, 10_000)
    for block in (1, 17, 512):
        assert (language.viterbi(scores, first, 2.0, block) == want).all()


GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft durch die straße nach hause zurück"
ENGLISH = "the quick brown fox jumps over the lazy dog and runs along that street back home with other things"
RUSSIAN = "быстрая лиса прыгает через ленивую собаку и бежит по улице домой вместе со всеми"


def learnable(n):
    r = np.random.default_rng(1)
    out = []
    for k in range(n):
        for j, (lang, text) in enumerate((("de", GERMAN), ("en", ENGLISH), ("ru", RUSSIAN))):
            out.append((1000 + 3 * k + j, " ".join(r.choice(text.split(), 40)), lang))
    return out


def test_edge_cases_and_spans(spark):
    mixed = f"{GERMAN} {ENGLISH}. {RUSSIAN}"
    rows = [
        (None, GERMAN, "en"), (1, None, "de"), (2, "", None), (3, "12 !", "de"), (4, GERMAN, None), (4, GERMAN, None), (5, mixed, None),
        (6, "漢字", None), (7, ENGLISH + " " + ENGLISH * 3000, None), (8, "слово", None), (9, "\x00 the dog", None),
    ]
    docs = spark.createDataFrame(rows + learnable(60), "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "1 as score", "'x' as lang_pred", "2 as n", "3 as code")
    found = language.classify(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and not any(by_id[k].score or by_id[k].spans for k in (1, 2, 3))
    assert [by_id[k].lang_pred for k in (None, 4, 7, 8, 9)] == ["de", "de", "en", "ru", "en"]
    assert by_id[6].lang_pred in ("de", "en", "ru") and len([r for r in found if r.doc_id == 4]) == 2
    assert [(s.lang, mixed[s.begin:s.end]) for s in by_id[5].spans] == [("de", GERMAN), ("en", ENGLISH), ("ru", RUSSIAN)]
    for key, _, lang in learnable(60):
        assert by_id[key].lang_pred == lang


def test_nothing_learned_and_empty(spark):
    kind = "doc_id long, text string, lang string"
    assert [tuple(r)[2:] for r in language.classify(spark.createDataFrame([(1, "abc", None)], kind)).collect()] == [("und", 0.0, [])]
    assert language.classify(spark.createDataFrame([], kind)).collect() == []


def test_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    hit = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.98
    # Held-out labels change nothing.
    other = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert other.filter("lang = 'zz'").count() > 100
    a = language.classify(docs).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
    assert a == language.classify(other).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
    assert len(SCRIPTS) < 60
