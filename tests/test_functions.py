"""Edge cases of terms, lexemes, URLs, dialogue and prompts."""

import hashlib
import re
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk.functions import dialog
from belegwerk.functions.html import html_to_markdown
from belegwerk.functions.prompts import fill_template, summary_prompt, system_prompt
from belegwerk.functions.text import german_stem, german_stop_words, lexemes, search_terms, trim_blanks
from belegwerk.functions.urls import extension, safe_url
from belegwerk.functions.vectors import cosine, hashed_embedding, quantize_half
from belegwerk.operators.models import bisected, column_model
from belegwerk.operators.substring import any_literal, any_term


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize("question, terms", [
    ("", [""]),
    ("Was ist das?", ["was ist das?"]),
    ("Wo?! finde, ich X", ["finde"]),
    ("rot\trot blau", ["rot", "rot", "blau"]),
    ("100% a_b c\\d", ["100%", "a_b", "c\\d"]),
    ("¿rot? (blau)", ["¿rot", "(blau)"]),
])
def test_search_terms(spark, question, terms):
    assert values(column(spark, [question]), search_terms(F.col("x"))) == [terms]


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(german_stop_words()) == StopWordsRemover.loadDefaultStopWords("german")


# Pairs from the published vocabulary of the algorithm.
@pytest.mark.parametrize("word, stem", [
    ("aufeinanderfolgenden", "aufeinanderfolg"), ("aufeinander", "aufeinand"),
    ("kategorien", "kategori"), ("kategorische", "kategor"), ("häuser", "haus"),
    ("bedürfnissen", "bedurfnis"), ("straße", "strass"), ("derbsten", "derb"),
    ("möglichkeit", "moglich"), ("bauer", "bau"), ("ab", "ab"), ("", ""),
])
def test_german_stem(word, stem):
    assert german_stem(word) == stem


def test_lexemes_count_stop_words_as_positions(spark):
    df = column(spark, ["Die Häuser und die Straße"])
    rows = lexemes(df, "x", ["i"], "german").orderBy("pos").collect()
    assert [(r.lexeme, r.pos) for r in rows] == [("haus", 2), ("strass", 5)]
    simple = lexemes(df, "x", ["i"], "simple").orderBy("pos").collect()
    assert [r.lexeme for r in simple] == ["die", "häuser", "und", "die", "straße"]
    with pytest.raises(ValueError):
        lexemes(df, "x", ["i"], "other")


def test_safe_url_equals_quote(spark):
    urls = ["a b/ä*~+#", "https://h/x?a=1&b=%20", "ü ß:/?&=", "plain", "ẞ€😀", "(x)'y'!\"$,;@[]"]
    wanted = [urllib.parse.quote(u, safe=":/?&=") for u in urls]
    assert values(column(spark, urls), safe_url(F.col("x"))) == wanted


def test_extension(spark):
    paths = ["/a/A.PDF", "/a/.pdf", "/a/x.exe", "/a.b/c", "/a/..x.md", "/a/t.tar.gz", "a."]
    assert values(column(spark, paths), extension(F.col("x"))) == [
        ".pdf", "", ".exe", "", ".md", ".gz", "."]


def test_trim_takes_all_blanks(spark):
    assert values(column(spark, [" \n x y\t "]), trim_blanks(F.col("x"))) == ["x y"]


def test_cosine_and_half(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0], [1.0, 0.0]), (1, [3.0, 4.0], [1.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0])],
        "i int, a array<float>, b array<float>")
    assert values(df, cosine(F.col("a"), F.col("b"))) == [1.0, 0.6, None]
    halves = values(df, quantize_half(F.col("a")))
    assert halves[1] == [3.0, 4.0]
    third = column(spark, [[1 / 3]], "array<float>")
    assert values(third, quantize_half(F.col("x"))) == [[float(np.float16(1 / 3))]]


def test_hashed_embedding_counts_buckets_of_md5(spark):
    """Also of texts that are null or empty; in batches, not by an expression of each token."""
    texts = ["ein Text, ein Wort", None, "", "ÄÖ ß x x x", "Wort " * 700, "…"]
    df = column(spark, texts).select(hashed_embedding(F.col("x"), 16).alias("v"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    for text, got in zip(texts, [r.v for r in df.collect()]):
        counts = np.zeros(16)
        for word in re.findall(r"\w+", (text or "").lower()):
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        length = np.sqrt((counts ** 2).sum())
        assert got == (counts / (length or 1)).astype(np.float32).tolist()


def test_hashed_embedding_is_unit_or_zero(spark):
    vectors = values(column(spark, ["ein Text, ein Wort", "..."]), hashed_embedding(F.col("x")))
    assert abs(np.linalg.norm(vectors[0]) - 1) < 1e-6 and not any(vectors[1])


def test_substring_tests(spark):
    df = column(spark, ["Rabatt 10% heute", "a_b", "axb", None, "c\\d"])
    assert values(df, any_literal(F.col("x"), ["10%", "A_B"])) == [True, True, False, None, False]
    assert values(df, any_literal(F.col("x"), ["a_b"], wildcards=True)) == [False, True, True, None, False]
    assert values(df, any_term(F.col("x"), F.array(F.lit("C\\D")), wildcards=True))[4] is True
    assert values(df, any_term(F.col("x"), F.array(F.lit(""))))[:2] == [True, True]


def message(role, content):
    return {"role": role, "content": content}


TURNS = [message("user", "eins"), message("assistant", "zwei ### Referenzen: weg"),
         message("system", " drei "), message("user", "vier"), message("user", "fünf")]


def test_history_and_messages(spark):
    rows = [(i, TURNS[:n]) for i, n in enumerate((0, 1, 2, 5))]
    df = spark.createDataFrame(rows, "i int, x array<struct<role:string,content:string>>")
    assert values(df, dialog.history_text(F.col("x"))) == [
        "", "", "user: eins\n", "assistant: zwei\nsystem: drei\nuser: vier\n"]
    assert values(df, dialog.last_content(F.col("x"))) == ["", "eins", "zwei ### Referenzen: weg", "fünf"]
    sent = values(df, dialog.model_messages(F.lit("S"), F.col("x"), dialog.last_content(F.col("x"))))
    assert [(m.role, m.content) for m in sent[0]] == [("system", "S"), ("user", "")]
    assert [m.role for m in sent[3]] == ["system", "user", "assistant", "assistant", "user", "user"]


def test_request_text(spark):
    asked = ['[{"role":"user","content":"a"},{"role":"user","content":"b"}]', "plain [text", "[]", '"x"']
    assert values(column(spark, asked), dialog.request_text(F.col("x"))) == ["b", "plain [text", "", '"x"']


@pytest.mark.parametrize("reply, intent, query", [
    ("TYPE: SEARCH\nQUERY: a b ", "SEARCH", "a b"),
    ("TYPE: [SEARCH]\nQUERY: a", "RAG", "a"),
    ("TYPE: SMALLTALK TYPE: SEARCH", "SEARCH", "frage"),
    ("TYPE: SMALLTALK\nQUERY: a QUERY: b", "SMALLTALK", "a"),
    (None, "RAG", "frage"),
])
def test_reply(spark, reply, intent, query):
    df = spark.createDataFrame([(reply, "frage")], "reply string, question string")
    row = dialog.read_reply(df, "reply", "question").first()
    assert (row.intent, row.search_query) == (intent, query)


def test_system_task_is_case_sensitive(spark):
    df = column(spark, ["### Task: x", "a concise text", "CONCISE", "frage"])
    assert values(df, dialog.is_system_task(F.col("x"))) == [True, True, False, False]


def test_prompts(spark):
    df = column(spark, ["t" * 20005])
    assert values(df, F.length(summary_prompt(F.col("x"), "<{text}>"))) == [20002]
    filled = fill_template("{a}-{b}-{a}", a=F.lit("1"), b=F.lit(None).cast("string"))
    assert values(df, filled) == ["1--1"]
    kinds = [("SEARCH", 0), ("SEARCH", 2), ("SMALLTALK", 0), ("RAG", 1)]
    frame = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(kinds)], "i int, k string, n int")
    texts = values(frame, system_prompt(
        F.col("k"), F.col("n"), F.lit("ctx"), "none", "some", "talk", "use {context}"))
    assert texts == ["none", "some", "talk", "use ctx"]


def test_html(spark):
    html = ("<html><head><title>t</title></head><body><!-- c --><h1>A &amp; B</h1><script>x</script>"
            "<p>eins<br>zwei</p><ul><li>x</li><li>y</li></ul></body></html>")
    assert values(column(spark, [html]), html_to_markdown(F.col("x"))) == [
        "# A & B\n\neins\nzwei\n\n- x\n- y"]


def test_failing_batches_are_halved(spark):
    calls = []

    def predict(rows):
        calls.append(len(rows))
        if 13 in rows or 40 in rows:
            raise ValueError
        return [2 * r for r in rows]

    assert bisected(predict, list(range(64))) == [None if r in (13, 40) else 2 * r for r in range(64)]
    assert len(calls) < 30
    assert bisected(lambda rows: rows[:-1], [1, 2]) == [None, None] and bisected(predict, []) == []

    def make():
        def score(a, b):
            return [x / y for x, y in zip(a, b)]

        return score

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (3.0, 1.0)], "a double, b double")
    assert [r.s for r in df.select(column_model(make, "double", 2)("a", "b").alias("s")).collect()] == [0.5, None, 3.0]


def test_half_precision_of_odd_vectors(spark):
    given = [[1.0, None, 70000.0], None, [], [1e-8, -2.5]]
    got = values(column(spark, given, "array<float>"), quantize_half(F.col("x")))
    assert got == [[1.0, None, float("inf")], None, [], [0.0, -2.5]]
