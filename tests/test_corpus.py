"""Chunking, sources, ingestion, integrity, streams."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.operators.chunking import fixed_chunks, recursive_chunks, split_text
from belegwerk.operators.integrity import validate_corpus
from belegwerk.operators.metrics import RunMetrics
from belegwerk.operators.models import batch_model, lead_summary, summarise, text_model
from belegwerk.plans import search
from belegwerk.plans.ingest import ingest
from belegwerk.sources.files import list_sources, read_documents, stream_sources
from belegwerk.sources.store import delete_documents, read_chunks, read_errors, read_parents
from belegwerk.streaming.ingest import stream_ingest
from belegwerk.streaming.questions import stream_questions


@given(st.text(alphabet="ab c\n.", max_size=400), st.integers(5, 40), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_recursive_split_invariants(pattern, size, overlap):
    # Every visible character occurs once, so that a chunk has one place.
    text = "".join(c if c.isspace() else chr(0x4E00 + i) for i, c in enumerate(pattern))
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    spans = [(text.find(c), text.find(c) + len(c)) for c in chunks]
    assert all(lo >= 0 for lo, _ in spans) and spans == sorted(spans)
    covered = {i for lo, hi in spans for i in range(lo, hi)}
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered
    assert all(a[1] - b[0] <= overlap for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("text, chunks", [
    ("", []), ("\n\n\n", []), ("kurz", ["kurz"]),
    ("abcdefghijklmnop", ["abcdefghij", "ijklmnop"]),
    ("aaa bbb ccc ddd", ["aaa bbb", "ccc ddd"]),
    ("eins\n\nzwei drei vier", ["eins", "zwei drei", "vier"]),
])
def test_recursive_split(text, chunks):
    assert split_text(text, 10, 2) == chunks


def test_chunk_columns(spark):
    df = spark.createDataFrame([("abcdefghijkl",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(fixed_chunks(F.col("t"), 5, 2)).collect()] == [
        ["abcde", "defgh", "ghijk", "jkl"], [], []]
    assert [r[0] for r in df.select(recursive_chunks(F.col("t"), 20, 2)).collect()] == [
        ["abcdefghijkl"], [], None]


def test_models(spark):
    def double():
        return lambda x: np.asarray(x, dtype=np.float64) * 2

    df = spark.createDataFrame([("gut",), ("schlecht",)], "t string")
    doubled = batch_model(double, T.DoubleType())
    assert [r[0] for r in df.select(doubled(F.length("t").cast("double"))).collect()] == [6.0, 16.0]

    def fragile():
        def predict(texts):
            if "schlecht" in texts:
                raise RuntimeError("no answer")
            return [t.upper() + " " for t in texts]

        return predict

    got = [r[0] for r in df.select(summarise(F.col("t"), text_model(fragile))).collect()]
    assert got == ["GUT", "Keine Zusammenfassung verfügbar."]
    assert df.select(lead_summary(F.lit(" A. B! C? D."))).first()[0] == "A. B! C?"


def test_folder_to_corpus(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "corpus")
    folder.mkdir()
    for name, text in (("a.TXT", "Alpha Text."), ("b c.html", "<p>Beta</p>"), (".pdf", "x"),
                       ("x.exe", "x"), ("d.pdf", "%PDF")):
        (folder / name).write_text(text)
    files = list_sources(spark, str(folder))
    assert sorted(r.filename for r in files.collect()) == ["a.TXT", "b c.html", "d.pdf"]
    ingest(read_documents(files), path)
    parents = read_parents(spark, path)
    assert sorted((r.title, r.full_text) for r in parents.collect()) == [
        ("a.TXT", "Alpha Text."), ("b c.html", "Beta")]
    errors = read_errors(spark, path).collect()
    assert [(r.title, r.error) for r in errors] == [("d.pdf", "no text")]
    # Known names stay as they are, whatever they now hold; new ones come in.
    (folder / "a.TXT").write_text("anderer Text")
    (folder / "e.md").write_text("Neu")
    ingest(read_documents(list_sources(spark, str(folder))), path)
    assert sorted(r.full_text for r in read_parents(spark, path).collect()) == ["Alpha Text.", "Beta", "Neu"]


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "title string, text string")


def test_ingest_is_whole_or_not_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "c")
    given_docs = docs(spark, ("a", "eins zwei"), ("a", "eins zwei"), ("b", "kaputt"))

    def model(text):
        return F.when(~text.contains("kaputt"), F.array(F.lit(1.0).cast("float")))

    for _ in range(2):
        ingest(given_docs, path, embedding_model=model, batch="one")
    assert [r.title for r in read_parents(spark, path).collect()] == ["a"]
    assert read_chunks(spark, path).count() == 1
    ingest(given_docs, path, embedding_model=model, batch="two")
    assert read_parents(spark, path).count() == 1


def test_integrity_and_delete(spark):
    parents = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p2", "b")], "id string, title string")
    chunks = spark.createDataFrame(
        [("c1", "p1", [1.0]), ("c2", "p9", [1.0, 2.0]), ("c3", "p2", [1.0])],
        "id string, parent_id string, embedding array<float>")
    found = {(r.rule, r.id) for r in validate_corpus(parents, chunks, 1).collect()}
    assert found == {("parent id repeated", "p2"), ("chunk without parent", "c2"), ("vector length", "c2")}
    left, kept = delete_documents(parents, chunks, spark.createDataFrame([("b",)], "title string"))
    assert [r.id for r in left.collect()] == ["p1"]
    assert sorted(r.id for r in kept.collect()) == ["c1", "c2"]


def test_streams_equal_batches(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "corpus")
    folder.mkdir()
    for step, names in enumerate((("a.txt", "b.txt"), ("c.txt",))):
        for n in names:
            (folder / n).write_text(f"Text {n} über Funk. " * 30)
        stream = read_documents(stream_sources(spark, str(folder)))
        stream_ingest(stream, path, str(tmp_path / "cp")).awaitTermination()
    other = str(tmp_path / "batch")
    ingest(read_documents(list_sources(spark, str(folder))), other)

    def ids(p):
        return (sorted(r.id for r in read_parents(spark, p).collect()),
                sorted(r.id for r in read_chunks(spark, p).collect()))

    assert ids(path) == ids(other)

    questions = tmp_path / "q"
    asked = spark.createDataFrame([(1, "Funk"), (2, "a.txt")], "qid long, question string")
    asked.write.parquet(str(questions))
    corpus = search.Corpus(read_parents(spark, path), read_chunks(spark, path))
    stream_questions(
        spark.readStream.schema(asked.schema).parquet(str(questions)),
        lambda q: search.document_search(q, corpus), str(tmp_path / "out"), str(tmp_path / "cp2"),
    ).awaitTermination()
    columns = ["qid", "pos", "title", "url", "score"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    assert sorted(streamed) == sorted(search.document_search(asked, corpus).select(columns).collect())


def test_run_metrics(spark):
    metrics = RunMetrics("r")
    metrics.stage("s", spark.range(7), lambda df: df.write.format("noop").mode("overwrite").save())
    row = metrics.frame(spark).first()
    assert (row.run, row.stage, row.rows) == ("r", "s", 7) and row.seconds > 0
