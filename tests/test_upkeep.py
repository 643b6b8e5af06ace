"""The stored index follows ingestion and deletion; writers do not disturb each other."""

from pyspark.sql import functions as F

from belegwerk.functions.html import html_to_markdown
from belegwerk.plans import search
from belegwerk.plans.ingest import ingest
from belegwerk.sources.store import delete_from_store, read_chunks, read_parents, read_postings
from belegwerk.streaming.ingest import stream_ingest


def documents(spark, *rows):
    return spark.createDataFrame(rows, "title string, text string")


def titles(spark, path):
    return sorted(r.title for r in read_parents(spark, path).select("title").distinct().collect())


def test_two_streams_into_one_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    for name in ("a", "b"):
        source = str(tmp_path / name)
        documents(spark, (f"{name}.txt", f"Text {name} über Funk.")).write.parquet(source)
        stream = spark.readStream.schema("title string, text string").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            stream_ingest(stream, path, str(tmp_path / f"cp-{name}")).awaitTermination()
    assert titles(spark, path) == ["a.txt", "b.txt"]
    assert read_chunks(spark, path).count() == 2


def found(spark, path, word):
    corpus = search.Corpus(
        read_parents(spark, path), read_chunks(spark, path), read_postings(spark, path)
    )
    asked = spark.createDataFrame([(1, word)], "qid long, question string")
    rows = search.hybrid_search(asked, corpus)
    return sorted((r.title, round(r.final_score, 6)) for r in rows.filter(F.col("final_score") > 0).collect())


def test_postings_follow_ingestion_and_deletion(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert read_postings(spark, path).count() == 0
    ingest(documents(spark, ("a.txt", "Der Leuchtturm steht."), ("b.txt", "Ein Boot.")), path)
    first = found(spark, path, "Leuchtturm")
    ingest(documents(spark, ("c.txt", "Noch ein Leuchtturm."), ("d.txt", None)), path)
    both = found(spark, path, "Leuchtturm")
    assert [t for t, _ in first] == ["a.txt"] and [t for t, _ in both] == ["a.txt", "c.txt"]
    assert {s for _, s in both} == {s for _, s in first}
    later = read_parents(spark, path).filter("title = 'c.txt'").first().batch

    def files():
        rows = read_chunks(spark, path).filter(F.col("batch") == later)
        return rows.select(F.input_file_name().alias("f")).distinct().collect()

    before = files()
    delete_from_store(spark, path, documents(spark, ("a.txt", "")).select("title"))
    assert titles(spark, path) == ["b.txt", "c.txt"]
    assert [t for t, _ in found(spark, path, "Leuchtturm")] == ["c.txt"]
    assert files() == before
    chunk_ids = {r.id for r in read_chunks(spark, path).collect()}
    assert {r.id for r in read_postings(spark, path).collect()} == chunk_ids


def test_of_equal_titles_a_fixed_one_goes_in(spark, tmp_path):
    texts = ["eins zwei", "drei vier", None]
    kept = set()
    for n, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 0, 1])):
        path = str(tmp_path / str(n))
        ingest(documents(spark, *[("x.txt", texts[k]) for k in order]), path)
        kept |= {r.full_text for r in read_parents(spark, path).collect()}
    assert len(kept) == 1 and None not in kept


def test_html_heads_and_entities(spark):
    cases = {
        "<head><script>x</script><title>Titel</title></head><p>Text</p>": "Text",
        "<style>a</style><p>M&uuml;ller &#8211; Stra&szlig;e &amp; &#x263A;</p>": "Müller – Straße & ☺",
        "<p>a&nbsp;b &amp;lt; &lt;c&gt;</p>": "a b &lt; <c>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    got = {r.html: r.md for r in df.select("html", html_to_markdown(F.col("html")).alias("md")).collect()}
    assert got == cases
