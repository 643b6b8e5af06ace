"""What a worker holds of the texts: small slices of small batches."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from belegwerk.llm import quality, repeats, toxicity
from belegwerk.llm.arrow_text import slices
from belegwerk.llm.hashing import _POWERS
from belegwerk.llm.labelled import with_text_column
from belegwerk.llm.shingles import shingle_sets
from belegwerk.session import ARROW_BYTES, SMALL_BATCH, SPARK_BATCH, large_batches, small_batches

LINE = "The river ran past 12 old stone houses, while children sang about rain. "


def tag(body, at):
    t = toxicity.tokenize(body, at)
    toxicity.Field().marginals(t.features, toxicity.Chains(t.first, len(t.row)))


@pytest.mark.parametrize("work", [quality.measure, tag, shingle_sets])
def test_a_slice_takes_few_megabytes(work):
    texts = pa.array([LINE * 40] * 1000)
    _POWERS.clear()
    tracemalloc.start()
    for _, _, body, at in slices(texts):
        work(body, at)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6


def test_measures_do_not_depend_on_slices():
    texts = pa.array([None, "", *(LINE * (k % 50) for k in range(600)), LINE * 9000, "x"])
    parts = [np.concatenate([quality.measure(b, at) for _, _, b, at in slices(texts, n)]) for n in (1 << 20, 1 << 18)]
    assert (parts[0] == parts[1]).all()


@pytest.fixture
def default(spark):
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, SPARK_BATCH)
    yield spark
    spark.conf.set(ARROW_BYTES, before)


def test_texts_reach_a_worker_in_small_batches(default):
    docs = default.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(LINE), 60).alias("text"))
    seen = with_text_column(docs, "n", "long", lambda texts: pa.array([len(texts)] * len(texts)))
    assert seen.agg(F.max("n")).first()[0] * len(LINE) * 60 < 3e6
    assert seen.count() == 3000


def test_a_size_that_was_set_stays(default):
    default.conf.set(ARROW_BYTES, "5000000b")
    small_batches(default)
    with large_batches(default):
        assert default.conf.get(ARROW_BYTES) == "5000000b"
    assert default.conf.get(ARROW_BYTES) == "5000000b"


def test_repeats_work_on_large_batches(default, monkeypatch):
    small_batches(default)
    during = []
    kept = repeats.materialise
    monkeypatch.setattr(repeats, "materialise", lambda df: during.append(default.conf.get(ARROW_BYTES)) or kept(df))
    docs = default.createDataFrame([(1, LINE), (2, LINE + "More.")], "doc_id long, text string")
    assert [r.text for r in repeats.without_repeats(docs).orderBy("doc_id").collect()] == [LINE, "More."]
    assert set(during) == {SPARK_BATCH}
    assert default.conf.get(ARROW_BYTES) == SMALL_BATCH
