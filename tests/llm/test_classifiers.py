"""The field against all tag sequences, the ranking, and held-out accuracy of both classifiers."""

import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from belegwerk.llm import quality, queries, toxicity
from belegwerk.llm.labelled import held_out, logistic, training_sample
from belegwerk.llm.toxicity import Chains, Field

SF = "/root/testdata/sf0.01"
WORDS = "the river ran past old stone houses while children sang about summer rain and bread".split()
ROWS = [
    (None, "idiot went home", 1), (1, None, None), (2, "", None), (3, "x", 1), (3, "x", 1), (4, "idiot " * 60_000, None),
    (5, "é idiot é. ퟿!", None), (6, "idiot\x00idiot", None), (7, " \n\t", None),
]


def labelled(n):
    """Documents of which every third says ``idiot`` somewhere, with labels."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(100, 100 + n):
        said = [" ".join(r.choice(WORDS, 8)) for _ in range(3)]
        if k % 3 == 0:
            said[int(r.integers(3))] += " idiot " + str(r.choice(WORDS))
        rows.append((k, ". ".join(said) + ".", int(k % 3 == 0)))
    return rows


def brute_marginals(model, scores):
    """Chance of the toxic state of each word, over all tag sequences."""
    total, toxic = 0.0, np.zeros(len(scores))
    for tags in itertools.product((0, 1), repeat=len(scores)):
        z = sum(s for s, t in zip(scores, tags) if t) + model.start * tags[0]
        z += sum(model.moves[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(z)
        toxic += np.exp(z) * np.array(tags)
    return toxic / total


def test_marginals_equal_the_sum_over_all_sequences():
    r = np.random.default_rng(1)
    model = Field(r.normal(0, 1, 1 << toxicity.BITS), r.normal(0, 1, (2, 2)), 0.7)
    lengths = [1, 6, 3, 8, 1, 2]
    first = np.cumsum([0, *lengths])[:-1]
    features = r.integers(0, 1 << toxicity.BITS, (sum(lengths), 7))
    got = model.marginals(features, Chains(first, sum(lengths)))
    for at, n in zip(first, lengths):
        np.testing.assert_allclose(got[at:at + n], brute_marginals(model, model.weights[features[at:at + n]].sum(1)), rtol=1e-9)


def test_training_finds_the_tagged_feature():
    r = np.random.default_rng(2)
    features = r.integers(0, 1000, (400, 7))
    tags = (r.random(400) < 0.1).astype(np.int64)
    features[:, 0] = np.where(tags == 1, 5000, features[:, 0])
    first = np.arange(0, 400, 8)
    p = toxicity.train(features, tags, first).marginals(features, Chains(first, 400))
    assert (p[tags == 1] > 0.5).all() and (p[tags == 0] < 0.5).all()
    assert not toxicity.train(features, tags * 0, first).marginals(features, Chains(first, 400)).max() > 0.1


def tables(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr(
        "*", "1 as label", "'x' as score", "2 as highest", "3 as x", "4 as toxic"
    )
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, toxic int, quality int")
    return docs, labels.selectExpr("*", "'t' as text", "1 as label")


def test_toxic_edge_cases(spark):
    docs, labels = tables(spark, ROWS + labelled(300))
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert len([r for r in got if r.doc_id == 3]) == 2
    assert all(by_id[k].score == by_id[2].score and not by_id[k].spans and not by_id[k].predicted for k in (1, 2, 7))
    for key, text, _ in labelled(300):
        assert [text[s.begin:s.end] for s in by_id[key].spans] == (["idiot"] if key % 3 == 0 else []), text
        assert by_id[key].predicted == (key % 3 == 0)
    assert by_id[4].predicted and by_id[5].predicted and [(s.begin, s.end) for s in by_id[5].spans] == [(2, 7)]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_quality_edge_cases(spark):
    good = [(k, "The river ran past. " + text, 1) for k, text, y in labelled(200) if not y]
    bad = [(k + 5000, "$$ BUY NOW!!! " * (3 + k % 5), 0) for k, _, y in labelled(200) if y]
    rows = [(r[0], r[1], None) for r in ROWS] + good + bad
    docs, labels = tables(spark, rows)
    docs = docs.drop("score")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].score == by_id[2].score
    assert all(by_id[r[0]].predicted == r[2] for r in good + bad)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in got if r.predicted)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_empty_tables_and_one_class(spark, module, label):
    docs, labels = tables(spark, [(k, t, 0) for k, t, _ in labelled(6)])
    docs = docs.drop("score")
    assert module.classify(docs.limit(0), labels).collect() == []
    for known in (labels, labels.limit(0)):
        scores = {r.score for r in module.classify(docs, known).collect()}
        assert len(scores) == 1 and (label == "quality" or max(scores) < 0.3)


def test_labels_of_held_out_rows_are_never_learned(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    out = {r.doc_id for r in labels.filter(held_out("doc_id")).collect()}
    assert out == {k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {r.doc_id for r in training_sample(labels, "toxic", 500).collect()} == set(range(400)) - out
    assert training_sample(labels, "toxic", 20).count() == 40


def test_ranking_scores_the_quantile_as_asked():
    r = np.random.default_rng(3)
    y = (np.arange(2000) % 5 > 0).astype(int)
    x = np.stack([r.normal(y * 4.0), r.normal(size=2000)], 1)
    fitted = quality.fit(x, y, 0.8, at_quantile=0.7)
    assert abs((fitted.score(x) >= 0.7).mean() - 0.8) < 0.01
    assert ((fitted.score(x) >= 0.7) == (y == 1)).mean() > 0.95
    same = quality.fit(x, np.ones(2000, int), 1.0)
    assert set(same.score(x).round(9)) == {0.7}


def slope_over_all_pairs(weights, codes, y, ridge=1e-3):
    """Gradient of the mean loss of every pair of a good and a bad row, by brute force."""
    score = weights[codes].sum(1)
    lost = quality.sigmoid(score[y == 0][None] - score[y == 1][:, None]) / ((y == 0).sum() * (y == 1).sum())
    own = np.zeros(len(y))
    own[y == 1], own[y == 0] = -lost.sum(1), lost.sum(0)
    return np.bincount(codes.ravel(), np.repeat(own, codes.shape[1]), len(weights)) + ridge * weights


def test_ranking_learns_from_all_pairs():
    r = np.random.default_rng(4)
    y = (np.arange(400) % 4 > 0).astype(int)
    x = np.stack([r.normal(y * 1.0), r.normal(size=400), r.normal(y * 0.5)], 1)
    fitted = quality.fit(x, y, 0.75)
    codes = fitted.bins(x)
    hot = np.zeros((400, 36))
    np.put_along_axis(hot, codes, 1.0, 1)
    every = (hot[y == 1][:, None] - hot[y == 0][None]).reshape(-1, 36)
    np.testing.assert_allclose(fitted.weights, logistic(every, np.ones(len(every))), atol=1e-5)
    assert abs(slope_over_all_pairs(fitted.weights, codes, y)).max() < 1e-6


def test_ranking_learns_from_all_labelled_documents(spark):
    """More documents of a class than the 10,000 that were once the most; each pair counts."""
    rows = spark.sql("""
        select id as doc_id, if(id % 400 = 0, 0, 1) as quality, concat(if(id % 800 = 0, 'Buy now!!! ', ''),
          repeat('river stone ', cast(id % 23 as int)), if(id % 11 = 0, 'OK 1 $ ', 'bread. '), id) as text from range(14200)""")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality")
    fitted = quality.fit_table(docs, labels)
    known = quality.measures(docs.filter(~held_out("doc_id"))).join(labels, "doc_id").toPandas()
    y = known["quality"].to_numpy()
    assert (y == 1).sum() > 10_000 and (y == 0).sum() > 20
    codes = fitted.bins(np.array(known["x"].tolist()))
    assert abs(slope_over_all_pairs(fitted.weights, codes, y)).max() < 1e-5
    assert abs((fitted.score(np.array(known["x"].tolist())) >= 0.7).mean() - y.mean()) < 0.01


def test_op2_held_out(spark):
    """Exactly the texts with one of the table's insults; 5 of 94 labels lie on texts without any."""
    insults = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
    got = queries.op2_toxic_spans(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    got = got.merge(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]), on="doc_id")
    got = got[got.held_out]
    said = [bool(set(re.findall(r"\w+", text.lower())) & set(insults)) for text in got.text]
    assert got.predicted.tolist() == [int(s) for s in said]
    assert (got.predicted == got.toxic).sum() == len(got) - 5 and got[got.predicted == 1].toxic.all()


def test_op10_held_out(spark):
    got = queries.op10_quality_ranking(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    got = got[got.held_out]
    assert (got.predicted == got.quality).mean() >= 0.95


def test_few_toxic_labels_leave_all_texts_clean(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(12)), int(k % 3 == 0)) for k in range(1, 13)]
    docs, labels = tables(spark, rows)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 12 and not any(r.predicted or r.spans for r in got)
    assert toxicity.keep_clean(docs, labels).count() == 12
