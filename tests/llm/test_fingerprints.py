"""Phrase fingerprints: parse, likeness, and every edit against brute force."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from belegwerk.llm import fingerprints as fp
from belegwerk.llm import queries


def phrases(text):
    known, at = set(), 0
    while at < len(text):
        end = at + 1
        while text[at:end] in known and end <= len(text):
            end += 1
        if end > len(text):
            break
        known.add(text[at:end])
        at = end
    return known


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé🙂 ", max_size=60), st.text(alphabet="abc ", max_size=60))
def test_parse_and_halves(text, other):
    assert set(fp.parse(text, set())[0]) == phrases(text)
    item = fp.Halved(1, text)
    assert item.own.tobytes().hex() == fp.fingerprint(text)
    edited, own = item.edited(other)
    cut = len(text) // 2
    assert edited == text[:len(text) - cut] + other[:cut]
    assert own.tobytes().hex() == fp.fingerprint(edited)


def test_likeness_follows_shared_phrases():
    a, b = "the quick brown fox jumps over the lazy dog " * 3 + "abc" * 40, "zyx wvu tsr qpo nml kji hgf edc " * 6
    like = lambda s, t: fp.likeness(fp.signature(fp.parse(s, set())[0]), fp.signature(fp.parse(t, set())[0]))
    assert like(a, a) == 1 and like("", "") == 1 and like(a, b) < 0.2 < like(a, a[:-30] + b[:30])
    shared, whole = phrases(a) & phrases(b), phrases(a) | phrases(b)
    assert abs(like(a, b) - len(shared) / len(whole)) < 0.15


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for n, (key, text) in enumerate(rows):
        text, other = text or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(text) // 2
        edited = text[:len(text) - cut] + other[:cut]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(text), fp.fingerprint(edited)))
    return out


def same(got, rows):
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(expected(rows), key=order)


def test_edge_cases(spark):
    for rows in (
        [(5, "abcdefgh" * 9), (4, None), (3, ""), (3, ""), (2, "x"), (2, "xyz" * 9), (None, "late one"), (None, "later"), (1, "é" * 7)],
        [(1, "alone here")], [(None, "a bb"), (None, "b cc")], [(k, f"text {k} " * (k % 5)) for k in range(60)],
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "'r' as role")
        same(fp.compare_edited(df).collect(), rows)
    assert fp.compare_edited(df.limit(0)).collect() == []
    one = fp.fingerprints(df.limit(5)).collect()
    assert all(r.fingerprint == fp.fingerprint(rows[r.doc_id][1]) for r in one)


def test_op9(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op9_phrase_fingerprints(spark, sf).collect()
    same(got, rows)
    nearer = [r.near_edited > r.near_next for r in got if r.n_chars > 200]
    assert sum(nearer) > 0.9 * len(nearer)
