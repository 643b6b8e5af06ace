"""Removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from belegwerk.llm import queries, repeats
from belegwerk.llm.anchors import WIDTH, fragments
from belegwerk.llm.collection_bwt import suffix_order


def brute(rows):
    """``{row number: (n_bytes, spans, kept)}``."""
    least = {}
    for key, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - WIDTH + 1):
            if key is not None:
                s = raw[k:k + WIDTH]
                least[s] = min(key, least.get(s, key))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for k in range(len(raw) - WIDTH + 1):
            if key is not None and least[raw[k:k + WIDTH]] < key:
                gone[k] += 1
                gone[k + WIDTH] -= 1
        gone = np.cumsum(gone)[:len(raw)] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((key, len(raw), [tuple(p) for p in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cell", "'x' as spans", "2 as copy")
    got = [(r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in repeats.drop_repeats(df).collect()]
    assert all(g[1] - len(g[3]) == sum(b - a for a, b in g[2]) for g in got)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def prose(r, n):
    return "".join(r.choice("abcdefé \n") for _ in range(n))


def test_edge_cases(spark):
    r = random.Random(3)
    a, b = prose(r, 300), prose(r, 60)
    same(spark, [
        (5, a), (2, a), (2, a), (9, None), (8, ""), (7, "short"), (6, "short"), (None, a), (10, b[:49]), (11, b[:49]), (12, b[:30] + b[:50]),
        (13, "x" * 500), (3, "x" * 49), (4, "x" * 60), (14, "ab" * 300), (1, "ba" * 40), (15, b + a[20:69]), (16, a[20:70] + b),
        (17, a[100:180] + a[140:230]), (0, "zz" + a[250:]),
    ])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    r = random.Random(seed)
    shared = [prose(r, n) for n in (49, 50, 51, 80, 150, 400)]
    rows = []
    for k in range(60):
        text = "".join(prose(r, r.randrange(80)) + (r.choice(shared) if r.random() < 0.7 else "") for _ in range(4))
        rows.append((r.randrange(1000), text))
    rows += [(1000 + k, rows[k][1]) for k in range(5)]
    same(spark, list({k: (k, t) for k, t in rows}.values()))


def test_empty(spark):
    assert repeats.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_in_pieces(monkeypatch):
    """Pieces of one text hold each of its windows once."""
    monkeypatch.setattr(repeats, "PIECE", 1000)
    for size in (999, 1000, 1001, 1951, 1952, 7000):
        text = prose(random.Random(size), size)
        raw = np.frombuffer(text.encode(), np.uint8)
        seen = []
        for body, at, rows, begin in repeats.pieces(pa.array([text])):
            first, end, _, row = fragments(body, at)
            seen += [k + begin[0] for a, b in zip(first.tolist(), end.tolist()) for k in range(a, b)]
            assert (body == raw[begin[0]:begin[0] + len(body)]).all() and rows.tolist() == [0]
        assert sorted(seen) == list(range(len(raw) - WIDTH + 1))


@pytest.mark.parametrize("most", [1, 3, 10, 30_000])
def test_owners_of_windows_in_split_cells(most):
    r = random.Random(11)
    base = [prose(r, 120).encode() for _ in range(3)]
    whole = [prose(r, 40).encode() + b + prose(r, 40).encode() for b in base for _ in range(12)]
    body = np.frombuffer(b"".join(whole), np.uint8)
    first, end, code, row = fragments(body, np.append(0, np.cumsum([len(t) for t in whole])))
    assert max(np.unique(code, return_counts=True)[1]) >= 10
    least = {}
    for a, b, d in zip(first.tolist(), end.tolist(), (row % 20).tolist()):
        t = body[a:b + WIDTH - 1].tobytes()
        least[t] = min(d, least.get(t, d))
    texts, docs = list(least), np.array(list(least.values()))
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    got = repeats.window_owners(np.frombuffer(b"".join(texts), np.uint8), at, docs, most)
    windows = [(t[k:k + WIDTH], d) for t, d in zip(texts, docs.tolist()) for k in range(len(t) - WIDTH + 1)]
    least = {}
    for w, d in windows:
        least[w] = min(d, least.get(w, d))
    assert got.tolist() == [least[w] for w, _ in windows]


def test_lots_keep_anchors_whole():
    r = np.random.default_rng(1)
    for most in (1, 2, 5, 100):
        anchor = r.integers(0, 9, 60).astype(np.uint32)
        lots = list(repeats.orders(anchor, most))
        assert sorted(np.concatenate(lots).tolist()) == list(range(60))
        owners = [set(anchor[lot].tolist()) for lot in lots]
        assert sum(map(len, owners)) == len(set().union(*owners))
        assert all(len(lot) <= most or len(own) == 1 for lot, own in zip(lots, owners))


def test_rows_of_one_id_and_odd_columns(spark):
    r = random.Random(6)
    a, b = prose(r, 200), prose(r, 120)
    rows = [(1, a), (2, b), (2, a), (2, b), (3, "no repeat"), (3, a[:90])]
    docs = spark.createDataFrame([(*row, 5, "x", "y", "z") for row in rows], "doc_id long, text string, n_chars int, `a b` string, `a.b` string, cut_spans string")
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
    # Row 2 with the text of row 1 goes; places that it loses go from no longer text of its id.
    assert (1, a, 200) in got and (2, "", 0) in got
    assert (3, "", 0) in got
    assert [tuple(x)[3:] for x in out.collect()] == [("x", "y", "z")] * 6


def test_suffix_order_is_lexical():
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode() for _ in range(40)]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    owner, length = suffix_order(np.frombuffer(b"".join(texts), np.uint8), at)
    got = [(texts[o][len(texts[o]) - n:], o) for o, n in zip(owner.tolist(), length.tolist())]
    assert got == sorted((t[k:], o) for o, t in enumerate(texts) for k in range(len(t)))


def test_fragments_hold_every_window_once():
    r = random.Random(5)
    texts = [prose(r, n).encode() for n in (10, 49, 50, 51, 400, 0, 90)]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    body = np.frombuffer(b"".join(texts), np.uint8)
    first, end, _, row = fragments(body, at)
    windows = [(int(o), k) for a, b, o in zip(first.tolist(), end.tolist(), row) for k in range(a - at[o], b - at[o])]
    assert sorted(windows) == [(o, k) for o, t in enumerate(texts) for k in range(len(t) - WIDTH + 1)]


def test_op8(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {k: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest()) for k, n, s, kept in brute(rows)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_repeated_strings(spark, sf).collect()}
    assert got == want


def test_a_task_holds_fragments_only_as_it_sends_them(spark, monkeypatch):
    import tracemalloc

    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghij ", k=2000)) for _ in range(2000)]
    monkeypatch.setattr(repeats, "SLICE", 1 << 16)
    monkeypatch.setattr(repeats, "SENT", 1 << 18, raising=False)

    class Frame:
        """Keeps the function that the tasks would run."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Marks:
        value = b"\xff" * (1 << 13)  # every anchor is marked

    run = repeats.deal_fragments(Frame(), Marks, 16, 9)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        sent, places = 0, 0
        for part in run(iter([batch])):
            sent += sum(map(len, part.column("texts").to_pylist()))
            places += sum(len(b) // 8 for b in part.column("start").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent > 3 * batch.nbytes and places > batch.nbytes // 30
    assert peak < 11 * batch.nbytes
