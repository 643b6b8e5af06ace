"""Fill-in-the-middle against regular expressions over code points, and the wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk.llm.middle import ENDS, fill_in_middle, locate, restored
from belegwerk.llm.wavelet import WaveletMatrix

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = [
    (None, "a b c"), (1, None), (2, ""), (3, "one"), (3, "one"), (4, "  lead and trail \n\t"), (5, "é ü x 漢字 𝄞𝄞 end"),
    (6, "has <P> in it"), (7, "a <M>"), (8, "<S>x y"), (9, "<S x> <P <M"), (10, "word " * 50_000), (11, " \n"), (12, "x" * 100_000),
    (13, "nul\x00byte \x0b\x0c y"), (14, "a<\n>b"), *[(k, f"t{k} < {k}> é<P " * (k % 7)) for k in range(20, 200)],
]


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    parts = ["".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])]
    if key is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return key, len(units), "plain", None, None, text
    form = "spm" if d % 100 < 80 else "psm"
    out = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}" if form == "spm" else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
    return key, len(units), form, len(parts[0]), len(parts[1]), out


def test_ranks_equal_counts():
    r = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = r.integers(0, 16, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 4)
        place = np.arange(n + 1)
        for s in range(16):
            assert matrix.rank(s, place).tolist() == np.append(0, np.cumsum(symbols == s)).tolist()
        some = (1, 5, 6)
        hits = np.flatnonzero(np.isin(symbols, some))
        want = np.append(0, hits + 1)
        zero, end = np.zeros(len(want), np.int64), np.full(len(want), n)
        assert matrix.after(some, np.arange(len(want)), zero, end).tolist() == want.tolist()


@pytest.mark.parametrize("unit", ENDS)
def test_units_of_every_kind(unit):
    texts = [t or "" for _, t in ROWS if len(t or "") < 1000] + ["", "\n", "a\n\nb", "\n\nx\n"]
    raw = [t.encode() for t in texts]
    body, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for draw in range(4):
        draws = np.full((len(raw), 4), draw, np.uint64)
        draws[:, 1] = 2 * draw + 1
        cuts = locate(body, at, draws, unit)
        for k, text in enumerate(texts):
            units = UNIT.findall(text) if unit == "tokens" else re.findall(r"[^\n]*\n|[^\n]+", text)
            lo, hi = sorted((draw % (len(units) + 1), (2 * draw + 1) % (len(units) + 1)))
            assert cuts.units[k] == len(units)
            assert (cuts.first_points[k], cuts.second_points[k]) == (len("".join(units[:lo])), len("".join(units[:hi])))
            assert (cuts.first[k], cuts.second[k]) == (len("".join(units[:lo]).encode()), len("".join(units[:hi]).encode()))


def test_outputs_equal_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as output", "1 as n", "2 as form")
    got = fill_in_middle(docs).withColumn("restored", restored()).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, (brute(*r) for r in ROWS)))
    assert sorted((r.doc_id or 0, r.restored) for r in got) == sorted((k or 0, t or "") for k, t in ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fill_in_middle(docs).withColumn("restored", restored()).orderBy("doc_id").collect()
    want = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r)[:6] for r in got] == [brute(*w) for w in want]
    assert [r.restored for r in got] == [t for _, t in want]
    lines = fill_in_middle(docs, seed=7, unit="lines", share=100, suffix_first=0).withColumn("restored", restored())
    assert lines.filter("form = 'spm'").count() == 0
    assert lines.join(docs, "doc_id").filter(F.col("restored") != F.col("text")).count() == 0
