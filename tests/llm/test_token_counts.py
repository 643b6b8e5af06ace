"""Section counts against the offsets that the tokenizers library gives."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from belegwerk.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def brute(text):
    lines = [x + b"\n" for x in (text or "").encode().split(b"\n")]
    lines[-1] = lines[-1][:-1]
    lines = lines if lines[-1] else lines[:-1]
    ends, at = [], 0
    for line in lines:
        at += len(line)
        ends.append(at)
    counts, at = [0] * len(lines), 0
    for token in LIBRARY.encode(text or "", add_special_tokens=False).tokens:
        counts[next(k for k, e in enumerate(ends) if at < e)] += 1
        at += len(token)  # one printable character stands for each byte
    starts = [0, *ends[:-1]]
    return [(k, s, len(x), c) for k, (s, x, c) in enumerate(zip(starts, lines, counts))]


def same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as section", "'x' as start")
    got = sorted((r.doc_id or 0, r.section, r.start, r.n_bytes, r.n_tokens) for r in token_counts.section_counts(df, PATH).collect())
    assert got == sorted((k or 0, *row) for k, t in rows for row in brute(t))


def test_edge_cases(spark):
    same(spark, [
        (1, "one\n\n\ntwo  \n  three"), (2, None), (3, ""), (4, "\n"), (5, "no end\n"), (None, "é日🙂\nx"),
        (1, "one\n\n\ntwo  \n  three"), (6, "a<|endoftext|>\n b\r\n\tc"), (7, "word " * 3000 + "\n" * 50),
    ])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.section_counts(empty, PATH).collect() == []


def test_op6(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").limit(60).collect()]
    same(spark, rows)
    whole = queries.op6_section_tokens(spark, sf).groupBy("doc_id").sum("n_tokens").collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    want = {k: len(LIBRARY.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert {r[0]: r[1] for r in whole} == want


def slow_counts(tokens, spans, rule):
    """``tokens`` and ``spans`` as byte ranges."""
    out = []
    for a, b in spans:
        n = 0
        for s, e in tokens:
            inside = min(e, b) - max(s, a)
            if inside <= 0:
                continue
            n += (rule == "each" or (rule == "begin" and a <= s)
                  or (rule == "majority" and (2 * inside > e - s or (2 * inside == e - s and a <= s))))
        out.append(n)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_stretches_by_every_rule(spark, rule):
    r = random.Random(2)
    texts = {1: "Grüße an alle, 漢字 und 𝄞 dazu.\nEnde der Mitteilung", 2: "", 3: None, 4: "x" * 3000, 5: "a  b   c " * 400}
    rows, spans = [(k, t) for k, t in texts.items()] + [(None, "abc"), (1, texts[1])], []
    for k, t in texts.items():
        n = len(t or "")
        for m in range(40):
            a, b = sorted((r.randrange(n + 2), r.randrange(n + 4)))
            spans.append((k, f"s{m}", a, b))
    spans += [(1, "turned", 9, 3), (1, "null", None, 4), (1, None, 0, 5), (1, "all", 0, 10**6), (9, "nowhere", 0, 1), (None, "none", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as begin")
    table = spark.createDataFrame(spans, "doc_id long, section string, begin long, end long").selectExpr("*", "'x' as text")
    got = token_counts.attributed_counts(docs, table, PATH, rule).collect()
    want = []
    for key, text in rows:
        raw, tokens, at = (text or "").encode(), [], 0
        for token in LIBRARY.encode(text or "", add_special_tokens=False).tokens:
            tokens.append((at, at + len(token)))  # one printable character stands for each byte
            at += len(token)
        assert at == len(raw)
        own = [s for s in spans if s[0] == key and key is not None]
        edges = [(0, 0) if None in s[2:] else tuple(len((text or "")[:p].encode()) for p in s[2:]) for s in own]
        want += [(*s, n) for s, n in zip(own, slow_counts(tokens, edges, rule))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.attributed_counts(docs, table.limit(0), PATH, rule).collect() == []
