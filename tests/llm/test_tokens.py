"""BPE against the tokenizers library; packing against item-by-item best fit."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from belegwerk.llm import bpe_text, packing, queries  # noqa: E402
from belegwerk.llm.byte_bpe import encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"
PARTS = ["a", "st", "re", " ", "  ", "\n", "'", "'s", "'ll", "é", "日", "23", "!", "<|endoftext|>", "<|",
         " ", "　", "🙂", "\r\n", "Ab", "the", "́", "\x00", "\x85", "​"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=8))
def test_encoder_equals_the_library(texts):
    for own in (encoder(PATH), packing.piece_encoder(PATH)):
        ids, at = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library_ids(t) for t in texts]
        assert own.decode(ids, at) == texts


def test_long_words_and_any_ids():
    texts = ["a" * 20_000, " " * 3000 + "x", "ab" * 4000, None, ""]
    ids, at = encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library_ids(t) for t in texts]
    rows = [[random.Random(k).randrange(50257) for _ in range(20)] for k in range(100)]
    import numpy as np

    flat = np.array(rows).ravel()
    assert encoder(PATH).decode(flat, np.arange(0, 2001, 20)) == [
        LIBRARY.decode(r, skip_special_tokens=False) for r in rows
    ]


def test_tables(spark):
    rows = [(1, "Hello there<|endoftext|> x", "a"), (1, "Hello there<|endoftext|> x", "a"), (None, None, None), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe_text.encode_texts(docs, PATH)
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encoded.collect()))
    assert got == sorted((r[0] or 0, library_ids(r[1])) for r in rows)
    decoded = bpe_text.decode_ids(encoded, PATH).collect()
    assert sorted(r.decoded for r in decoded) == sorted(r[1] or "" for r in rows)
    assert bpe_text.round_trip_digests(docs.limit(0), PATH).collect() == []


def test_op7_equals_the_library(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op7_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library_ids(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(b"".join(i.to_bytes(4, "little") for i in ids))
        assert r.decoded_sha256 == sha(texts[r.doc_id].encode())


def one_by_one(lengths, capacity):
    """Number of bins of plain best fit decreasing."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= length]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_histogram_packing_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = {n: lengths.count(n) for n in lengths}
    filled, ranks = {}, {}
    for length, lo, hi, first, per, offset in packing.best_fit_decreasing(histogram, capacity):
        for rank in range(lo, hi):
            spot = (first + (rank - lo) // per, offset + (rank - lo) % per * length)
            filled.setdefault(spot[0], []).append((spot[1], length))
            ranks.setdefault(length, []).append(rank)
    assert all(sorted(ranks[n]) == list(range(histogram[n])) for n in histogram)
    for spots in filled.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == one_by_one(lengths, capacity)


def test_op4(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    by_doc, by_sequence = {}, {}
    for r in queries.op4_best_fit_packing(spark, SF).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    lengths = []
    for doc, pieces in by_doc.items():
        ids = library_ids(texts[doc]) + [0]
        at = 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            own = b"".join(i.to_bytes(4, "little") for i in ids[at:at + r.length])
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(own))
            assert r.length == 2048 or n == 0
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == one_by_one(lengths, 2048)


def test_packing_edge_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "word " * 40), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length")
    pieces = packing.token_pieces(docs, PATH, capacity=16).cache()
    placed = packing.place(pieces, 16).collect()
    assert len(placed) == pieces.count()
    assert len({(r.sequence_id, r.offset) for r in placed}) == len(placed)
    assert packing.place(packing.token_pieces(docs.limit(0), PATH)).collect() == []
    one = packing.token_pieces(docs.filter("doc_id = 3"), PATH, capacity=16).cache()
    packed = packing.sequences(one, packing.place(one, 16)).collect()
    assert sum(len(r.ids) for r in packed) == 4 * (len(library_ids("word " * 40)) + 1)
