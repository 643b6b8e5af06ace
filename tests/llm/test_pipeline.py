"""The pipeline, stage by stage, against brute force on a whole small table."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from belegwerk.llm import quality, toxicity
from belegwerk.session import materialise
from tests.llm import test_jaccard, test_repeats
from tests.llm.test_tokens import one_by_one

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], SF)))
    return found


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_return_the_columns_of_documents(kept):
    for df in kept[1:-1]:
        assert df.schema.simpleString() == kept[0].schema.simpleString()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing",
    ]


@pytest.mark.parametrize("stage, module", [(0, quality), (1, toxicity)])
def test_classifiers_keep_what_they_do_not_reject(spark, kept, stage, module):
    scored = module.classify(kept[stage], corpus_pipeline.labels(spark, SF)).collect()
    good = {r.doc_id for r in scored if r.predicted == 1 - stage}
    assert good and (stage or len(good) < len(scored))  # too few toxic labels here to learn from
    assert sorted(rows(kept[stage + 1])) == sorted(r for r in rows(kept[stage]) if r[0] in good)


def test_one_of_each_group_stays(kept):
    given = rows(kept[2])
    group = test_jaccard.brute(given)
    assert sorted(rows(kept[3])) == sorted(r for r in given if group[r[0]][1] == r[0])
    assert len(rows(kept[3])) < len(given)


def test_repeated_strings_go(kept):
    want = {key: raw.decode(errors="ignore") for key, _, _, raw in test_repeats.brute(rows(kept[3]))}
    assert dict(rows(kept[4])) == want
    assert sum(len(t or "") for _, t in rows(kept[3])) > sum(map(len, want.values()))


def test_all_tokens_are_packed(kept):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces, sequences = {}, {}
    for r in kept[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == {key for key, _ in rows(kept[4])}
    for key, text in rows(kept[4]):
        ids, at = [*encode(text or "", add_special_tokens=False).ids, 0], 0
        for n, (piece, start, length, crc) in enumerate(sorted(pieces[key])):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at:at + length])
            assert (piece, start, crc) == (n, at, zlib.crc32(raw))
            at += length
        assert at == len(ids)
    for places in sequences.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(sequences) == one_by_one([n for own in pieces.values() for _, _, n, _ in own], 2048)


def test_run_is_the_stages_in_a_row(spark, kept):
    order = ["doc_id", "piece"]
    narrow = [*order, "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == kept[5].columns
    assert got.select(narrow).orderBy(order).collect() == kept[5].select(narrow).orderBy(order).collect()


def test_nulls_empty_and_extra_columns(spark):
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    blank = [tuple(None if f.name != "doc_id" else k for f in kind) for k in (None, 1, 1, 2)]
    for given in ([], blank):
        docs = spark.createDataFrame(given, kind).selectExpr(
            "*", "1 as label", "'x' as tags", "2 as n", "3 as `a b`", "4 as `a.b`", "5 as `_`", "6 as _quality", "7 as _tags", "8 as _toxic",
            "9 as cut_id", "10 as gone",
        )
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, SF)
            assert found.columns == docs.columns and found.count() <= len(given)
        assert len(corpus_pipeline.pack(spark, docs, SF).collect()) == len(given)
