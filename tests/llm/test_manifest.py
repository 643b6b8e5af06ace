"""The manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest

from belegwerk.llm import manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return h(*map(field, row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, place, digest):
    others = []
    for level in levels[:-1]:
        own = place - place % 2
        run = level[own:own + 2]
        others += [x for k, x in enumerate(run) if own + k != place]
        run[place - own] = digest
        digest, place = h(*run), place // 2
    return others, digest


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for k, row in enumerate(groups[g]):
            again = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                again = (*row[:3], row[3] + 1, row[4])
            inner, folded = climb(trees[g], k, leaf(again))
            outer, folded = climb(top, n, folded)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, h(*inner, *outer), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows):
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as g", "'x' as leaf", "2 as index", "'y' as path", "3 as rows")
    return sorted((tuple(r) for r in manifest.audit(docs).collect()), key=repr)


EDGES = [
    (None, None, None, None, None), (None, "s", None, 3, "abc"), (None, "s", None, 3, "abc"), (None, "s", "de", 1, "z"),
    (1, "s", "de", 0, ""), (1, "s", "de", None, None), (1, "t", "de", 4, "é\nü:"), (1, "t", "de", 4, "é\nü:"), (1, "t", "", 4, "x"),
    (-5, "s", "de", 2, "ab"), (-(1 << 62), "s", "de", 2, "ab"), ((1 << 62) + 3, "s", "de", 2, "ab"), (63, None, "de", 9, "x" * 100_000),
    (64, "", "de", 9, "q"), (1 << 20, "s", "de", 1, "-"), (7, "s", "ä", 1, "1"), (7, "s", "z", 1, "1"), (8, "s", "Z", 1, "1"),
]


@pytest.mark.parametrize("n", [0, 1, 2, 3, len(EDGES)])
def test_edge_cases(spark, n):
    assert got(spark, EDGES[:n]) == brute(EDGES[:n])


def test_many_leaves_many_copies_and_groups(spark):
    rows = [(k * 3, "s", "en", k, f"text {k}") for k in range(2 * manifest.SLOTS + 5)]
    rows += [(17, "s", "en", k, "one id") for k in range(300)] + [(18, "s", "en", 1, "copies")] * 300
    rows += [(k, "s", f"g{k}", 1, "own group") for k in range(manifest.SLOTS + 3)]
    assert got(spark, rows) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select(*manifest.FIELDS).collect()]
    assert got(spark, rows) == brute(rows)


def test_path_gives_the_root(spark):
    docs = spark.createDataFrame(EDGES, KIND)
    found = manifest.manifest(docs, manifest.leaf_of()).collect()
    assert all(r.verified for r in found)
    for r in found:
        assert manifest.fold(r.leaf.encode(), r.path.encode()).decode() == r.root
        assert h(manifest.siblings(r.path.encode()).decode()) == r.proof_sha256
