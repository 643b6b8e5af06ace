"""Near-duplicate vectors and components against brute force."""

import numpy as np
import pytest

from belegwerk.llm import queries, vectors
from belegwerk.llm.components import connected_components


def brute(rows, threshold=0.95):
    """``{position: (n_links, component)}`` over ``(id, vector)`` rows."""
    sound = {}
    for n, (key, v) in enumerate(rows):
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        sound[n] = np.array(v, np.float32).astype(float)
    links = {n: [] for n in range(len(rows))}
    for i in sound:
        for j in sound:
            if i != j and len(sound[i]) == len(sound[j]):
                a, b = sound[i], sound[j]
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].append(j)
    out = {}
    for n, (key, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out[n] = (len(links[n]), min(ids) if ids else None)
    return out


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as n_links", "'x' as v")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept)
                 for r in vectors.near_duplicates(df, **options).collect())
    want = sorted((k is None, k or 0, *(lambda n, c: (n, c or 0, k is not None and k == c))(*brute(rows)[n]))
                  for n, (k, _) in enumerate(rows))
    assert got == want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    same(spark, [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.1]),
        (12, [1.0, 0.0, 0.0]), (13, [1.0, 0.4]), (14, [0.0, 0.0]), (None, None),
    ])


@pytest.mark.parametrize("block", [3, 8192])
def test_random_groups(spark, block):
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 16))
    rows = [(int(k), (centres[k % 8] + r.normal(size=16) * r.choice([0.05, 0.2, 0.3])).tolist()) for k in r.permutation(60)]
    rows += [(100 + k, rows[k % 7][1]) for k in range(20)]
    same(spark, rows, block=block)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(df).collect() == []


def test_bound_holds_at_the_threshold():
    r = np.random.default_rng(3)
    a = r.normal(size=(300, 64))
    b = a + r.normal(size=a.shape) * r.uniform(0.2, 0.5, size=(300, 1))
    for threshold in (0.85, 0.9, 0.95):
        found = {(x, y) for i, j in vectors.near_pairs(a, b, threshold) for x, y in zip(i.tolist(), j.tolist())}
        cosine = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        assert found == set(zip(*(x.tolist() for x in np.nonzero(cosine >= threshold))))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(5, 5), (None, 3), (300, 299)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in [100, *range(200, 230)]} | {299: 299, 300: 299}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_op1(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op1_near_vectors(spark, sf).collect()}
    assert got == {rows[n][0]: v for n, v in want.items()}


def test_very_large_and_small_entries(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e200]), (4, [1e199, 1e199]), (5, [1e-320, 1e-320]), (6, [0.0, 3.0]), (7, [0.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (1, 6), 7: (1, 6)}
