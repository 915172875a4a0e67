"""Brute-force comparisons of the operators on embeddings, and components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide.llm import embeddup, topk
from cashtide.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [0.0] * 6, 1), (9003, [None] + [1.0] * 5, 1), (9004, [float("nan")] + [1.0] * 5, 1), (9005, [1.0] * 6, None)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    x = (centres[rng.integers(0, 12, 300)] + 0.25 * rng.normal(size=(300, 6))).astype(np.float32)
    x[40:60] = x[40]
    rows = [(i, v.tolist(), int(i % 3) if i % 5 else 0) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows + ODD, SCHEMA).withColumn("rep", F.lit("x")).withColumn("score", F.lit(1))


@pytest.mark.parametrize("tile", [16, 1024])
def test_near_duplicates(vectors, tile):
    rows, df = vectors
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    n = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T / np.outer(n, n) >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    while True:
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddup.near_duplicates(df, tile=tile).collect()}
    assert near.sum() > 100
    assert {i: (int(near[i].sum()), int(low[i]), int(low[i]) == i) for i in range(len(x))} | {r[0]: (0, r[0], True) for r in ODD} == got


def test_topk(spark, vectors):
    rows, df = vectors
    got = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = [r for r in rows] + [r for r in ODD if r[0] in (9002, 9005)]
    v = {r[0]: np.floor(64 * np.array(np.float32(r[1]), float)).astype(int) for r in usable}
    for q in (i for i in v if i % 20 == 0):
        want = sorted(((int(v[q] @ c), i) for i, c in v.items() if i != q), key=lambda s: (-s[0], s[1]))[:20]
        assert got[q] == [(i, s) for s, i in want]
    few = topk.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2


def test_cover_tree_covers():
    x = np.random.default_rng(8).normal(size=(700, 5))
    t = topk.CoverTree(x, 16)
    for c, r, (a, b), kids in zip(t.centre, t.radius, t.span, t.children, strict=True):
        assert np.sqrt(((x[t.order[a:b]] - x[c]) ** 2).sum(axis=1)).max() <= r + 1e-9
        if kids:
            assert sorted(t.span[k] for k in kids)[0][0] == a and sum(t.span[k][1] - t.span[k][0] for k in kids) == b - a


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddup.near_duplicates(none).count() == 0 and topk.search(none, F.col("vec_id") % 20 == 0).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 201: 200}


@pytest.mark.parametrize("boxes", [2, 256])
def test_near_duplicates_of_null_and_repeated_ids(spark, monkeypatch, boxes):
    monkeypatch.setattr(embeddup, "BOXES", boxes)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 5))
    x = centres[rng.integers(0, 8, 150)] + 0.2 * rng.normal(size=(150, 5))
    ids = [None if i % 11 == 0 else i % 60 for i in range(150)]
    rows = [(k, None if i % 17 == 3 else v.tolist(), 1 if i % 4 else 2) for i, (k, v) in enumerate(zip(ids, x, strict=True))]
    n = np.sqrt((x * x).sum(axis=1))
    label = np.array([r[2] for r in rows])
    near = (x @ x.T / np.outer(n, n) >= 0.93) & (label[:, None] == label[None, :])
    lost = [i for i, r in enumerate(rows) if r[1] is None]
    near[lost], near[:, lost] = False, False
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
    want = []
    for i, k in enumerate(ids):
        low = min((ids[j] for j in range(len(x)) if comp[j] == comp[i] and ids[j] is not None), default=None)
        want.append((k, int(near[i].sum()), low, k == low))
    got = embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=8)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_duplicates_of_mixed_lengths_and_extreme_sizes(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0, 3.1], 1), (5, [1.0], 1), (6, [-2.0, 1.0], 1), (7, [], 1)]
    got = embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}
