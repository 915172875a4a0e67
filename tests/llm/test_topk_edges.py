"""Top-k search on large scores, repeated and missing ids, mixed widths and pruned cells, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide.llm import topk

SCHEMA = "vec_id long, embedding array<double>, cell string, side int, far double"


def brute(rows, every, k=20):
    v = [(i, [int(np.floor(64 * c)) for c in x]) for i, x in rows if i is not None and x is not None]
    out = {}
    for q, x in {(i, tuple(x)) for i, x in v if i % every == 0}:
        for c, y in v:
            if c != q and len(x) == len(y):
                out.setdefault(q, []).append((max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(x, y, strict=True)))), c))
    return {q: [(c, s) for s, c in sorted(m, key=lambda t: (-t[0], t[1]))[:k]] for q, m in out.items()}


def found(spark, rows, every, **options):
    df = spark.createDataFrame([(i, x, "a", 7, 0.5) for i, x in rows], SCHEMA)
    got = {}
    for r in topk.search(df, F.col("vec_id") % every == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("size", [4000.0, 1e6, 2.0**40, 1e17])
def test_large_scores_are_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(0, [size] * 16), (1, [-size] * 16), (2, [1.0] * 16), (3, [0.0] * 16)]
    rows += [(10 + i, (size * rng.normal(size=16)).tolist()) for i in range(30)]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(4)
    x = lambda n=6: rng.integers(-9, 9, n).astype(float).tolist()
    rows = [(i % 40, x()) for i in range(120)] + [(None, x()) for _ in range(5)] + [(80, x(3)), (81, x(3)), (100, x(2))]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_cells_prune_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 40)
    monkeypatch.setattr(topk, "SEED", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    centres = 3 * rng.normal(size=(9, 8))
    rows = [(i, (centres[rng.integers(0, 9)] + 0.1 * rng.normal(size=8)).tolist()) for i in range(1200)]
    assert found(spark, rows, 10) == brute(rows, 10)
