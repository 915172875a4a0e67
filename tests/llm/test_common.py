"""The bit set that rules out keys before a join, and connected components."""

import random

import pytest
from pyspark.sql import functions as F

from cashtide.llm import common
from cashtide.llm.common import likely


@pytest.mark.parametrize("bits", [1 << 16, 1 << 25])
def test_likely_rules_out_and_loses_none(spark, bits):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("k"), F.lit("x").alias("bits"))
    keys = spark.range(0, 20_000, 7).select(F.col("id").alias("k")).unionAll(spark.sql("select cast(null as bigint)"))
    some, rest = (likely(rows, "k", keys, bits, without) for without in (False, True))
    have = {r.k for r in some.collect()}
    assert {k for k in range(0, 20_000, 7) if k % 100} <= have and len(have) < 20_000 * (0.5 if bits == 1 << 16 else 0.16)
    assert some.columns == rows.columns and some.count() + rest.count() == 20_000 and rest.where("k is null").count() == 200


@pytest.mark.parametrize("leaves", [150, 600])
def test_rounds_do_not_carry_every_link_of_a_group_with_many_hubs(spark, monkeypatch, leaves):
    """The blocks and buckets of near copies give each node a link to many hubs: what a round joins must grow with the nodes alone."""
    links = [(h, 100 + x) for h in range(20) for x in range(leaves)] + [(7000 + i, 7001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    kept, real = [], common.saved

    def counted(df, *a):
        kept.append(real(df, *a))
        return kept[-1]

    monkeypatch.setattr(common, "saved", counted)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: 7000 if x >= 7000 else 0 for x in nodes}
    both = next(d for d in kept if d.columns == ["a", "b"] and d.where("a > b").limit(1).count())  # what every round joins
    assert both.count() <= 3 * len(nodes)


def test_thinned_links_connect_the_same(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(x, 300 + x % 7) for x in range(40)] + [(-1, 2), (2, -1), (9, 9), (None, 1), (1, None)]
    up = {x: x for p in links for x in p if x is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    rows = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in common.components(rows).collect()} == {x: find(x) for x in linked}
    assert all(r.a < r.b and find(r.a) == find(r.b) for r in common.thinned(rows).collect())
