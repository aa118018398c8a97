import numpy as np

from marlstone.operators.mates import linked_mates
from marlstone.plans import registry
from marlstone.plans.world import World


def test_counts_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(5)
    links = {(f"w{w}", f"p{p}") for w, p in zip(draw.integers(0, 40, 160), draw.integers(0, 25, 160), strict=True)}
    members = {(f"s{s}", f"w{w}") for s, w in zip(draw.integers(0, 6, 150), draw.integers(0, 45, 150), strict=True)}
    want = {}
    for s, w in members:
        n = len({o for o, p in links if o != w and (s, o) in members and (w, p) in links})
        want |= {(s, w): n} if n else {}
    for rows in (5, 1000):
        made = linked_mates(spark.createDataFrame(sorted(links), "wallet string, counterparty string"), spark.createDataFrame(sorted(members), "scope string, wallet string"), rows)
        assert want and {(r["scope"], r["wallet"]): r["linked"] for r in made.collect()} == want


def test_no_row_for_a_pair(spark):
    """Pairs of wallets are neither joined with their scopes nor rows at all."""
    plan = registry.MADE["s6_links_v2"](World(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "counted" in plan and "other" not in plan
    spark.catalog.clearCache()
