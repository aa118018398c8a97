import random

import pytest

from marlstone.operators import stats
from marlstone.plans import registry
from marlstone.plans.world import World


def plain(rows, rounds, seed):
    gains = {}
    drawn = {}
    for b, label, u, n in stats.draws(sorted({(r[4], r[3]) for r in rows}), rounds, seed):
        drawn.setdefault(b, {})[label, u] = n
    won, n = {}, {}
    for c, _, s, u, label in rows:
        n[c, label, u] = n.get((c, label, u), 0) + 1
        for d, _, t, v, other in rows:
            if c == d and label == 1 and other == 0:
                won[c, u, v] = won.get((c, u, v), 0) + (s > t) + (s == t) / 2
    for b, times in drawn.items():
        auc = {}
        for c in {r[0] for r in rows}:
            sides = [sum(k * n.get((c, label, u), 0) for (label, u), k in times.items() if label == x) for x in (1, 0)]
            auc[c] = sum(w * times.get((1, u), 0) * times.get((0, v), 0) for (d, u, v), w in won.items() if d == c) / (sides[0] * sides[1])
        for c in auc:
            gains.setdefault(c, []).append(auc[c] - auc["W0"])
    return {c: [sorted(g)[int(q * len(g))] for q in (0.05, 0.5, 0.95)] + [sum(g) / len(g)] for c, g in gains.items()}


def test_query_draws_two_thousand_times(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(c, f"w{k}", round(rnd.random() + (k % 3 == 0) * bonus, 1), f"u{k % 8 if k % 3 else k % 5}", int(k % 3 == 0)) for c, bonus in (("W0", 0.2), ("DBL_S2", 0.3)) for k in range(48)]
    totals = spark.createDataFrame(rows, "config string, wallet string, score double, unit string, label int")
    monkeypatch.setattr(registry, "config_totals", lambda w: totals)
    got = {r["config"]: list(r)[1:] for r in registry.MADE["bootstrap_quantile"](None).collect()}
    want = plain(rows, 2000, 1)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    assert want["DBL_S2"] != pytest.approx(plain(rows, 40, 1)["DBL_S2"])


def test_won_along_ranges(spark):
    """Pairs within a range, across ranges and tied, null below all, no number above all, other labels left out; no row for each unit it meets."""
    rnd = random.Random(7)
    rows = [(c, rnd.choice([None, -1.0, 0.0, -0.0, float("nan"), *[round(rnd.random(), 2) for _ in range(6)]]), f"u{rnd.randrange(5)}", rnd.choice((0, 1, 1, 0, 2))) for c in ("W0", "X") for _ in range(150)]
    rows += [("low", -5.0, "u1", 1), ("low", 5.0, "u2", 0)] + [("low", 9.0, "u1", 0)]
    totals = spark.createDataFrame(rows, "config string, score double, unit string, label int")
    found = stats.won_by_units(totals)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r)[:3]: r["won"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    place = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)
    want = {}
    for c, s, u, a in rows:
        for d, t, v, b in rows:
            if c == d and a == 1 and b == 0:
                want[c, u, v] = want.get((c, u, v), 0) + (2 if place(s) > place(t) else int(place(s) == place(t)))
    assert got == want and got["low", "u1", "u2"] == 0
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Join", "CartesianProduct", "Window"))


def test_signals_are_made_once_for_all_weights(spark):
    """Weight sets are read several times; the eight signals behind them are not made again each time."""
    plan = registry.config_totals(World(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
    assert "Exchange" not in plan and "parquet" not in plan.lower() and "InMemory" not in plan
