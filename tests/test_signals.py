"""Planted cases: a small world, one property changed at a time."""

import math

import pytest

from marlstone.functions import numeric as num
from marlstone.operators import graph, ledger, scoring, signals, stats, universe
from marlstone.operators.universe import Params

END = 1_700_123_456
P = Params()
FILL = "wallet string, market string, token string, side string, size double, price double, sec long, walk string"


class World:
    """One market "c" that outcome 1 won, and a void one "v"."""

    def __init__(self, spark, fills):
        self.spark = spark
        rows = [(w, m, f"{m}-t{o}", side, float(size), float(price), sec, "all") for w, m, o, side, size, price, sec in fills]
        self.fills = spark.createDataFrame(rows, FILL)
        self.markets = spark.createDataFrame([("c", "e1", False, 1, END), ("d", "e1", False, 1, END), ("g", "e2", False, 1, END), ("v", None, True, None, END)], "market string, event string, void boolean, winner int, resolved long")
        self.tokens = spark.createDataFrame([(f"{m}-t{o}", m, o) for m in "cdgv" for o in (0, 1)], "token string, market string, outcome int")
        self.anchors = spark.createDataFrame([("c", END - 3600, None)], "market string, anchor long, na string")
        self.scopes = universe.scope_map(self.markets)
        self.early = universe.before_resolution(self.fills, self.markets)
        self.bypass = spark.createDataFrame([], "wallet string")
        self.users = universe.universe(self.fills, self.early, self.scopes, self.bypass, P)


def one(df, wallet="w1", scope="all"):
    return next(r for r in df.collect() if r["wallet"] == wallet and r["scope"] == scope)


def test_low_odds(spark):
    w = World(spark, [("w1", "c", 1, "BUY", 80_000, 0.05, END - 1), ("w2", "c", 1, "BUY", 7_000, 0.12, END - 77), ("w3", "c", 1, "BUY", 900_000, 0.31, END - 5), ("w4", "c", 1, "BUY", 80_000, 0.05, END)])
    got = signals.low_odds(w.early, w.scopes, P)
    stake = 80_000 * 0.05
    assert one(got)["raw"] == stake and one(got)["component"] == pytest.approx(math.log10(stake / 1000) / math.log10(100_000 / 1000))
    assert one(got, "w2")["component"] == 0
    assert {r["wallet"] for r in got.collect()} == {"w1", "w2"}


def test_prefilter_is_exact(spark):
    w = World(spark, [("w1", "c", 1, "BUY", 6_000, 0.1, 5), ("w1", "d", 1, "BUY", 6_000, 0.1, 5), ("w2", "c", 1, "BUY", 9_999.999999, 0.1, 5), ("w3", "c", 1, "BUY", 10_000, 0.1, 5)])
    assert {r["wallet"]: r["passed"] for r in w.users.where("scope = 'all'").collect()} == {"w1": True, "w2": False, "w3": True}
    assert w.users.where("scope = 'd'").select("passed").first()[0]


def test_improbable_wins(spark):
    five = [("w1", m, 1, "BUY", 100, 0.1, 5) for m in ("c", "d", "g")]
    w = World(spark, [*five, ("w2", "c", 1, "BUY", 1, 0.5, 5), ("w3", "v", 1, "BUY", 1, 0.5, 5), ("w4", "c", 1, "BUY", 0.1, 0.5, 5), ("w4", "c", 1, "BUY", 0.2, 0.5, 6), ("w4", "c", 1, "SELL", 0.3, 0.5, 7)])
    got = signals.improbable(signals.bets(w.early, w.scopes, w.tokens, w.markets), P)
    assert one(got)["raw"] == pytest.approx(3) and one(got)["component"] == pytest.approx(0.5)
    assert one(got, "w2")["na"] == "n_resolved<min" and one(got, "w3")["na"] == "no_winner"
    assert not [r for r in got.collect() if r["wallet"] == "w4"]  # sold exactly what was bought


def test_tail_against_plain_distribution(spark):
    from itertools import product

    ps, k = [0.2, 0.5, 0.7, 0.9], 2
    want = sum(math.prod(p if x else 1 - p for p, x in zip(ps, xs)) for xs in product((0, 1), repeat=4) if sum(xs) >= k)
    from pyspark.sql import functions as F

    assert spark.range(1).select(num.tail(F.array(*map(F.lit, ps)), F.lit(k))).first()[0] == pytest.approx(want)
    assert spark.range(1).select(num.tail(F.array(*map(F.lit, ps)), F.lit(0))).first()[0] == 1.0


def test_distribution_by_halves():
    import numpy as np

    p = np.random.default_rng(1).random(300)
    plain = np.ones(1)
    for q in p:
        plain = np.append(plain * (1 - q), 0) + np.append(0, plain * q)
    assert num.distribution(p) == pytest.approx(plain, rel=1e-9)
    assert num.distribution(np.zeros(0)).tolist() == [1.0]


def test_together(spark):
    buys = [(f"w{i}", "c", 1, "BUY", 15_000, 0.08, 7000 + 150 * i) for i in range(1, 4)] + [("far", "c", 1, "BUY", 15_000, 0.08, 20_000), ("dear", "c", 1, "BUY", 15_000, 0.4, 7000)]
    got = signals.together(World(spark, buys).early, World(spark, buys).scopes, P)
    others = 2
    assert one(got)["raw"] == others and one(got)["component"] == pytest.approx(others / P.together_full)
    assert one(got, "far")["raw"] == 0


def test_before_event(spark):
    w = World(spark, [("w1", "c", 1, "BUY", 30_000, 0.4, END - 6 * 3600), ("w2", "c", 1, "BUY", 30_000, 0.4, END - 50 * 3600), ("w3", "d", 1, "BUY", 10, 0.5, 5), ("w4", "v", 1, "BUY", 10, 0.5, 5)])
    got = signals.before_event(w.early, w.scopes, w.tokens, w.markets, w.anchors, P)
    assert one(got)["raw"] == 1 and one(got)["component"] == pytest.approx(math.log10(30_000 * 0.4 / P.lead_floor) / math.log10(P.lead_cap / P.lead_floor))
    assert one(got, "w2")["component"] == 0
    assert one(got, "w3")["na"] == "no_event_ts" and one(got, "w4")["na"] == "no_winner"


def profiles(spark, rows):
    return spark.createDataFrame(rows, "wallet string, activity_status string, stats_status string, transfers_status string, first_trade long, first_funding long, truncated boolean, lower_bound long, lifetime_volume double, snap long")


def test_fresh_ladder(spark):
    w = World(spark, [(f"w{i}", "c", 1, "BUY", 20_000, 0.1, 1_000_000) for i in range(1, 7)])
    base = ("ok", "ok", "ok")
    p = profiles(spark, [("w1", *base, 1_000_000 - 3600, None, False, None, 1.0, END), ("w2", "unavailable", "ok", "ok", 1, None, False, None, 1.0, END), ("w3", *base, 500, None, False, None, 1.0, END), ("w4", *base, 5, 5, True, None, 1.0, END), ("w5", *base, None, None, False, None, 1.0, END), ("w6", *base, 5, None, True, 10, 1.0, END)])
    flags = spark.createDataFrame([(f"w{i}", i != 3) for i in range(1, 7)], "wallet string, own_inbound_ok boolean")
    got = signals.fresh(w.early, w.scopes, w.users, p, flags, P)
    assert one(got)["component"] == 1 and one(got)["raw"] == pytest.approx(1)
    assert [one(got, f"w{i}")["na"] for i in (2, 3, 4, 5, 6)] == ["activity_unavailable", "transfers_unverified", "funding_window_truncated", "no_first_ts", None]


def test_concentration(spark):
    w = World(spark, [("w1", "c", 1, "BUY", 30_000, 0.1, 5), ("w1", "c", 1, "SELL", 65_000, 0.1, 6)])
    p = profiles(spark, [("w1", "ok", "ok", "ok", 1, 1, False, 1, 10_000.0, 1)])
    assert one(signals.concentration(w.early, w.scopes, w.users, p, P))["raw"] == pytest.approx(0.95)


def test_exits(spark):
    fills = [(f"w{i}", "c", 1, "BUY", 20_000, 0.1, 5) for i in range(1, 6)]
    w = World(spark, fills)
    p = profiles(spark, [(f"w{i}", "ok", "ok", "ok", 1, 1, False, 1, 1.0, END + (90 if i != 3 else 10) * 86400) for i in range(1, 6)])
    redeems = spark.createDataFrame([(f"w{i}", "c", END + 60, "other" if i == 4 else "safe_exec") for i in range(1, 5)], "wallet string, market string, sec long, shape string")
    after = spark.createDataFrame([("w2", "c", END + 5 * 86400)], "wallet string, market string, next_trade long")
    got = signals.exits(w.early, w.scopes, w.users, w.tokens, w.markets, p, redeems, after, P)
    assert [one(got, f"w{i}")["raw"] for i in (1, 2, 5)] == [1.0, 0.5, 0.0]
    assert [one(got, f"w{i}")["na"] for i in (3, 4)] == ["dormancy_unobservable", "auto_redeem_unknown"]


def test_links_by_activity(spark):
    users = spark.createDataFrame([("all", f"w{i}", i != 3, i == 3, True) for i in range(1, 5)], "scope string, wallet string, passed boolean, bypassed boolean, profiled boolean")
    transfers = spark.createDataFrame([(f"w{i}", "in", 1, "0xX", 10) for i in (1, 2, 3)] + [("w4", "in", 1, "0xY", 10), ("w1", "out", 1, "0xY", 10)], "wallet string, direction string, hop int, counterparty string, first_block long")
    stops = spark.createDataFrame([], "address string")
    edges = graph.first_hop(transfers, users, stops, 100)
    ranges = '[{"from":50,"to":100,"status":"ok"},{"from":0,"to":49,"status":"ok"}]'
    lookups = spark.createDataFrame([("0xx", "ok", False, None, 0, 100, ranges), ("0xy", "ok", False, None, 0, 100, ranges.replace("50", "51"))], "address string, status string, capped boolean, cap_block long, from_block long, to_block long, subranges string")
    seen = spark.createDataFrame([("0xX", f"y{i}", i) for i in range(20)], "address string, y string, first_block long")
    state = graph.lookup_state(lookups, seen, 100)
    assert {r["address"]: (r["complete"], r["activity"]) for r in state.collect()} == {"0xx": (True, 20), "0xy": (False, 0)}
    at = lambda g: {r["wallet"]: (r["linked"], r["unverified"]) for r in graph.partners(edges, state, g).collect()}
    assert at(20) == {"w1": (1, True), "w2": (1, False), "w3": (2, False), "w4": (0, True)}
    assert at(19)["w3"] == (0, False)


@pytest.mark.parametrize(("counts", "want"), [([5, 40, 30, 28, 25, 12, 11, 9, 2], (31, 1)), ([9, 9, 4, 4, 0, 0, 0, 0, 7], (16, 0)), ([3, 3, 3, 3, 3, 3, 3, 3, 3], (256, 0)), ([0, 1, 6, 3, 3, 3, 3, 1, 0], (127, 2))])
def test_knee(spark, counts, want):
    assert graph.knee(spark.createDataFrame(list(enumerate(counts)), "bin int, n long")) == want


def test_profit(spark):
    w = World(spark, [("w1", "c", 1, "BUY", 100, 0.2, 5), ("w1", "c", 1, "SELL", 30, 0.5, END + 9), ("w1", "v", 1, "BUY", 10, 0.5, 5)])
    got = {r["market"]: r["profit"] for r in ledger.profit_by_market(w.fills, w.tokens, w.markets).collect()}
    assert float(got["c"]) == 65 and got["v"] is None


def test_dense_scores_and_checks(spark):
    w = World(spark, [("w1", "c", 1, "BUY", 80_000, 0.05, END - 1), ("w2", "c", 1, "BUY", 2, 0.4, END - 1)])
    held = signals.dense(w.users, {"S3": signals.low_odds(w.early, w.scopes, P), "S7": signals.together(w.early, w.scopes, P)})
    assert held.count() == 8 * w.users.count()
    applied = scoring.applied_weights(held, {s: 1.0 for s in signals.SIGNALS})
    assert applied == {s: 0.5 if s in ("S3", "S7") else 0.0 for s in signals.SIGNALS}
    scored = scoring.scores(held, w.users, applied)
    assert one(scored)["total"] == pytest.approx(math.log10(80_000 * 0.05 / 1000) / 2 / 2) and one(scored, "w2")["total_passed"] is None
    assert scoring.recompute_differences(scored, held, applied).count() == 0
    with pytest.raises(ValueError):
        scoring.applied_weights(held, {"S3": 0.0, "S7": 0.0})


def test_auc_and_choice(spark):
    rows = [("a", 0.9, 1), ("b", 0.5, 1), ("c", 0.5, 0), ("d", None, 0)]
    assert stats.auc(spark.createDataFrame(rows, "wallet string, score double, label int"), []).first()["auc"] == pytest.approx(3.5 / 4)
    grid = stats.weight_grid(["S1", "S2"])
    assert set(grid) == {"W0", "LOO_S1", "LOO_S2", "DBL_S1", "DBL_S2"}
    assert stats.chosen([{"config": "W0", "p05": 0.0}, {"config": "DBL_S1", "p05": 0.1}, {"config": "LOO_S1", "p05": 0.1}], grid) == "DBL_S1"
    assert stats.chosen([{"config": "DBL_S1", "p05": -0.1}], grid) == "W0"
