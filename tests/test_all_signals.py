import pytest

from marlstone.plans import registry
from marlstone.plans.world import World

SF = "/root/testdata/sf0.001"


def test_dense_has_all_eight(spark):
    w = World(spark, SF)
    held = {(r["signal"], r["scope"], r["wallet"]): (r["raw"], r["component"], r["na"]) for r in registry.MADE["signals_dense"](w).collect()}
    found = set()
    for s, make in registry.SIGNALS.items():
        for r in registry.signal(make(w)).collect():
            assert held[s, r["scope"], r["wallet"]] == pytest.approx((r["raw"], r["component"], r["na"]))
            found |= {s} if r["raw"] is not None else set()
    assert found & {"S1", "S4", "S5", "S6", "S8"}


def test_board_has_the_full_totals(spark):
    full = {(r["scope"], r["wallet"]): r["total"] for r in registry.queries()["full_scores"](spark, SF).collect()}
    for name in ("score_total", "leaderboard"):
        rows = registry.queries()[name](spark, SF).collect()
        assert rows and all(r["total"] == pytest.approx(full[r["scope"] if "scope" in r else "all", r["wallet"]], abs=1e-8) for r in rows)
