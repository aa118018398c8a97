import re

from pyspark.sql import Row
from pyspark.sql.classic.dataframe import DataFrame

from marlstone.operators import audit, scoring, whole
from marlstone.operators.signals import SIGNALS
from marlstone.plans import registry, world
from marlstone.plans.world import World
from tests.test_whole import SF, shuffled_bytes


def test_fills_are_laid_out_in_slices(spark, monkeypatch):
    """The disk holds the shuffles of one range of orders at a time, not those of all fills."""
    before, held = shuffled_bytes(spark), []
    free = world.free_shuffles
    monkeypatch.setattr(world, "free_shuffles", lambda df: (held.append(shuffled_bytes(spark) - before), free(df)))
    w = World(spark, SF)
    w.keep()
    assert len(held) == world.SLICES and max(held) < sum(held) / 2
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    assert w.narrow.count() == lines.join(orders, lines.l_orderkey == orders.o_orderkey).count()
    assert "Exchange" not in w.narrow.groupBy("wallet").count()._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]
    spark.catalog.clearCache()


def test_keys_that_fill_no_slice(spark, tmp_path):
    """One order, or none, is laid out too: cuts may be alike or missing."""
    for name in ("supplier", "customer", "part", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    one = spark.read.parquet(f"{SF}/lineitem.parquet").first()["l_orderkey"]
    for kept, rows in ((orders.where(orders.o_orderkey == one), spark.read.parquet(f"{SF}/lineitem.parquet").where(f"l_orderkey = {one}").count()), (orders.limit(0), 0)):
        kept.write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        w = World(spark, str(tmp_path))
        w.keep()
        assert w.narrow.count() == rows
        spark.catalog.clearCache()


def signals_of(spark, *rows):
    kinds = "struct<raw double, component double, na string>"
    return spark.createDataFrame([Row(scope="all", wallet=w, passed=True, **{s: Row(*own.get(s, (1.0, 1.0, None))) for s in SIGNALS}) for w, own in rows], "scope string, wallet string, passed boolean, " + ", ".join(f"{s} {kinds}" for s in SIGNALS))


def test_reasons_are_those_of_long_rows(spark):
    held = signals_of(spark, ("a", {"S2": (None, None, "x"), "S5": (None, None, "y")}), ("b", {"S2": (None, None, "w"), "S5": (2.0, 1.0, None)}), ("c", {"S2": (None, None, "x")}))
    assert sorted(map(tuple, whole.reasons(held).collect()), key=str) == sorted(map(tuple, whole.long(held).groupBy("signal", "na").count().collect()), key=str)
    assert scoring.pending_of(whole.reasons(held)).collect() == scoring.pending(whole.long(held)).collect() == [Row(signal="S2", na="x", n=2)]


def test_pending_counts_before_signals_become_rows(spark):
    plan = registry.MADE["pending_signals"](World(spark, SF))._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]
    below = plan[plan.index("Generate explode") :]
    assert re.search(r"HashAggregate\(keys=\[(\w+)", below).group(1) == "S1"  # counted below, then made rows
    spark.catalog.clearCache()


def test_broken_reasons_are_those_of_long_rows(spark):
    held = signals_of(spark, ("a", {"S2": (1.0, 1.0, "x"), "S8": (None, None, None)}), ("b", {}), ("c", {"S2": (None, None, "x"), "S1": (None, 1.0, None)}))
    got = sorted(map(tuple, whole.broken_na(held).collect()))
    assert got == sorted(map(tuple, audit.broken_na(whole.long(held)).select("scope", "wallet", "signal").collect())) == [("all", "a", "S2"), ("all", "a", "S8"), ("all", "c", "S1")]


def test_sound_rows_become_no_rows_of_signals(spark):
    plan = registry.MADE["na_invariant"](World(spark, SF))._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]
    below = plan[plan.index("Generate explode") :].splitlines()
    assert any("Filter" in line and "_test" in line for line in below[1:4])
    spark.catalog.clearCache()


def test_only_missing_signals_are_looked_for_again(spark, monkeypatch):
    asked, agg = [], DataFrame.agg
    held = signals_of(spark, *[(str(i), {"S5": (None, None, "x")}) for i in range(9)], ("z", {})).coalesce(1)
    monkeypatch.setattr(type(held), "agg", lambda self, *columns: (asked.append(len(columns)), agg(self, *columns))[1])
    assert whole.components_found(held, 3) == dict.fromkeys(SIGNALS, 1) and asked == [1]


def test_totals_are_recomputed_in_a_projection(spark):
    plan = registry.MADE["score_recompute"](World(spark, SF))._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]
    assert next("_test" in line for line in plan.splitlines() if "Filter" in line)
    spark.catalog.clearCache()
