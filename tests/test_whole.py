import os
import re

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlstone.functions.numeric import distribution, tails
from marlstone.operators.signals import SIGNALS
from marlstone.operators.whole import components_found
from marlstone.plans import registry
from marlstone.plans.world import World
from marlstone.session import free_shuffles

SF = "/root/testdata/sf0.001"


def test_no_shuffle_by_scope(spark):
    """Neither signals nor scores move, or are kept, by (scope, wallet): eight rows for each of them fill a disk."""
    w = World(spark, SF)
    plan = registry.scored(w)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "scope" in line.split("hashpartitioning(")[1]]
    assert "scope" in plan and not moved
    spark.catalog.clearCache()


def shuffled_bytes(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    return sum(os.path.getsize(f) for f in disk.getAllFiles().mkString(",").split(",") if re.search(r"/shuffle_\d+_\d+_\d+\.data$", f))


def test_fills_lie_on_disk_once(spark):
    """The shuffles that laid the fills out are gone once they lie there; a lost part is made again."""
    before = shuffled_bytes(spark)
    w = World(spark, SF)
    w.keep()
    assert shuffled_bytes(spark) - before < 2000  # what counts them
    rows = w.narrow.count()
    assert rows == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    blocks = spark.sparkContext._jsc.sc().env().blockManager()
    for i in list(spark.sparkContext._jsc.sc().getPersistentRDDs().keys().mkString(",").split(",")):
        blocks.removeRdd(int(i))
    assert w.narrow.count() == rows
    spark.catalog.clearCache()


def test_shuffles_that_spark_cleaned_up(spark):
    """Spark may clean up a shuffle before it is deleted by name: that is no error, and the kept table stays."""
    kept = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count().persist()
    assert kept.count() == 7
    plan = spark._jsparkSession.sharedState().cacheManager().lookupCachedData(kept._jdf).get().cachedRepresentation().cacheBuilder().cachedPlan()
    gone = list(plan.context().shuffleIds())
    for i in gone[:1]:
        spark.sparkContext._jsc.sc().env().mapOutputTracker().unregisterShuffle(i)
    free_shuffles(kept)
    assert gone and sum(r["count"] for r in kept.collect()) == 1000
    kept.unpersist()


def test_sums_that_leave_whole_numbers(spark, tmp_path):
    """Stakes that a bigint can't add up are added up as decimals; both are exact."""
    for name in ("orders", "supplier", "customer", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumns({"l_quantity": F.lit(9_999_999_999.0), "l_discount": F.lit(9_500_000.0)})
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    w = World(spark, str(tmp_path))
    w.keep()
    assert dict(w.known_outcome.dtypes)["staked"] == "decimal(38,0)"
    got = w.known_outcome.agg(F.sum("staked"), F.count(F.lit(1))).first()
    assert int(got[0]) == got[1] * 999_999_999_900 * 950_000_000
    spark.catalog.clearCache()


def test_components_found(spark):
    rows = [Row(**{s: Row(component=1.0 if i == 9 or s != "S5" else None) for s in SIGNALS}) for i in range(10)]
    held = spark.createDataFrame(rows, ", ".join(f"{s} struct<component: double>" for s in SIGNALS)).coalesce(1)
    assert components_found(held, 3) == components_found(held) == dict.fromkeys(SIGNALS, 1)
    assert components_found(held.limit(9), 3) == {s: int(s != "S5") for s in SIGNALS}


def test_no_method_too_large_to_compile(spark):
    """The JVM interprets methods of more than 8,000 bytes."""
    w = World(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = registry.totals(w)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.catalog.clearCache()
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_tails_are_those_of_single_rows():
    draw = np.random.default_rng(3)
    ps = [draw.random(n) for n in (0, 1, 5, 64, 65, 90, 3)]
    for ks in ([0, 1, 2, 30, 31, 40, 4], [1, 0, 5, 64, 0, 91, 1]):
        want = [1.0 if k <= 0 else min(1.0, max(0.0, distribution(p)[k:].sum())) for p, k in zip(ps, ks, strict=True)]
        assert tails(ps, np.array(ks)).tolist() == want
