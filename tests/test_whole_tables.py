import math

from marlstone.plans import registry


def test_pages_hold_every_order(spark, tmp_path):
    keys = [1, 7, 10, 999, 1000, 1003, 2010, 2011]
    spark.createDataFrame([(k, k % 3) for k in keys], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()["explode_pages"](spark, str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(i, f"w{k % 3}", float(k), k) for i, k in enumerate(keys)]


def test_projection_takes_every_line(spark, tmp_path):
    rows = [("A" if k % 3 else "R", n, float(k * 7 % 50 + n)) for k in range(9) for n in range(1, 4)]
    spark.createDataFrame(rows, "l_returnflag string, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["flag"]: tuple(r)[1:] for r in registry.queries()["cost_projection"](spark, str(tmp_path)).collect()}
    for flag in "AR":
        own = sorted(q for f, _, q in rows if f == flag)
        at = lambda q: own[math.ceil(q * (len(own) - 1))] * 100
        assert got[flag] == (round(sum(own) / len(own) * 100, 6), at(0.5), at(0.9))
