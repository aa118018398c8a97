"""Reproducibility and quality gates: fingerprints, multiset differences, keys, invariants, recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ranking import ranked


def fingerprints(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``column``, ``chunk``, ``md5`` of each column's values in the rows' total order, by chunks of ``chunk`` rows.

    Rows are ranked in sorted ranges whose sizes are added up, so the order is total but no task holds the table.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    placed = ranked(text, *[F.col(c).asc_nulls_first() for c in df.columns], name="_place")
    cells = placed.select("_place", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit("<NULL>")).alias("v")) for c in df.columns])).alias("x")).select("_place", "x.column", "x.v")
    parts = cells.groupBy("column", F.floor(F.col("_place") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_place", "v"))).alias("vs"))
    return parts.select("column", "chunk", F.md5(F.array_join(F.transform("vs", lambda x: x["v"]), "\x1f")).alias("md5"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` without a partner in ``b`` and the other way round, as often as they lack one; marked by ``side``."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("a")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("b")))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken_na(dense: DataFrame) -> DataFrame:
    """Rows that have both a value and a reason, or neither."""
    return dense.where(F.col("raw").isNull() != F.col("na").isNotNull())


def unresolved(markets: DataFrame) -> DataFrame:
    """Markets without a resolution; scoring must not start while there are any."""
    return markets.where("resolved IS NULL").select("market")


def resolved_only(markets: DataFrame) -> DataFrame:
    """``markets`` if each has a resolution; else an error that says how many lack one."""
    if lacking := unresolved(markets).count():
        raise ValueError(f"{lacking} markets have no resolution: scores must not be made")
    return markets


def volume_check(fills: DataFrame, markets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether taker shares come within ``tolerance`` of the volume that a market reports (``volume``)."""
    from marlstone.functions.numeric import size

    sums = fills.where("walk = 'taker'").groupBy("market").agg(F.sum(size()).cast("double").alias("shares"))
    held = markets.select("market", "volume").join(sums, "market", "left").withColumn("shares", F.coalesce("shares", F.lit(0.0)))
    return held.withColumn("passed", F.abs(F.col("shares") - F.col("volume")) <= tolerance * F.col("volume"))


def ingest_gates(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Markets whose fills can't be whole: none by takers though there was volume, or as many of all as of takers."""
    n = lambda w: F.count(F.when(F.col("walk") == w, 1)).alias(w)
    held = markets.select("market", "volume").join(fills.groupBy("market").agg(n("taker"), n("all")), "market", "left").select("market", "volume", F.coalesce("taker", F.lit(0)).alias("taker"), F.coalesce("all", F.lit(0)).alias("all"))
    reason = F.when((F.col("taker") == 0) & (F.col("volume") > 0), F.lit("no_taker_fills")).when((F.col("taker") > 0) & (F.col("all") == F.col("taker")), F.lit("walks_equal"))
    return held.withColumn("reason", reason).where("reason IS NOT NULL").select("market", "reason")


def recount(raw: DataFrame, derived: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    """Keys for which counts or sums of two tables differ."""
    per = lambda df, p: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}_n"), *[F.sum(s).alias(f"{p}_{s}") for s in sums])
    held = per(raw, "raw").join(per(derived, "derived"), keys, "full")
    same = F.lit(True)
    for c in ("n", *sums):
        same = same & F.col(f"raw_{c}").eqNullSafe(F.col(f"derived_{c}"))
    return held.where(~same)


def guarded(df: DataFrame, allowed: set[str]) -> DataFrame:
    """``df`` if all its columns may leave; else an error that names those that may not."""
    if extra := sorted(set(df.columns) - allowed):
        raise ValueError(f"columns that must not be exported: {extra}")
    return df


def shuffled_times(fills: DataFrame, seed: int, *key: str) -> DataFrame:
    """Fills with their times dealt anew among those of the same market and walk, by a seeded hash of ``key``."""
    w = Window.partitionBy("market", "walk")
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    base = fills.withColumn("_rn", F.row_number().over(w.orderBy(*key)))
    dealt = fills.select("market", "walk", F.col("sec").alias("_sec"), F.row_number().over(w.orderBy(F.md5(text), *key)).alias("_rn"))
    return base.drop("sec").join(dealt, ["market", "walk", "_rn"]).withColumnRenamed("_sec", "sec").drop("_rn")


def with_hash(df: DataFrame, params_hash: str) -> DataFrame:
    """``df`` with the hash of the parameters that made it on every row."""
    return df.withColumn("params_hash", F.lit(params_hash))
