"""Weights, scores, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import ordered_sum
from marlstone.operators.signals import SIGNALS


def applied_weights(dense: DataFrame, weights: dict[str, float]) -> dict[str, float]:
    """Weights that add up to 1: a signal without any component in scope "all" has none. All zero is an error."""
    rows = dense.where("scope = 'all'").groupBy("signal").agg(F.count("component").alias("n")).collect()  # eight rows
    return weights_of({r["signal"]: r["n"] for r in rows}, weights)


def weights_of(counted: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    """``applied_weights`` where the components of each signal are counted already."""
    usable = {s for s, n in counted.items() if n}
    own = {s: float(weights.get(s, 0.0)) if s in usable else 0.0 for s in SIGNALS}
    total = sum(own[s] for s in SIGNALS)
    if total <= 0:
        raise ValueError("all applied weights are zero")
    return {s: own[s] / total for s in SIGNALS}


def overridden(weights: dict[str, float], changes: dict[str, float]) -> dict[str, float]:
    """Weights with some replaced; an unknown signal is an error."""
    if unknown := set(changes) - set(SIGNALS):
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    return {**weights, **{s: float(w) for s, w in changes.items()}}


def weighted(weights: dict[str, float]):
    """A row's weight times its component, 0 where there is none."""
    w = F.coalesce(*[F.when(F.col("signal") == s, F.lit(v)) for s, v in weights.items()], F.lit(0.0))
    return F.coalesce(w * F.col("component"), F.lit(0.0))


def scores(dense: DataFrame, users: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``scope``, ``wallet``, ``total``, ``total_passed`` (null unless the prefilter was passed), ``n_na``; summed in the signals' order."""
    sums = dense.withColumn("part", weighted(weights)).groupBy("scope", "wallet").agg(ordered_sum(F.col("signal"), F.col("part")).alias("total"), F.count("na").alias("n_na"))
    return sums.join(users.select("scope", "wallet", "passed"), ["scope", "wallet"]).select("scope", "wallet", "total", F.when(F.col("passed"), F.col("total")).alias("total_passed"), "n_na")


def recompute_differences(scored: DataFrame, dense: DataFrame, weights: dict[str, float], tolerance: float = 1e-12) -> DataFrame:
    """Scores that the stored components and weights don't give again."""
    again = dense.groupBy("scope", "wallet").agg(*[F.max(F.when(F.col("signal") == s, F.coalesce("component", F.lit(0.0)))).alias(s) for s in SIGNALS])
    return differing(scored.join(again, ["scope", "wallet"], "left"), {s: F.col(s) for s in SIGNALS}, weights, tolerance)


def differing(scored: DataFrame, components: dict[str, Column], weights: dict[str, float], tolerance: float = 1e-12) -> DataFrame:
    """``recompute_differences`` where scores and ``components`` stand in one row."""
    return scored.where(differs(components, weights, tolerance)).select("scope", "wallet", "total")


def differs(components: dict[str, Column], weights: dict[str, float], tolerance: float = 1e-12) -> Column:
    """Whether ``total`` isn't what weights and components give."""
    total = F.lit(0.0)
    for s in SIGNALS:
        total = total + F.lit(weights[s]) * F.coalesce(components[s], F.lit(0.0))
    return F.coalesce(F.abs(F.col("total") - total) > tolerance, F.lit(True))


def contributions(dense: DataFrame, weights: dict[str, float], top: int = 2) -> DataFrame:
    """Each signal's share of a score and its rank by the four printed digits; ties share a rank, so all tied drivers show."""
    from pyspark.sql import Window

    own = dense.withColumn("part", weighted(weights)).withColumn("printed", F.round("part", 4))
    rank = F.rank().over(Window.partitionBy("scope", "wallet").orderBy(F.col("printed").desc()))
    return own.withColumn("place", rank).select("scope", "wallet", "signal", "part", "printed", ((F.col("place") <= top) & (F.col("printed") > 0)).alias("driver"))


def pending(dense: DataFrame) -> DataFrame:
    """Signals without a value in any row, and their most frequent reason (the first by name on a tie)."""
    return pending_of(dense.groupBy("signal", "na").agg(F.count(F.lit(1)).alias("n")))


def pending_of(per: DataFrame) -> DataFrame:
    """``pending`` where the reasons of each signal are counted already: ``signal``, ``na``, ``n``."""
    from pyspark.sql import Window

    own = Window.partitionBy("signal")
    found = per.withColumns({"_values": F.count(F.when(F.col("na").isNull(), 1)).over(own), "place": F.row_number().over(own.orderBy(F.col("n").desc(), "na"))})
    return found.where("_values = 0 AND place = 1").select("signal", "na", "n")
