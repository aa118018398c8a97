"""Scopes, the universe of wallets in each, and who gets profiled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import money, stake


@dataclass(frozen=True)
class Params:
    """Thresholds of the signals; the defaults are the frozen production values."""

    low_price: float = 0.20
    prefilter_stake: float = 1000
    fresh_stake: float = 1000
    fresh_hours: float = 48
    stale_hours: float = 720
    low_floor: float = 1000
    low_cap: float = 100_000
    lead_hours: float = 24
    lead_floor: float = 1000
    lead_cap: float = 50_000
    wins_full: float = 6.0
    wins_least: int = 3
    link_hops: int = 3
    link_breadth: int = 3
    link_fan: int = 20
    link_full: float = 5
    graded_full: float = 20
    together_stake: float = 1000
    together_seconds: int = 600
    together_full: float = 5
    quick_hours: float = 24
    dormant_days: float = 30
    signed_shapes: tuple[str, ...] = ("safe_exec", "relay_hub")


def scope_map(markets: DataFrame) -> DataFrame:
    """``scope``, ``market``: every market is in "all", in its own scope and, if it has one, in its event's."""
    scopes = F.array(F.lit("all"), F.col("market"), F.concat(F.lit("event:"), F.col("event")))
    return markets.select(F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("scope"), "market")


def before_resolution(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Fills strictly before their market's resolution."""
    return fills.join(markets.select("market", F.col("resolved").alias("_resolved")), "market").where("sec < _resolved").drop("_resolved")


def low_price_stake(early: DataFrame, p: Params) -> DataFrame:
    """Stake of each (market, wallet) at low prices; what needs it by scope adds these up instead of all fills."""
    return early.where((F.col("walk") == "all") & (F.col("side") == "BUY") & (F.col("price") < money(p.low_price))).groupBy("market", "wallet").agg(F.sum(stake()).alias("stake"))


def universe(fills: DataFrame, early: DataFrame, scopes: DataFrame, bypass: DataFrame, p: Params) -> DataFrame:
    """``scope``, ``wallet``, ``passed``, ``bypassed``, ``profiled``: wallets with any fill of walk "all" in the scope, at any time; ``passed``
    looks at scope "all" alone and is the same in every scope."""
    # One row for each (market, wallet) before scopes multiply them.
    present = fills.where("walk = 'all'").select("market", "wallet").distinct().join(scopes, "market").select("scope", "wallet").distinct()
    whole = low_price_stake(early, p).groupBy("wallet").agg(F.sum("stake").alias("low"))
    listed = bypass.select("wallet", F.lit(True).alias("listed")).distinct()
    out = present.join(whole, "wallet", "left").join(listed, "wallet", "left")
    passed = F.coalesce(F.col("low") >= money(p.prefilter_stake), F.lit(False))
    by = F.coalesce("listed", F.lit(False))
    return out.select("scope", "wallet", passed.alias("passed"), by.alias("bypassed"), (passed | by).alias("profiled"))
