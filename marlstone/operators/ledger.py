"""Profit and loss, for display only, and summaries of fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import signed_size, size, stake


def profit_by_market(fills: DataFrame, tokens: DataFrame, markets: DataFrame) -> DataFrame:
    """Cash flows of all fills of walk "all", at any time, and what the winning shares pay; no profit for a void market."""
    zero = F.lit(0)
    legs = fills.where("walk = 'all'").groupBy("wallet", "market", "token").agg(
        F.sum(F.when(F.col("side") == "BUY", stake()).otherwise(zero.cast("decimal(33,16)"))).alias("cash_in"), F.sum(F.when(F.col("side") == "SELL", stake()).otherwise(zero.cast("decimal(33,16)"))).alias("cash_out"), F.sum(signed_size()).alias("net")
    )
    held = legs.join(tokens.select("token", "outcome"), "token").join(markets.select("market", "winner", "void"), "market")
    won = F.when(F.col("outcome") == F.col("winner"), F.col("net")).otherwise(zero.cast("decimal(30,6)"))
    per = held.groupBy("wallet", "market", "void").agg(F.sum("cash_in").alias("cash_in"), F.sum("cash_out").alias("cash_out"), F.sum(won).alias("payout"), F.bool_or(F.col("net") < 0).alias("negative_net"))
    return per.withColumn("profit", F.when(~F.col("void"), F.col("cash_out") - F.col("cash_in") + F.col("payout")))


def profit_by_scope(per_market: DataFrame, users: DataFrame, scopes: DataFrame) -> DataFrame:
    """Sums over the markets of a scope that aren't void, for every wallet in it."""
    fair = ~F.col("void")
    total = lambda c: F.coalesce(F.sum(F.when(fair, F.col(c).cast("decimal(38,16)"))), F.lit(0).cast("decimal(38,16)")).cast("double").alias(c)
    sums = users.select("scope", "wallet").join(per_market.join(scopes, "market"), ["scope", "wallet"], "left")
    return sums.groupBy("scope", "wallet").agg(F.count(F.when(fair, 1)).alias("n_markets"), F.count(F.when(F.col("void"), 1)).alias("n_void"), total("cash_in"), total("cash_out"), total("payout"), total("profit"), F.coalesce(F.bool_or(F.when(fair, F.col("negative_net"))), F.lit(False)).alias("negative_net"))


def crosschecked(per_market: DataFrame, positions: DataFrame, fees: DataFrame) -> DataFrame:
    """``per_market`` with ``positions_total``, the sum that the wallet's own positions state for the market (null where there is none), and
    ``fees_enabled`` of the market (no where it isn't known). Both are shown beside the profit and change nothing."""
    stated = positions.groupBy("wallet", "market").agg(F.sum(F.col("total_pnl").cast("decimal(38,6)")).alias("positions_total"))
    held = per_market.join(stated, ["wallet", "market"], "left").join(fees.select("market", "fees_enabled"), "market", "left")
    return held.withColumn("fees_enabled", F.coalesce("fees_enabled", F.lit(False)))


def fill_summary(fills: DataFrame, scopes: DataFrame, markets: DataFrame, *keys: str) -> DataFrame:
    """Fills at any time and before resolution, and shares, by scope, walk and ``keys``; markets are added up before scopes."""
    held = fills.join(markets.select("market", "resolved"), "market")
    per = held.groupBy("market", "walk", *keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("sec") < F.col("resolved"), 1)).alias("early"), F.sum(size()).alias("shares"))
    return per.join(scopes, "market").groupBy("scope", "walk", *keys).agg(F.sum("n").alias("fills"), F.sum("early").alias("fills_early"), F.sum("shares").cast("double").alias("shares"))


def fill_summary_of_all(fills: DataFrame, scopes: DataFrame, markets: DataFrame, users: DataFrame) -> DataFrame:
    """The same for every wallet of a scope and both walks, zeros included."""
    every = users.select("scope", "wallet", F.explode(F.array(F.lit("all"), F.lit("taker"))).alias("walk"))
    held = every.join(fill_summary(fills, scopes, markets, "wallet"), ["scope", "wallet", "walk"], "left")
    return held.select("scope", "wallet", "walk", F.coalesce("fills", F.lit(0)).alias("fills"), F.coalesce("fills_early", F.lit(0)).alias("fills_early"), F.coalesce("shares", F.lit(0.0)).alias("shares"))
