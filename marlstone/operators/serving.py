"""What pages show: ranks, markets, prices, positions, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import signed_size, size, stake
from marlstone.operators.ranking import ranked


def as_shown(total: str = "total"):
    """A score as it is shown, to nine places: those that look alike are ties, whatever their last bits."""
    return F.round(total, 9)


def leaderboard(scored: DataFrame, early: DataFrame, scope: str = "all") -> DataFrame:
    """Wallets by score as shown, then name, with the markets each has traded before resolution."""
    hits = early.where("walk = 'all'").select("wallet", "market").distinct().groupBy("wallet").agg(F.count(F.lit(1)).alias("markets_hit"))
    own = scored.where(F.col("scope") == scope).join(hits, "wallet", "left").withColumn("total", as_shown())
    return ranked(own, F.col("total").desc(), F.col("wallet"), name="rank").select(F.col("rank").cast("long").alias("rank"), "wallet", "total", "n_na", F.coalesce("markets_hit", F.lit(0)).alias("markets_hit"))


def top_per_market(scored: DataFrame, n: int = 150) -> DataFrame:
    """The ``n`` best wallets of each market's scope."""
    own = scored.where("scope NOT LIKE 'event:%' AND scope <> 'all'").withColumn("total", as_shown())
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("total").desc(), "wallet"))
    return own.withColumn("place", place.cast("long")).where(F.col("place") <= n).select(F.col("scope").alias("market"), "wallet", "total", "place")


def co_timing_pairs(fills: DataFrame, among: DataFrame, window: int = 600) -> DataFrame:
    """Pairs of wallets (``a`` < ``b``) of ``among`` that bought one token within ``window`` seconds, and how many tokens."""
    own = fills.where("walk = 'all' AND side = 'BUY'").join(among.select("market", "wallet"), ["market", "wallet"], "left_semi").select("market", "token", "wallet", "sec").distinct()
    left = own.withColumn("stretch", F.explode(F.expr(f"sequence(floor(sec / {window}) - 1, floor(sec / {window}) + 1)")))
    right = own.select("market", "token", F.col("wallet").alias("other"), F.col("sec").alias("at"), F.floor(F.col("sec") / window).alias("stretch"))
    met = left.join(right, ["market", "token", "stretch"]).where((F.col("wallet") < F.col("other")) & (F.abs(F.col("sec") - F.col("at")) <= window))
    return met.groupBy("market", F.col("wallet").alias("a"), F.col("other").alias("b")).agg(F.countDistinct("token").alias("tokens"))


def hourly_price(fills: DataFrame) -> DataFrame:
    """Mean price by size of each token and hour, in exact sums, rounded to six places."""
    hour = (F.floor(F.col("sec") / 3600) * 3600).alias("hour")
    sums = fills.where("walk = 'all'").groupBy("market", "token", hour).agg(F.sum(stake()).cast("double").alias("paid"), F.sum(size()).cast("double").alias("shares"), F.count(F.lit(1)).alias("n"))
    return sums.select("market", "token", "hour", F.round(F.try_divide("paid", "shares"), 6).alias("price"), "n")


def market_view(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Taker volume and fills after resolution of each market."""
    held = markets.select("market", "resolved").join(fills, "market", "left")
    taker = F.col("walk") == "taker"
    return held.groupBy("market").agg(F.coalesce(F.sum(F.when(taker, size())), F.lit(0).cast("decimal(30,6)")).cast("double").alias("taker_shares"), F.count(F.when((F.col("walk") == "all") & (F.col("sec") >= F.col("resolved")), 1)).alias("fills_after"))


def holders_at(early: DataFrame) -> DataFrame:
    """How many wallets hold each token when its market resolves, and their shares."""
    net = early.where("walk = 'all'").groupBy("market", "token", "wallet").agg(F.sum(signed_size()).alias("net")).where("net > 0")
    return net.groupBy("market", "token").agg(F.count(F.lit(1)).alias("holders"), F.sum("net").cast("double").alias("shares"))


def mean_entry(bets: DataFrame) -> DataFrame:
    """The mean of a wallet's entry prices in a scope, over the bets that count for improbable wins."""
    from marlstone.functions.numeric import ordered_sum

    fair = bets.where("NOT void")
    return fair.groupBy("scope", "wallet").agg(F.count(F.lit(1)).alias("n"), (ordered_sum(F.col("entry"), F.col("entry")) / F.count(F.lit(1))).alias("entry"))


def wallet_page(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """A wallet's fills as one sorted array, each marked if it came after resolution; one row, so one file, for each wallet and market."""
    held = fills.where("walk = 'all'").join(markets.select("market", "resolved"), "market")
    fill = F.struct("sec", "token", "side", "size", "price", (F.col("sec") >= F.col("resolved")).alias("after"))
    return held.groupBy("wallet", "market").agg(F.sort_array(F.collect_list(fill)).alias("fills"))


def board(scored: DataFrame, least: float, with_data: bool = True, most_na: int = 8) -> DataFrame:
    """Rows that a board shows: scores of ``least`` or more, of wallets that have data."""
    own = scored.where(F.coalesce(F.col("total") >= least, F.lit(False)))
    return own.where(F.col("n_na") < most_na) if with_data else own


def page(df: DataFrame, number: int, size_: int, *order) -> DataFrame:
    """One page of an ordered list: sizes 25, 50 and 100, the number clamped to what there is. The list is cut by ``limit`` first, so no
    task holds more than the pages up to this one."""
    size_ = size_ if size_ in (25, 50, 100) else 50
    pages = max(1, -(-df.count() // size_))
    number = min(max(1, number), pages)
    return df.orderBy(*order).offset((number - 1) * size_).limit(size_)


def thinned(df: DataFrame, group: list[str], order: str, most: int = 400) -> DataFrame:
    """Every k-th point of each group's line, so that about ``most`` stay; the last one stays always."""
    w = Window.partitionBy(*group)
    held = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
    step = F.ceil(F.col("_n") / most)
    return held.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_n", "_i")


def lanes(fills: DataFrame) -> DataFrame:
    """A wallet's fills by bins: an hour at least, and no more than 120 of them over its whole time."""
    spans = fills.groupBy("wallet").agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    width = F.greatest(F.lit(3600), F.ceil((F.col("last") - F.col("first")) / 120 / 3600) * 3600)
    held = fills.join(spans.select("wallet", "first", width.alias("width")), "wallet")
    return held.groupBy("wallet", "width", (F.floor((F.col("sec") - F.col("first")) / F.col("width"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shown(dense: DataFrame, users: DataFrame) -> DataFrame:
    """Signals as pages show them: those that need a profile are not available below the prefilter."""
    return hidden(dense.join(users.select("scope", "wallet", "passed"), ["scope", "wallet"]))


def hidden(held: DataFrame) -> DataFrame:
    """``shown`` where ``passed`` stands in each row."""
    needs = F.col("signal").isin("S1", "S2", "S6", "S8")
    hide = needs & ~F.col("passed")
    return held.select("scope", "wallet", "signal", F.when(~hide, F.col("raw")).alias("raw"), F.when(~hide, F.col("component")).alias("component"), F.when(hide, F.lit("below_prefilter")).otherwise(F.col("na")).alias("na"))


def link_parity(links: DataFrame, signal: DataFrame, scope: str = "all") -> DataFrame:
    """Wallets whose list of links (``wallet``, ``other``) has another length than their signal says."""
    counts = links.groupBy("wallet").agg(F.countDistinct("other").alias("n"))
    own = signal.where((F.col("scope") == scope) & F.col("raw").isNotNull()).select("wallet", "raw")
    return own.join(counts, "wallet", "full").where(F.coalesce("raw", F.lit(0.0)) != F.coalesce("n", F.lit(0))).select("wallet", "raw", F.coalesce("n", F.lit(0)).alias("n"))
