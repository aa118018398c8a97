"""The eight behavioural signals: for a scope and wallet a raw value and a component in [0, 1], or a reason why there is none.

Each function returns (scope, wallet, raw, component, na, evidence); wallets that it doesn't return have the defaults of ``DEFAULTS``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import clip01, graded, log_scale, minus_log10, money, ramp_down, signed_size, size, stake, tail
from marlstone.operators.mates import linked_mates
from marlstone.operators.universe import Params, low_price_stake

SIGNALS = ("S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8")
#: Fixed values: (raw, component, reason) of a wallet without a row.
DEFAULTS = {
    "S1": (None, None, "not_profiled"),
    "S2": (None, None, "not_profiled"),
    "S3": (0.0, 0.0, None),
    "S4": (None, None, "no_buys"),
    "S5": (None, None, "n_resolved<min"),
    "S6": (None, None, "not_profiled"),
    "S7": (0.0, 0.0, None),
    "S8": (None, None, "not_profiled"),
}


def row(raw: Column, component: Column, na: Column | None = None, evidence: Column | None = None) -> list[Column]:
    """The columns of a result: where there is a reason there are no values; adding 0 removes the sign of a negative zero."""
    na = F.lit(None).cast("string") if na is None else na
    value = lambda x: F.when(na.isNull(), x.cast("double") + F.lit(0.0))
    return [value(raw).alias("raw"), value(component).alias("component"), na.alias("na"), (F.lit("{}") if evidence is None else evidence).alias("evidence")]


def ladder(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, else null."""
    out = None
    for test, reason in rules:
        out = F.when(test, F.lit(reason)) if out is None else out.when(test, F.lit(reason))
    return out


def low_odds(early: DataFrame, scopes: DataFrame, p: Params) -> DataFrame:
    """S3: stake on low prices."""
    sums = low_price_stake(early, p).join(scopes, "market").groupBy("scope", "wallet").agg(F.sum("stake").cast("double").alias("v"))
    return sums.select("scope", "wallet", *low_odds_row(F.col("v"), p))


def low_odds_row(v: Column, p: Params) -> list[Column]:
    return row(v, log_scale(v, p.low_floor, p.low_cap))


def co_buys(buys: DataFrame, window: int) -> DataFrame:
    """For each (wallet, market, sec) of ``buys`` how many other wallets bought the same token within ``window`` seconds, none included.

    The band is an equality on stretches of ``window`` seconds, each buy meeting its own and the two beside it.
    """
    own = buys.select("wallet", "market", "token", "sec").distinct()
    other = buys.select("token", F.col("wallet").alias("other"), F.col("sec").alias("at")).distinct().withColumn("stretch", F.floor(F.col("at") / window))
    near = own.withColumn("stretch", F.explode(F.expr(f"sequence(floor(sec / {window}) - 1, floor(sec / {window}) + 1)")))
    met = near.join(other, ["token", "stretch"]).where((F.col("wallet") != F.col("other")) & (F.abs(F.col("sec") - F.col("at")) <= window))
    counts = met.groupBy("wallet", "market", "sec").agg(F.countDistinct("other").alias("n"))
    keys = ["wallet", "market", "sec"]
    return own.select(*keys).distinct().join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def most_co_buys(early: DataFrame, p: Params) -> DataFrame:
    """For each (wallet, market) the most other wallets around one large low-price buy."""
    large = early.where((F.col("walk") == "all") & (F.col("side") == "BUY") & (F.col("price") < money(p.low_price)) & (stake() >= money(p.together_stake)))
    return co_buys(large, p.together_seconds).groupBy("wallet", "market").agg(F.max("n").alias("n"))


def together(early: DataFrame, scopes: DataFrame, p: Params) -> DataFrame:
    """S7: the most other wallets around one large low-price buy."""
    best = most_co_buys(early, p).join(scopes, "market").groupBy("scope", "wallet").agg(F.max("n").alias("n"))
    return best.select("scope", "wallet", *together_row(F.col("n"), p))


def together_row(n: Column, p: Params) -> list[Column]:
    return row(n, F.least(F.lit(1.0), n / F.lit(float(p.together_full))))


def before_event(early: DataFrame, scopes: DataFrame, tokens: DataFrame, markets: DataFrame, anchors: DataFrame, p: Params) -> DataFrame:
    """S4: how much of what a wallet bought went to the winner within the lead time before the event."""
    held = early.where("walk = 'all' AND side = 'BUY'").join(tokens.select("token", "outcome"), "token").join(markets.select("market", "winner", "void"), "market").join(anchors.select("market", "anchor", F.col("na").alias("anchor_na"), F.lit(True).alias("known")), "market", "left")
    na = F.when(F.col("void"), F.lit("no_winner")).when(F.col("known").isNull(), F.lit("no_event_ts")).otherwise(F.col("anchor_na"))
    ahead = F.col("anchor") - F.col("sec")
    hit = (F.col("outcome") == F.col("winner")) & (ahead > 0) & (ahead <= p.lead_hours * 3600)
    per = held.groupBy("wallet", "market", na.alias("na")).agg(F.sum(stake()).alias("buy"), F.sum(F.when(hit, stake()).otherwise(F.lit(0).cast("decimal(33,16)"))).alias("win"))
    fine = F.col("na").isNull()
    sums = per.join(scopes, "market").groupBy("scope", "wallet").agg(
        F.sum(F.when(fine, F.col("buy"))).cast("double").alias("buy"), F.sum(F.when(fine, F.col("win"))).cast("double").alias("win"),
        F.bool_or(fine).alias("usable"), F.bool_or(F.col("na") == "event_ts_too_coarse").alias("coarse"), F.bool_or(F.col("na") == "no_event_ts").alias("none"),
    )
    return sums.select("scope", "wallet", *before_event_row(p))


def before_event_row(p: Params) -> list[Column]:
    """Of ``buy``, ``win``, ``usable``, ``coarse``, ``none``."""
    reason = ladder((~F.col("usable") & F.coalesce("coarse", F.lit(False)), "event_ts_too_coarse"), (~F.col("usable") & F.coalesce("none", F.lit(False)), "no_event_ts"), (~F.col("usable"), "no_winner"), (F.coalesce("buy", F.lit(0.0)) <= 0, "no_buys"))
    share = F.try_divide(F.col("win"), F.col("buy"))
    return row(share, share * log_scale(F.col("win"), p.lead_floor, p.lead_cap), reason)


def bets(early: DataFrame, scopes: DataFrame, tokens: DataFrame, markets: DataFrame) -> DataFrame:
    """Positions held at resolution: (scope, wallet, market, token, entry, void, won), entry being the mean price bought at."""
    bought = F.col("side") == "BUY"
    per = early.where("walk = 'all'").groupBy("wallet", "market", "token").agg(F.sum(signed_size()).alias("net"), F.sum(F.when(bought, stake())).cast("double").alias("paid"), F.sum(F.when(bought, size())).cast("double").alias("got"))
    held = per.where("net > 0").withColumn("entry", F.try_divide("paid", F.nullif(F.col("got"), F.lit(0.0)))).where("entry IS NOT NULL")
    held = held.join(tokens.select("token", "outcome"), "token").join(markets.select("market", "winner", "void"), "market")
    return held.join(scopes, "market").select("scope", "wallet", "market", "token", "entry", "void", F.coalesce(F.col("outcome") == F.col("winner"), F.lit(False)).alias("won"))


def improbable(held: DataFrame, p: Params) -> DataFrame:
    """S5: how improbable so many wins were at the prices paid."""
    fair = ~F.col("void")
    chance = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("entry")))
    per = held.groupBy("scope", "wallet").agg(
        F.count(F.when(fair, 1)).alias("n"), F.count(F.when(F.col("void"), 1)).alias("void_bets"), F.count(F.when(fair & F.col("won"), 1)).alias("k"), F.sort_array(F.collect_list(F.when(fair, chance))).alias("ps")
    )
    per = with_pval(per, p)
    said = F.when(F.col("reason").isNull(), F.to_json(F.struct("n", "k", "pval"))).otherwise(F.to_json(F.struct("n", "void_bets")))
    return per.select("scope", "wallet", *improbable_row(p, said))


def with_pval(per: DataFrame, p: Params) -> DataFrame:
    """``per`` (``n``, ``k``, ``ps``) with its ``reason`` and ``pval``."""
    some = F.when(F.col("reason").isNull() & (F.col("k") > 0), F.col("k"))
    return with_reason(per, p).withColumn("pval", F.when(F.col("reason").isNull(), F.coalesce(tail(F.when(some.isNotNull(), F.col("ps")), some), F.lit(1.0))))


def with_reason(per: DataFrame, p: Params) -> DataFrame:
    """``per`` (``n``) with the ``reason`` why its wins aren't judged."""
    return per.withColumn("reason", ladder((F.col("n") == 0, "no_winner"), (F.col("n") < p.wins_least, "n_resolved<min")))


def improbable_row(p: Params, said: Column | None = None) -> list[Column]:
    raw = minus_log10(F.col("pval"))
    return row(raw, clip01(raw / p.wins_full), F.col("reason"), said)


def fresh(early: DataFrame, scopes: DataFrame, users: DataFrame, profiles: DataFrame, flags: DataFrame, p: Params) -> DataFrame:
    """S1: how new a wallet was at its first large bet. ``flags``: ``wallet``, ``own_inbound_ok``."""
    first = early.where((F.col("walk") == "all") & (F.col("side") == "BUY") & (stake() >= money(p.fresh_stake))).groupBy("market", "wallet").agg(F.min("sec").alias("bet"))
    first = first.join(scopes, "market").groupBy("scope", "wallet").agg(F.min("bet").alias("bet"))
    held = users.where("profiled").select("scope", "wallet").join(profiles, "wallet", "left").join(first, ["scope", "wallet"], "left").join(flags.select("wallet", "own_inbound_ok"), "wallet", "left")
    return held.select("scope", "wallet", *fresh_row(p))


def fresh_row(p: Params) -> list[Column]:
    """Of ``bet``, a profile's columns and ``own_inbound_ok``."""
    old = F.coalesce(F.col("first_trade") < F.col("lower_bound"), F.lit(False))  # the first trade predates what the search could see
    seen = F.coalesce("own_inbound_ok", F.lit(False))
    cut_off = F.coalesce("truncated", F.lit(False))
    since = F.when(seen & ~cut_off, F.least("first_trade", "first_funding")).otherwise(F.col("first_trade"))
    reason = ladder(
        (F.col("activity_status").isNull() | (F.col("activity_status") == "unavailable"), "activity_unavailable"), (~seen & ~old, "transfers_unverified"), (seen & cut_off & ~old, "funding_window_truncated"), (since.isNull(), "no_first_ts")
    )
    hours = F.greatest(F.lit(0.0), (F.col("bet") - since) / 3600.0)
    none = F.col("bet").isNull()
    said = F.when(reason.isNotNull(), F.lit("{}")).when(none, F.lit('{"no_qualifying_bet":true}')).otherwise(F.to_json(F.struct((F.col("bet") < since).alias("clamped"))))
    return row(F.when(none, F.lit(float("inf"))).otherwise(hours), F.when(none, F.lit(0.0)).otherwise(ramp_down(hours, p.fresh_hours, p.stale_hours)), reason, said)


def concentration(early: DataFrame, scopes: DataFrame, users: DataFrame, profiles: DataFrame, p: Params) -> DataFrame:
    """S2: what a wallet staked in the scope, both sides, of all it ever traded."""
    sums = early.where("walk = 'all'").groupBy("market", "wallet").agg(F.sum(stake()).alias("v")).join(scopes, "market").groupBy("scope", "wallet").agg(F.sum("v").cast("double").alias("v"))
    held = users.where("profiled").select("scope", "wallet").join(profiles.select("wallet", "stats_status", "lifetime_volume"), "wallet", "left").join(sums, ["scope", "wallet"], "left")
    return held.select("scope", "wallet", *concentration_row())


def concentration_row() -> list[Column]:
    """Of ``v`` and a profile's columns."""
    reason = ladder((F.col("stats_status").isNull() | (F.col("stats_status") == "unavailable"), "stats_unavailable"), (F.coalesce("lifetime_volume", F.lit(0.0)) == 0, "no_lifetime_volume"))
    top = F.coalesce("v", F.lit(0.0))
    raw = F.try_divide(top, F.col("lifetime_volume"))
    said = F.when(reason.isNull(), F.to_json(F.struct(top.alias("staked"), F.col("lifetime_volume")))).otherwise(F.lit("{}"))
    return row(raw, clip01(raw), reason, said)


def linked_by_fan(users: DataFrame, profiles: DataFrame, transfers: DataFrame, stop_list: DataFrame, flags: DataFrame, p: Params, directions: Iterable[str] = ("in", "out")) -> DataFrame:
    """S6, older rule: profiled wallets of the same scope that share a counterparty with few wallets around it."""
    profiled = users.where("profiled")
    wallets = profiled.select("wallet").distinct()
    edges = transfers.where(F.col("direction").isin(*directions) & (F.col("hop") <= p.link_hops)).join(wallets, "wallet", "left_semi").join(stop_list, transfers.counterparty == stop_list.address, "left_anti").select("wallet", "counterparty").distinct()
    few = edges.groupBy("counterparty").count().where(F.col("count") <= p.link_fan).select("counterparty")
    links = edges.join(few, "counterparty")
    counts = linked_mates(links, profiled.select("scope", "wallet"))
    n_edges = transfers.groupBy("wallet").agg(F.count(F.lit(1)).alias("edges"))
    held = profiled.select("scope", "wallet").join(profiles.select("wallet", "transfers_status", "truncated"), "wallet", "left").join(n_edges, "wallet", "left").join(counts, ["scope", "wallet"], "left").join(flags.select("wallet", "incomplete", "breadth_truncated", "hub_capped"), "wallet", "left")
    n = F.coalesce("linked", F.lit(0))
    incomplete, cut_off = F.coalesce("incomplete", F.lit(True)), F.coalesce("breadth_truncated", F.lit(False))
    reason = ladder(
        (F.col("transfers_status").isNull() | (F.col("transfers_status") == "unavailable"), "transfers_unavailable"), ((n == 0) & incomplete, "transfers_unverified"), ((n == 0) & cut_off, "breadth_truncated"), (F.coalesce("edges", F.lit(0)) == 0, "no_transfers_found")
    )
    when = lambda test: F.when(test, F.lit(True))  # noqa: E731  null fields are left out of the JSON
    said = F.to_json(F.struct(F.when(F.coalesce("hub_capped", F.lit(0)) > 0, F.col("hub_capped")).alias("hub_capped"), when(F.coalesce("truncated", F.lit(False)) & reason.isNull()).alias("edges_possibly_incomplete"), when((n > 0) & incomplete & reason.isNull()).alias("incomplete_path"), when(cut_off & F.coalesce(reason != "breadth_truncated", F.lit(True)) & ((n > 0) | incomplete)).alias("breadth_truncated_path")))
    return held.select("scope", "wallet", *row(n, clip01(n / F.lit(float(p.link_full))), reason, said))


def linked_by_activity(users: DataFrame, profiles: DataFrame, partners: DataFrame, own: DataFrame, g: int, p: Params) -> DataFrame:
    """S6: natural wallets that share a counterparty of moderate activity; the same in every scope.

    ``partners``: ``wallet``, ``linked``, ``unverified``; ``own``: ``wallet``, ``complete`` (its first-hop records), ``edges`` (as of then).
    An unverified record only matters while the verified component is below 1.
    """
    held = users.where("profiled").select("scope", "wallet").join(profiles.select("wallet", "transfers_status"), "wallet", "left").join(partners, "wallet", "left").join(own, "wallet", "left")
    return held.select("scope", "wallet", *linked_row(g, p))


def linked_row(g: int, p: Params) -> list[Column]:
    """Of ``transfers_status``, ``linked``, ``unverified``, ``complete``, ``edges``."""
    n = F.coalesce("linked", F.lit(0))
    component = graded(n, p.graded_full)
    open_ = component < 1.0
    incomplete, unverified = ~F.coalesce("complete", F.lit(False)), F.coalesce("unverified", F.lit(False))
    status = F.col("transfers_status")
    reason = ladder((status.isNull() | status.isin("unavailable", "capped"), "transfers_unavailable"), (incomplete & open_, "transfers_unverified"), (unverified & open_, "activity_unverified"), (F.coalesce("edges", F.lit(0)) == 0, "no_transfers_found"))
    said = F.when(reason.isNull(), F.to_json(F.struct(F.lit("C1").alias("rule"), F.lit(g).alias("G"), F.when(incomplete | unverified, F.lit(True)).alias("incomplete_path")))).otherwise(F.lit("{}"))
    return row(n, component, reason, said)


def linked_counts(signal: DataFrame) -> DataFrame:
    """Per scope how often S6 has each reason, is positive, and is so on an incomplete path."""
    flagged = F.coalesce(F.get_json_object("evidence", "$.incomplete_path") == "true", F.lit(False))
    positive = F.coalesce(F.col("raw") > 0, F.lit(False))
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    return signal.groupBy("scope").agg(count(F.col("na") == "activity_unverified", "n_activity_unverified"), count(F.col("na") == "transfers_unverified", "n_transfers_unverified"), count(positive, "n_positive"), count(positive & flagged, "n_positive_on_incomplete_path"))


def exits(early: DataFrame, scopes: DataFrame, users: DataFrame, tokens: DataFrame, markets: DataFrame, profiles: DataFrame, redeems: DataFrame, after: DataFrame, p: Params) -> DataFrame:
    """S8: quick redeeming of wins and silence after it; the best of a wallet's winning bets."""
    everyone = users.where("profiled AND scope = 'all'").select("wallet")
    net = early.where("walk = 'all'").join(everyone, "wallet", "left_semi").groupBy("wallet", "market", "token").agg(F.sum(signed_size()).alias("net")).where("net > 0")
    won = net.join(tokens.select("token", "outcome"), "token").join(markets.where("NOT void").select("market", "winner", "resolved"), "market").where("outcome = winner").select("wallet", "market", "resolved")
    first = redeems.groupBy("wallet", "market").agg(F.min(F.struct("sec", "shape")).alias("first")).select("wallet", "market", F.col("first.sec").alias("redeemed"), F.col("first.shape").alias("shape"))
    per = won.join(first, ["wallet", "market"], "left").join(after.select("wallet", "market", "next_trade"), ["wallet", "market"], "left").join(profiles.select("wallet", "snap"), "wallet", "left")
    skip, value = exit_value(p)
    per = per.select("wallet", "market", skip.alias("skip"), value.alias("value")).join(scopes, "market").groupBy("scope", "wallet").agg(F.max("value").alias("best"), F.sort_array(F.collect_set("skip")).alias("skipped"), F.count(F.lit(1)).alias("wins"))
    held = users.where("profiled").select("scope", "wallet").join(profiles.select("wallet", "activity_status"), "wallet", "left").join(per, ["scope", "wallet"], "left")
    return held.select("scope", "wallet", *exits_row())


def exit_value(p: Params) -> tuple[Column, Column]:
    """Why a winning bet is skipped, and else its value; of ``resolved``, ``redeemed``, ``shape``, ``next_trade``, ``snap``."""
    silence = F.col("redeemed") + p.dormant_days * 86400
    skip = ladder((F.col("redeemed").isNull(), ""), (~F.coalesce(F.col("shape").isin(*p.signed_shapes), F.lit(False)), "auto_redeem_unknown"), (F.col("snap").isNull() | (F.col("snap") < silence), "dormancy_unobservable"))
    skip = F.nullif(skip, F.lit(""))
    quick = F.col("redeemed").between(F.col("resolved"), F.col("resolved") + p.quick_hours * 3600)
    silent = F.col("next_trade").isNull() | (F.col("next_trade") > silence)
    half = lambda test: F.when(test, F.lit(0.5)).otherwise(F.lit(0.0))
    value = F.when(F.col("redeemed").isNull(), F.lit(0.0)).when(skip.isNull(), half(quick) + half(silent))
    return skip, value


def exits_row() -> list[Column]:
    """Of ``activity_status``, ``wins``, ``best``, ``skipped``."""
    reason = F.coalesce(ladder((F.col("activity_status").isNull() | (F.col("activity_status") == "unavailable"), "activity_unavailable"), (F.col("wins").isNull(), "no_winning_bet")), F.when(F.col("best").isNull(), F.get("skipped", F.lit(0))))
    said = F.when(reason.isNull(), F.to_json(F.struct("skipped"))).otherwise(F.lit("{}"))
    return row(F.col("best"), F.col("best"), reason, said)


def resolved_shapes(redeems: DataFrame, checked: DataFrame | None, needs_decode: bool = True) -> DataFrame:
    """Redeems with the shape that a second look found, if there is one; a relay call counts only once it is decoded."""
    if checked is None:
        held = redeems.withColumn("shape_2", F.lit(None).cast("string")).withColumn("decoded", F.lit(None).cast("boolean"))
    else:
        held = redeems.join(checked.select("wallet", "market", F.col("shape").alias("shape_2"), "decoded"), ["wallet", "market"], "left")
    shape = F.coalesce("shape_2", "shape")
    doubt = (shape == "relay_hub") & ~F.coalesce("decoded", F.lit(False)) & F.lit(needs_decode)
    return held.withColumn("shape", F.when(doubt, F.lit("relay_hub_unverified")).otherwise(shape)).drop("shape_2", "decoded")


def dense(users: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Every wallet of every scope with every signal: (scope, wallet, signal, raw, component, na, evidence)."""
    sparse = None
    for name, df in found.items():
        own = df.select("scope", "wallet", F.lit(name).alias("signal"), "raw", "component", "na", "evidence")
        sparse = own if sparse is None else sparse.unionByName(own)
    every = users.select("scope", "wallet").withColumn("signal", F.explode(F.array(*[F.lit(s) for s in SIGNALS])))
    held = every.join(sparse.withColumn("has", F.lit(True)), ["scope", "wallet", "signal"], "left")

    def default(i: int, kind: str) -> Column:
        return F.coalesce(*[F.when(F.col("signal") == s, F.lit(v[i]).cast(kind)) for s, v in DEFAULTS.items()])

    pick = lambda c, i, kind: F.when(F.col("has"), F.col(c)).otherwise(default(i, kind)).alias(c)
    return held.select("scope", "wallet", "signal", pick("raw", 0, "double"), pick("component", 1, "double"), pick("na", 2, "string"), F.coalesce("evidence", F.lit("{}")).alias("evidence"))
