"""Named queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import anchors as anchor_time
from marlstone.functions import numeric as num
from marlstone.operators import audit, graph, ledger, scoring, serving, signals, stats, whole
from marlstone.plans.statements import STATEMENTS
from marlstone.plans.world import AS_OF, World
from marlstone.session import free_shuffles
from marlstone.session import held as computed
from marlstone.sources import pages, sinks

WEIGHTS = {"S1": 1.0, "S2": 1.0, "S3": 1.0, "S4": 1.0, "S5": 1.0, "S6": 1.0, "S7": 1.0, "S8": 1.0}
Make = Callable[[World], DataFrame]
MADE: dict[str, Make] = {}


def query(make: Make) -> Make:
    MADE[make.__name__] = make
    return make


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    """Logarithms and their like differ in the last bit from engine to engine."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def signal(df: DataFrame) -> DataFrame:
    return rounded(df.select("scope", "wallet", "raw", "component", "na"), "raw", "component")


def key_of(wallet: str) -> Column:
    """The number in a wallet's name."""
    return F.substring(wallet, 2, 20).cast("long")


def events(w: World) -> DataFrame:
    """The stream table as buys: users are wallets, event types tokens."""
    return w.t("events").select(F.col("user_id").alias("wallet"), F.col("event_type").alias("market"), F.col("event_type").alias("token"), num.seconds("ts").alias("sec"), "value", "props", "event_id")


def links(w: World) -> DataFrame:
    edges = graph.first_hop(w.transfers, w.users, w.stops, w.block)
    partners = graph.partners(edges, graph.lookup_state(w.lookups, w.seen, w.block), 31)
    return signals.linked_by_activity(w.users, w.profiles, partners, graph.own_records(w.expansions, w.transfers, AS_OF, w.block), 31, w.p)


#: How each signal is made of the world's views.
SIGNALS: dict[str, Make] = {
    "S1": lambda w: signals.fresh(w.early, w.scopes, w.users, w.profiles, w.flags, w.p),
    "S2": lambda w: signals.concentration(w.early, w.scopes, w.users, w.profiles, w.p),
    "S3": lambda w: signals.low_odds(w.early, w.scopes, w.p),
    "S4": lambda w: signals.before_event(w.early, w.scopes, w.tokens, w.markets, w.anchors, w.p),
    "S5": lambda w: signals.improbable(signals.bets(w.early, w.scopes, w.tokens, w.markets), w.p),
    "S6": links,
    "S7": lambda w: signals.together(w.early, w.scopes, w.p),
    "S8": lambda w: signals.exits(w.early, w.scopes, w.users, w.tokens, w.markets, w.profiles, w.redeems, w.after, w.p),
}


def wide(w: World, scope: str | None = None, judged: bool = True) -> DataFrame:
    """Every wallet and all eight signals, in one row; not ``judged``: for their reasons alone."""
    if "narrow" not in vars(w):
        w.keep()
    return w.wide(scope, judged)


def applied(w: World, weights: dict[str, float] = WEIGHTS) -> dict[str, float]:
    return scoring.weights_of(whole.components_found(wide(w, "all")), weights)


def scored(w: World, scope: str | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return whole.scores(wide(w, scope), applied(w, weights))


def dense(w: World) -> DataFrame:
    return whole.long(wide(w))


@query
def scan_filter(w: World) -> DataFrame:
    return w.early.where("walk = 'all' AND side = 'BUY'").where(F.col("price") < num.money(0.2)).select("wallet", "market", "sec", num.stake().cast("double").alias("stake"), "l_orderkey", "l_linenumber")


@query
def scope_map(w: World) -> DataFrame:
    return w.scopes


@query
def universe_prefilter(w: World) -> DataFrame:
    return w.users


@query
def s1_freshness(w: World) -> DataFrame:
    return signal(SIGNALS["S1"](w))


@query
def s2_concentration(w: World) -> DataFrame:
    return signal(SIGNALS["S2"](w))


@query
def s3_low_price_stake(w: World) -> DataFrame:
    return signal(SIGNALS["S3"](w))


@query
def s4_lead_window(w: World) -> DataFrame:
    return signal(SIGNALS["S4"](w))


@query
def s5_bets(w: World) -> DataFrame:
    return rounded(signals.bets(w.early, w.scopes, w.tokens, w.markets), "entry")


@query
def s5_tail(w: World) -> DataFrame:
    return signal(SIGNALS["S5"](w))


@query
def s5_reasons(w: World) -> DataFrame:
    return SIGNALS["S5"](w).where("na IS NOT NULL").select("scope", "wallet", "na", "evidence")


@query
def s6_links_v2(w: World) -> DataFrame:
    w.users.count()  # kept whole before its shuffles go
    free_shuffles(w.users)
    return signal(signals.linked_by_fan(w.users, w.profiles, w.transfers, w.stops, w.flags, w.p))


@query
def s6_links_v3(w: World) -> DataFrame:
    return signal(SIGNALS["S6"](w))


@query
def s6_counts(w: World) -> DataFrame:
    return signals.linked_counts(SIGNALS["S6"](w))


@query
def s6_inbound_only(w: World) -> DataFrame:
    edges = graph.first_hop(w.transfers, w.users, w.stops, w.block)
    state = graph.lookup_state(w.lookups, w.seen, w.block)
    return graph.partners(edges, state, 31, ("in",))


@query
def s6_path_flags(w: World) -> DataFrame:
    return w.flags


@query
def s7_co_timing(w: World) -> DataFrame:
    return signal(SIGNALS["S7"](w))


@query
def s8_exit(w: World) -> DataFrame:
    return signal(SIGNALS["S8"](w))


@query
def redeem_shapes(w: World) -> DataFrame:
    checked = w.redeems.where("sec % 7200 = 0").groupBy("wallet", "market").agg(F.lit("relay_hub").alias("shape"), (F.min("sec") % 14400 == 0).alias("decoded"))
    return signals.resolved_shapes(w.redeems, checked)


@query
def signals_dense(w: World) -> DataFrame:
    return rounded(dense(w), "raw", "component").drop("passed")


@query
def applied_weights(w: World) -> DataFrame:
    return w.spark.createDataFrame(sorted(applied(w).items()), "signal string, weight double")


def totals(w: World, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return rounded(scored(w, weights=weights).drop(*SIGNALS), "total", "total_passed")


@query
def score_total(w: World) -> DataFrame:
    return totals(w)


@query
def score_override(w: World) -> DataFrame:
    return totals(w, scoring.overridden(WEIGHTS, {"S3": 0}))


@query
def score_recompute(w: World) -> DataFrame:
    weights = applied(w)
    planted = key_of("wallet") % 41 == 0  # faults that the check must find, and nothing else
    total = whole.total(weights, "{}")
    stored = whole.components(wide(w)).withColumn("total", F.when(planted, total + 0.001).otherwise(total))
    return rounded(whole.only(stored, scoring.differs({s: F.col(s) for s in SIGNALS}, weights), "scope", "wallet", "total"), "total")


@query
def contributions(w: World) -> DataFrame:
    weights = applied(w)
    return rounded(scoring.contributions(whole.long(wide(w, "all")), weights), "part")


@query
def pending_signals(w: World) -> DataFrame:
    return scoring.pending_of(whole.reasons(wide(w, judged=False)))


@query
def shown_signals(w: World) -> DataFrame:
    return rounded(serving.hidden(dense(w)), "raw", "component")


@query
def full_scores(w: World) -> DataFrame:
    """All eight signals end to end."""
    return totals(w)


@query
def leaderboard(w: World) -> DataFrame:
    held = scored(w, "all").drop(*SIGNALS)
    early = w.fills.join(w.facts.select("market", "resolved"), "market").where("sec < resolved")
    return rounded(serving.leaderboard(held, early), "total")


@query
def board_page(w: World) -> DataFrame:
    return rounded(serving.page(serving.board(scored(w, "all"), 0.1), 2, 25, serving.as_shown().desc(), "wallet").select("wallet", "total"), "total")


@query
def topn_per_market(w: World) -> DataFrame:
    return rounded(serving.top_per_market(scored(w).drop(*SIGNALS), 5), "total")


@query
def pnl_market(w: World) -> DataFrame:
    held = ledger.profit_by_market(w.fills, w.tokens, w.markets)
    return held.select("wallet", "market", "void", *[F.col(c).cast("double").alias(c) for c in ("cash_in", "cash_out", "payout", "profit")], "negative_net")


@query
def pnl_scope(w: World) -> DataFrame:
    return ledger.profit_by_scope(ledger.profit_by_market(w.fills, w.tokens, w.markets), w.users, w.scopes)


@query
def trades_summary(w: World) -> DataFrame:
    return ledger.fill_summary(w.fills, w.scopes, w.markets)


@query
def trades_summary_wallet(w: World) -> DataFrame:
    return ledger.fill_summary_of_all(w.fills, w.scopes, w.markets, w.users)


@query
def co_timing_pairs(w: World) -> DataFrame:
    return serving.co_timing_pairs(w.fills, w.users.where("passed AND scope LIKE 'm%'").select(F.col("scope").alias("market"), "wallet"), 86400)


@query
def vwap_hourly(w: World) -> DataFrame:
    return serving.hourly_price(w.fills)


@query
def vwap_events(w: World) -> DataFrame:
    held = events(w).groupBy("token", (F.floor(F.col("sec") / 3600) * 3600).alias("hour"))
    return held.agg(F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


@query
def market_view(w: World) -> DataFrame:
    return serving.market_view(w.fills, w.markets)


@query
def holders_at_ref(w: World) -> DataFrame:
    return serving.holders_at(w.early)


@query
def mean_entry(w: World) -> DataFrame:
    return rounded(serving.mean_entry(signals.bets(w.early, w.scopes, w.tokens, w.markets)), "entry")


@query
def wallet_lanes(w: World) -> DataFrame:
    return serving.lanes(w.fills)


@query
def thinned_prices(w: World) -> DataFrame:
    return serving.thinned(serving.hourly_price(w.fills).groupBy("market", "hour").agg(F.sum("n").alias("n")), ["market"], "hour", 20)


@query
def wallet_pages(w: World) -> DataFrame:
    return serving.wallet_page(w.fills, w.markets).select("wallet", "market", F.size("fills").cast("long").alias("n"), F.size(F.filter("fills", lambda f: f["after"])).cast("long").alias("n_after"))


@query
def shared_links(w: World) -> DataFrame:
    naturals = w.users.where("scope = 'all' AND bypassed").select("wallet")
    return graph.shared_links(w.transfers.join(naturals, "wallet", "left_semi"))


@query
def link_parity(w: World) -> DataFrame:
    edges = graph.first_hop(w.transfers, w.users, w.stops, w.block)
    state = graph.lookup_state(w.lookups, w.seen, w.block)
    good = graph.lookup_set(edges).join(state, F.col("counterparty") == F.col("address")).where("complete AND activity <= 31").select("counterparty")
    ends = edges.join(good, "counterparty")
    links = ends.select("wallet", "counterparty").distinct().join(ends.where("natural").select("counterparty", F.col("wallet").alias("other")).distinct(), "counterparty").where("wallet <> other")
    counted = links.join(SIGNALS["S6"](w).where("scope = 'all' AND raw IS NOT NULL").select("wallet"), "wallet", "left_semi")
    return serving.link_parity(counted.where(key_of("wallet") % 3 != 0), SIGNALS["S6"](w))  # lists that are lost must be found


@query
def lookup_set(w: World) -> DataFrame:
    return graph.lookup_set(graph.first_hop(w.transfers, w.users, w.stops, w.block))


@query
def lookup_activity(w: World) -> DataFrame:
    return graph.lookup_state(w.lookups, w.seen, w.block)


@query
def gap_free_ranges(w: World) -> DataFrame:
    ranges = F.from_json("subranges", graph.RANGES)
    return w.lookups.select("address", graph.gap_free(ranges, F.col("from_block"), F.col("to_block"), F.col("capped")).alias("gap_free"))


@query
def first_seen_cap(w: World) -> DataFrame:
    logs = w.fills.select(F.concat(F.lit("p"), "l_partkey").alias("address"), F.concat(F.lit("p"), "l_partkey").alias("sender"), F.col("wallet").alias("receiver"), F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("log_index"))
    return graph.capped_neighbours(logs.groupBy("address", "sender", "block", "log_index").agg(F.min("receiver").alias("receiver")), 12)


@query
def traced_paths(w: World) -> DataFrame:
    edges = w.transfers.where("hop = 1").groupBy(F.col("wallet").alias("address"), "counterparty").agg(F.sum("amount").alias("amount"), F.min("first_block").alias("first_block"), F.min("log_index").alias("log_index"))
    back = w.transfers.where("hop = 1").groupBy(F.col("counterparty").alias("address"), F.col("wallet").alias("counterparty")).agg(F.sum("amount").alias("amount"), F.min("first_block").alias("first_block"), F.min("log_index").alias("log_index"))
    return graph.traced(edges.unionByName(back), w.bypass, w.stops, 3, 3, 40)


@query
def log2_histogram(w: World) -> DataFrame:
    edges = graph.first_hop(w.transfers, w.users, w.stops, w.block)
    return graph.activity_histogram(graph.population(edges, graph.lookup_state(w.lookups, w.seen, w.block)))


@query
def knee_g(w: World) -> DataFrame:
    """Where every lookup is capped the threshold is not defined; like its SQL, this table then states the highest one and bin 0."""
    counts = log2_histogram(w).persist()
    found = graph.knee(counts) if counts.where("bin < 8").count() else (256, 0)
    return w.spark.createDataFrame([found], "g int, fullest int")


@query
def block_before(w: World) -> DataFrame:
    blocks = w.t("orders").select(num.seconds("o_orderdate").alias("sec"), F.col("o_orderkey").alias("block"))
    return graph.block_before(blocks, w.markets.select(F.col("market").alias("id"), F.col("resolved").alias("sec")))


def label_rows(w: World) -> DataFrame:
    docs = w.t("documents").select("doc_id", "n_chars")
    return w.t("labels").join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("wallet"), F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 40).cast("string").alias("unit"))


@query
def auc(w: World) -> DataFrame:
    return rounded(stats.auc(label_rows(w), []), "auc")


@query
def weight_grid(w: World) -> DataFrame:
    grid = stats.weight_grid(["S2", "S3", "S7"])
    return w.spark.createDataFrame([(c, s, v) for c, own in grid.items() for s, v in own.items()], "config string, signal string, weight double")


def config_totals(w: World) -> DataFrame:
    held = wide(w, "all").select("wallet", *[F.col(f"{s}.component").alias(s) for s in SIGNALS])
    key = F.substring("wallet", 2, 20).cast("long")
    # Made once, as each reading would make all eight signals again.
    held = computed(held.withColumns({"label": (key % 3 == 0).cast("int"), "unit": (key % 60).cast("string")}))
    return stats.totals_by_config(held, stats.weight_grid(list(SIGNALS)))


@query
def weight_grid_auc(w: World) -> DataFrame:
    return rounded(stats.auc(config_totals(w), ["config"]), "auc", places=6)


@query
def bootstrap_quantile(w: World) -> DataFrame:
    return stats.bootstrap(config_totals(w))


@query
def quantiles(w: World) -> DataFrame:
    held = w.fills.groupBy("market").agg(F.sort_array(F.collect_list("sec")).alias("v"))
    return held.select("market", stats.quantile(F.col("v"), 0.05).alias("p05"), stats.quantile_up(F.col("v"), 0.9).alias("p90"), stats.quartile(F.col("v"), 1).alias("q1"), stats.quartile(F.col("v"), 3).alias("q3"))


@query
def completeness(w: World) -> DataFrame:
    held = w.markets.select((F.substring("market", 2, 9).cast("long") % 25 != 0).alias("exercised"), F.lit(0).alias("misses"), F.lit(7).alias("fills"), F.lit("v1").alias("tool"))
    return rounded(stats.completeness(held), "rate_p95", "unexercised")


@query
def cost_projection(w: World) -> DataFrame:
    return stats.projection(w.t("lineitem"), ["l_returnflag"], "l_quantity", 100).select(F.col("l_returnflag").alias("flag"), F.round("mean", 6).alias("mean"), "p50", "p90")


@query
def shuffle_ts(w: World) -> DataFrame:
    held = w.fills.groupBy("market", "walk", "l_orderkey", "l_linenumber").agg(F.min("sec").alias("sec"))
    return audit.shuffled_times(held, 7, "l_orderkey", "l_linenumber")


@query
def except_all_both(w: World) -> DataFrame:
    a = w.fills.where("l_linenumber <= 3").select("wallet", "market", "side")
    b = w.fills.where("l_linenumber >= 3").select("wallet", "market", "side")
    return audit.differences(a.withColumnRenamed("side", "fill_side"), b.withColumnRenamed("side", "fill_side"))


@query
def column_fingerprint(w: World) -> DataFrame:
    return audit.fingerprints(w.t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 5000)


@query
def dup_key_check(w: World) -> DataFrame:
    return audit.repeated_keys(w.t("lineitem"), "l_orderkey", "l_linenumber")


@query
def na_invariant(w: World) -> DataFrame:
    planted = key_of("wallet") % 53 == 0  # a value beside its reason, and neither of both
    faulty = lambda s, raw: F.struct(F.when(planted, F.lit(raw).cast("double")).otherwise(F.col(f"{s}.raw")).alias("raw"), F.col(f"{s}.na").alias("na"))
    return whole.broken_na(wide(w).withColumns({"S3": faulty("S3", None), "S4": faulty("S4", 0.5)}))


@query
def volume_check(w: World) -> DataFrame:
    held = w.markets.select("market", (F.lit(1.0) * F.substring("market", 2, 9).cast("long") * 50_000).alias("volume"))
    return audit.volume_check(w.fills, held)


@query
def ingest_gates(w: World) -> DataFrame:
    held = w.markets.select("market", (F.lit(1.0) * F.substring("market", 2, 9).cast("long")).alias("volume"))
    return audit.ingest_gates(w.fills.where("l_linenumber <= 5 OR CAST(substring(market, 2, 9) AS BIGINT) % 7 <> 0"), held)


@query
def recount(w: World) -> DataFrame:
    raw = w.fills.select("market", "walk", "size")
    return audit.recount(raw, w.fills.where("l_partkey % 200 <> 0").select("market", "walk", "size"), ["market", "walk"], "size").select("market", "walk", "raw_n", "derived_n", F.col("raw_size").cast("double").alias("raw_size"), F.col("derived_size").cast("double").alias("derived_size"))


@query
def anti_join(w: World) -> DataFrame:
    return w.fills.select("wallet", "market").distinct().join(w.stops.select(F.concat(F.lit("m"), F.substring("address", 2, 9)).alias("market")), "market", "left_anti")


@query
def not_exists(w: World) -> DataFrame:
    return sinks.remaining(w.t("customer").select(F.concat(F.lit("w"), "c_custkey").alias("wallet")), w.fills.where("walk = 'taker' AND price = 0"), "wallet")


@query
def dense_zero_fill(w: World) -> DataFrame:
    tokens = events(w).select("token").distinct()
    hours = w.spark.range(24).select(F.col("id").cast("int").alias("h"))
    every = tokens.join(F.broadcast(hours))  # 24 rows a token
    counts = events(w).groupBy("token", F.hour(F.timestamp_seconds("sec")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, ["token", "h"], "left").select("token", "h", F.coalesce("n", F.lit(0)).alias("n"))


@query
def json_flags(w: World) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events(w).groupBy("token").agg(F.count(F.when(F.col("props").like('%"k": 1%'), 1)).alias("liked"), F.count(F.when(k >= 50, 1)).alias("large"), F.sum(k).alias("total"))


@query
def upsert_latest(w: World) -> DataFrame:
    held = w.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("load_seq"))
    return pages.latest(held, ["l_orderkey", "l_linenumber"], "load_seq").select("l_orderkey", "l_linenumber", "load_seq")


@query
def explode_pages(w: World) -> DataFrame:
    orders = w.t("orders").withColumn("page", F.floor(F.col("o_orderkey") / 1000))
    trade = F.struct(F.concat(F.lit("W"), "o_custkey").alias("proxy_wallet"), F.lit("BUY").alias("side"), F.lit("t").alias("token_id"), F.lit("m").alias("condition_id"), (F.col("o_orderkey") * 1.0).alias("size"), F.lit(0.5).alias("price"), F.col("o_orderkey").alias("timestamp"), F.lit("x").alias("transaction_hash"))
    raw = orders.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", trade.alias("t")))).alias("ts")).select("page", F.to_json(F.struct(F.transform("ts", lambda x: x["t"]).alias("data"))).alias("body"))
    return pages.trades(raw, "SNAP", "all").select("seq", "wallet", "size", "sec")


@query
def market_pages(w: World) -> DataFrame:
    body = F.format_string('[{"id":"%d","conditionId":"0xA%d","question":"q","negRisk":false,"volume":"%d","clobTokenIds":"[\\"t%d\\",\\"u%d\\"]","outcomes":"[\\"Yes\\"]","outcomePrices":"[\\"%s\\",\\"0.995\\"]","events":[{"id":"e%d","title":"T"}]}]', *["s_suppkey"] * 5, F.when(F.col("s_suppkey") % 3 == 0, "0.991").otherwise("0.2"), "s_suppkey")
    rows, tokens = pages.markets(w.t("supplier").select(body.alias("body")))
    return rows.select("market", "event", "volume", "api_winner").join(tokens, "market")


@query
def chain_resolution(w: World) -> DataFrame:
    k = F.substring("market", 2, 9).cast("long")
    logs = w.markets.select("market", F.col("resolved").alias("sec"), k.alias("block"), F.when(k % 10 == 0, F.array(F.lit(1), F.lit(1))).when(k % 2 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("payouts"))
    chain = pages.resolutions(logs)
    return chain.join(pages.last_taker_time(w.fills, chain), "market", "left").select("market", "void", "winner", "reference")


@query
def first_seen_transfers(w: World) -> DataFrame:
    logs = w.transfers.select("wallet", "direction", "counterparty", (F.col("amount") * 1_000_000).cast("decimal(38,0)").cast("string").alias("raw"), F.col("first_block").alias("block"), "log_index", F.col("first_sec").alias("sec"), F.lit("x").alias("tx"), F.lit("t").alias("token"))
    return pages.first_seen(logs).select("wallet", "direction", "counterparty", "n", "amount_raw", "first_block", "log_index")


@query
def profile_targets(w: World) -> DataFrame:
    won = signals.bets(w.early, w.scopes, w.tokens, w.markets).where("scope = 'all' AND won AND NOT void")
    return pages.targets(w.users, won).select("wallet", F.size("markets").alias("n"), F.array_join("markets", ",").alias("markets"))


@query
def stop_list_union(w: World) -> DataFrame:
    infra = w.t("part").where("p_partkey % 50 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("address"), F.lit("infra").alias("kind"))
    seed = w.t("part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("address"), F.lit("seed").alias("kind"))
    return pages.stop_list(infra, seed)


@query
def anchor_floor(w: World) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ("second", "minute", "hour", "day", "month", "year")])
    zones = F.array(*[F.lit(z) for z in ("UTC", "UTC+3", "+03:30", "IRST(UTC+03:30)", "-05:00", "CET", "")])
    k = F.col("o_orderkey")
    held = w.t("orders").select(k.alias("key"), num.seconds("o_orderdate").alias("at"), F.element_at(units, (k % 6 + 1).cast("int")).alias("unit"), F.element_at(zones, (k % 7 + 1).cast("int")).alias("zone"))
    held = held.withColumn("at", F.col("at") + F.col("key") * 37 % 86400)
    minutes = anchor_time.offset_minutes(F.col("zone"))
    return held.select("key", minutes.cast("int").alias("minutes"), anchor_time.start_of_unit(F.col("at"), F.col("unit"), minutes).alias("anchor"))


@query
def strict_json(w: World) -> DataFrame:
    held = w.t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("c_custkey") / 4).alias("ratio"))
    return sinks.json_rows(held, "c_custkey")


@query
def top_buyers(w: World) -> DataFrame:
    won = w.fills.where("side = 'BUY'").join(w.tokens.join(w.markets, "market").where("outcome = winner").select("token"), "token", "left_semi")
    sums = won.groupBy("market", "wallet").agg(F.sum("size").alias("shares"))
    place = F.row_number().over(Window.partitionBy("market").orderBy(F.col("shares").desc(), "wallet"))
    return sums.withColumn("place", place.cast("long")).where("place <= 40").select("market", "wallet", F.col("shares").cast("double").alias("shares"), "place")


@query
def event_anchors(w: World) -> DataFrame:
    """An event file's rows, as text, read and refused by its rules, then anchored."""
    k = F.col("s_suppkey")
    pick = lambda n, *words: F.element_at(F.array(*[F.lit(x) for x in words]), (k % n + 1).cast("int"))
    told = lambda sec, shape: F.date_format(F.timestamp_seconds(sec), shape)
    none, late = k % 11 == 0, k % 3 == 0
    at = F.lit(883612800) + k * 36007
    held = w.t("supplier").select(
        F.concat(F.lit(" M"), "s_suppkey").alias("condition_id"), F.when(~none, told(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_ts_utc"), pick(5, "second", "minute", "hour", "day", "").alias("event_ts_precision"),
        pick(4, "UTC", "+03:30", "CET", "EST(UTC-5)").alias("event_ts_tz"), F.when(~none, F.when(k % 6 == 0, "true").otherwise("no")).alias("event_ts_tz_inferred"),
        F.when(late, told(at + 1800, "yyyy-MM-dd HH:mm:ss")).alias("hedged_report_ts_utc"), F.lit("minute").alias("hedged_report_precision"), F.lit("GMT").alias("hedged_report_tz"), F.when(late, "0").alias("hedged_report_tz_inferred"),
        F.when(k % 8 == 0, "yes").alias("tier_gap"), F.when(k % 16 == 0, "hour").otherwise("day").alias("occurrence_ts_precision"), F.lit("q").alias("question"),
    )
    return anchor_time.anchors(pages.event_times(held), 24)


def bundle_rows(w: World) -> DataFrame:
    """A saved answer for each customer, as JSON text."""
    k = F.col("c_custkey")
    code = lambda n: F.when(k % n == 0, 503).otherwise(200).alias("status")
    stamp = lambda sec, tx: F.struct(sec.alias("timestamp"), F.lit(tx).alias("transaction_hash"))
    edge = lambda who, ts, block: F.struct(F.lit(1).alias("hop"), who.alias("counterparty"), ts.alias("first_ts"), block.alias("first_block"))
    coming = F.when(k % 7 == 0, F.array(edge(F.lit("infra"), F.lit(1), F.lit(1)))).otherwise(F.array(edge(F.concat(F.lit("p"), (k % 100).cast("string")), k + 800000000, k), edge(F.lit("infra"), F.lit(1).cast("long"), F.lit(1).cast("long"))))
    trades = F.when(k % 5 == 0, F.array().cast("array<struct<timestamp:bigint>>")).otherwise(F.array(F.struct((k + 700000000).alias("timestamp"))))
    after = F.struct(code(9), F.struct(F.array(F.struct((k + 50).alias("timestamp"))).alias("data")).alias("body"))
    redeemed = F.struct(code(13), F.struct(F.array(stamp(k + 9, "b"), stamp(k, "a")).alias("data")).alias("body"), after.alias("next_trade"))
    body = F.struct(
        F.concat(F.lit("w"), "c_custkey").alias("wallet"), F.lit("2002-01-01T00:00:00Z").alias("t_snap"), F.struct(code(17), F.struct(trades.alias("data")).alias("body")).alias("activity_asc"),
        F.struct(code(11), F.struct(F.struct(F.struct((k * 1.5).alias("volume_usdc")).alias("all_time_pnl")).alias("data")).alias("body")).alias("stats"), F.create_map(F.concat(F.lit("m"), (k % 10).cast("string")), redeemed).alias("redeems"),
        F.struct(F.struct(F.lit("ok").alias("status"), coming.alias("edges")).alias("in"), F.struct(F.when(k % 23 == 0, "capped").otherwise("ok").alias("status"), F.array(edge(F.lit("z"), k, k)).alias("edges")).alias("out")).alias("transfers"),
    )
    return pages.bundles(w.t("customer").select(F.to_json(body).alias("body")))


@query
def bundle_profiles(w: World) -> DataFrame:
    infra = w.spark.createDataFrame([("infra",)], "address string")
    return pages.bundle_profiles(bundle_rows(w), infra, 90, 20)


@query
def bundle_redeems(w: World) -> DataFrame:
    return pages.bundle_redeems(bundle_rows(w))


@query
def bundle_transfers(w: World) -> DataFrame:
    return pages.bundle_transfers(bundle_rows(w)).select("wallet", "direction", "hop", "counterparty", "first_ts", "first_block")


@query
def topics(w: World) -> DataFrame:
    address = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("c_custkey")), 40, "0"))
    held = w.t("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.upper(address)).otherwise(address).alias("address"))
    topic = pages.topic_of_address(F.col("address"))
    return held.select("c_custkey", topic.alias("topic"), pages.address_of_topic(topic).alias("again"), pages.is_address(F.col("address")).alias("valid"))


@query
def distinct_tuples(w: World) -> DataFrame:
    return w.fills.groupBy("walk").agg(F.countDistinct(F.struct("wallet", "market", "token")).alias("n"))


@query
def utc_text(w: World) -> DataFrame:
    return w.markets.select("market", F.date_format(F.timestamp_seconds("resolved"), "yyyy-MM-dd HH:mm:ss").alias("text"))


@query
def unresolved_markets(w: World) -> DataFrame:
    return audit.unresolved(w.markets.withColumn("resolved", F.when(key_of("market") % 9 != 0, F.col("resolved"))))


@query
def pnl_crosscheck(w: World) -> DataFrame:
    positions = w.lines.select("wallet", F.concat(F.lit("m"), "l_suppkey").alias("market"), (F.col("l_tax") * 1000).alias("total_pnl"))
    fees = w.markets.where(key_of("market") % 4 != 0).select("market", (key_of("market") % 3 == 0).alias("fees_enabled"))
    held = ledger.crosschecked(ledger.profit_by_market(w.fills, w.tokens, w.markets), positions, fees)
    return held.select("wallet", "market", F.col("profit").cast("double").alias("profit"), F.col("positions_total").cast("double").alias("positions_total"), "fees_enabled")


@query
def block_at_or_after(w: World) -> DataFrame:
    blocks = w.t("orders").select(num.seconds("o_orderdate").alias("sec"), F.col("o_orderkey").alias("block"))
    return graph.block_at_or_after(blocks, w.markets.select(F.col("market").alias("id"), F.col("resolved").alias("sec")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, make=make: make(World(spark, sf_dir))) for name, make in MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in STATEMENTS.items() if name in MADE}
