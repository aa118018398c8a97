"""Saved pages, bundles and control files to tables; nothing here fetches anything."""

from __future__ import annotations

import hashlib
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRADE_PAGE = "data array<struct<proxy_wallet: string, side: string, token_id: string, condition_id: string, size: double, price: double, timestamp: bigint, transaction_hash: string>>, pagination struct<next_cursor: string>"
HOLDER_PAGE = "data array<struct<token_id: string, holders: array<struct<proxy_wallet: string, amount: double, outcome_index: int>>>>"
MARKET_PAGE = "array<struct<id: string, conditionId: string, question: string, negRisk: boolean, volume: string, clobTokenIds: string, outcomes: string, outcomePrices: string, closedTime: string, createdAt: string, events: array<struct<id: string, title: string>>>>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Files as they are: ``path`` and ``body``, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def with_offset(held: DataFrame) -> DataFrame:
    """``held`` with ``before``: how many rows the earlier pages have. Only the pages' counts are ordered together."""
    counts = held.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(counts.select("page", before.alias("before")), "page")


def trades(raw: DataFrame, snapshot: str, walk: str) -> DataFrame:
    """Trade rows of pages (``page``, ``body``) in page order, ``seq`` counting through all pages; equal rows all stay."""
    held = with_offset(raw.select("page", F.posexplode(F.from_json("body", TRADE_PAGE)["data"]).alias("pos", "t")))
    return held.select(F.lit(snapshot).alias("snapshot"), (F.col("before") + F.col("pos")).cast("int").alias("seq"), F.lit(walk).alias("walk"), F.col("t.condition_id").alias("market"), F.col("t.token_id").alias("token"), F.lower("t.proxy_wallet").alias("wallet"), F.col("t.side").alias("side"), F.col("t.size").alias("size"), F.col("t.price").alias("price"), F.col("t.timestamp").alias("sec"), F.col("t.transaction_hash").alias("tx"))


def holders(raw: DataFrame, snapshot: str) -> DataFrame:
    """Holders of each token of the pages; ``seq`` counts within the snapshot."""
    held = raw.select("page", F.posexplode(F.from_json("body", HOLDER_PAGE)["data"]).alias("i", "t")).select("page", "i", "t.token_id", F.posexplode("t.holders").alias("j", "h"))
    held = with_offset(held.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("i", "j")) - 1))
    return held.select(F.lit(snapshot).alias("snapshot"), (F.col("before") + F.col("pos")).cast("int").alias("seq"), F.col("token_id").alias("token"), F.lower("h.proxy_wallet").alias("wallet"), F.col("h.amount").alias("amount"), F.col("h.outcome_index").alias("outcome"))


def json_list(c: str | Column) -> Column:
    """A JSON list in a text column as an array of strings."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>")


def winner(prices: Column, least: float = 0.99) -> Column:
    """The first outcome whose price is ``least`` or more, from 0; null if none is."""
    place = F.array_position(F.transform(prices, lambda p: F.coalesce(p.cast("double") >= least, F.lit(False))), True)
    return F.when(place > 0, (place - 1).cast("int"))


def markets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markets and tokens of market pages; token i has outcome i, null if there is none."""
    m = raw.select(F.explode(F.from_json("body", MARKET_PAGE)).alias("m")).select("m.*")
    rows = m.select(F.lower("conditionId").alias("market"), F.col("events")[0]["id"].alias("event"), F.col("events")[0]["title"].alias("title"), "question", F.col("volume").cast("double").alias("volume"), winner(json_list("outcomePrices")).alias("api_winner"))
    tokens = m.select(F.lower("conditionId").alias("market"), F.posexplode(json_list("clobTokenIds")).alias("outcome", "token"), json_list("outcomes").alias("names"))
    return rows, tokens.select("token", "market", "outcome", F.get("names", F.col("outcome")).alias("name"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last written row of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def included(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a market list whose ``include`` is True."""
    return spark.read.csv(path, header=True).where("include = 'True'")


def bypass_list(spark: SparkSession, path: str) -> DataFrame:
    """Wallets of the first column named like a wallet or address; trimmed, lower-cased, each once."""
    held = spark.read.csv(path, header=True)
    named = [c for c in held.columns if "wallet" in c.lower() or "address" in c.lower()]
    if not named:
        raise ValueError("no column is named like a wallet or address")
    return held.select(F.lower(F.trim(named[0])).alias("wallet")).where("wallet <> ''").distinct()


def checked_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> DataFrame:
    """A CSV whose headers must be known: ``columns`` maps each name to the headers that may stand for it. Unknown, missing or doubled
    ones are errors."""
    return checked(spark.read.csv(path, header=True), columns, optional)


def checked(held: DataFrame, columns: dict[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows read already."""
    place = {h: name for name, heads in columns.items() for h in (name, *heads)}
    if unknown := [h for h in held.columns if h not in place and h not in optional]:
        raise ValueError(f"unknown columns: {unknown}")
    found: dict[str, str] = {}
    for h in held.columns:
        if h in place:
            if place[h] in found:
                raise ValueError(f"{found[place[h]]} and {h} both stand for {place[h]}")
            found[place[h]] = h
    if missing := [n for n in columns if n not in found]:
        raise ValueError(f"missing columns: {missing}")
    return held.select(*[F.col(h).alias(n) for n, h in found.items()])


def labelled(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """``wallet``, ``label`` (1 for pos), ``unit`` of a labelled list; other labels, or another hash than the one given, are errors."""
    held = checked_csv(spark, path, {"wallet": (), "label": (), "unit": ()})
    if sha256 is not None:
        body = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if body != sha256:
            raise ValueError("the file is not the one that was locked")
    if not held.where("label IS NULL OR label NOT IN ('pos', 'neg')").isEmpty():
        raise ValueError("labels must be pos or neg")
    return held.select(F.lower("wallet").alias("wallet"), (F.col("label") == "pos").cast("int").alias("label"), "unit")


#: The columns of an event file with the older names of two of them, and columns that may stand there unread.
EVENT_COLUMNS = {
    "condition_id": (), "event_ts_utc": (), "event_ts_precision": (), "event_tz": ("event_ts_tz",), "hedged_report_ts_utc": (), "hedged_report_ts_precision": ("hedged_report_precision",),
    "hedged_report_tz": (), "tier_gap": (), "occurrence_ts_precision": (), "event_ts_tz_inferred": (), "hedged_report_tz_inferred": (),
}
EVENT_EXTRA = ("question", "event_id_gamma", "class", "market_type", "resolved_outcome", "outcome_determined_by", "event_id", "related_event_id", "reason", "occurrence_ts_utc", "first_report_ts_utc", "event_ts_basis", "spread_minutes", "closedTime", "bound_ok", "retrieved_at")


def said(c: str) -> Column:
    """A text column trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def yes_or_no(c: str) -> Column:
    """A flag written as a word or digit; null where there is none, an error where it is neither yes nor no."""
    word = F.lower(said(c))
    wrong = F.raise_error(F.concat(F.lit(f"{c} is neither yes nor no: "), word)).cast("boolean")
    return F.when(word.isNull(), F.lit(None).cast("boolean")).when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False).otherwise(wrong)


def iso_seconds(c: str) -> Column:
    """Seconds of an ISO time; without a zone it is UTC. Text that is no time is an error."""
    text = F.regexp_replace(said(c), r"([+-][0-9]{2})$", "$1:00")
    made = F.coalesce(F.try_to_timestamp(text), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"{c} is no time: "), text)).cast("timestamp")))
    return F.unix_seconds(made)


def event_times(held: DataFrame) -> DataFrame:
    """The rows of an event file, read as text, in the form that ``anchors.anchors`` takes. Unknown, missing and doubled columns are
    errors, and so is a time without a word on whether its zone was inferred."""
    rows = checked(held, EVENT_COLUMNS, EVENT_EXTRA)
    term = lambda p, stem: [iso_seconds(f"{stem}_ts_utc").alias(f"{p}_at"), said(f"{stem}_ts_precision").alias(f"{p}_unit")]
    tier = F.coalesce(F.lower(said("tier_gap")).isin("true", "1", "yes"), F.lit(False))
    return rows.select(
        F.lower(F.trim("condition_id")).alias("market"), *term("event", "event"), F.col("event_tz").alias("event_zone"), yes_or_no("event_ts_tz_inferred").alias("event_inferred"),
        *term("report", "hedged_report"), F.col("hedged_report_tz").alias("report_zone"), yes_or_no("hedged_report_tz_inferred").alias("report_inferred"), tier.alias("gap"), said("occurrence_ts_precision").alias("occurrence_unit"),
    )


BUNDLE = """wallet string, t_snap string, activity_asc struct<status: int, body: struct<data: array<struct<timestamp: bigint>>>>,
stats struct<status: int, body: struct<data: struct<all_time_pnl: struct<volume_usdc: double>>>>,
redeems map<string, struct<status: int, body: struct<data: array<struct<timestamp: bigint, transaction_hash: string>>>, next_trade: struct<status: int, body: struct<data: array<struct<timestamp: bigint>>>>>>,
transfers struct<`in`: struct<status: string, edges: array<struct<hop: int, counterparty: string, first_ts: bigint, first_block: bigint, amount: double, n: bigint, tx: string, log_index: bigint>>>,
`out`: struct<status: string, edges: array<struct<hop: int, counterparty: string, first_ts: bigint, first_block: bigint, amount: double, n: bigint, tx: string, log_index: bigint>>>>"""


def bundles(raw: DataFrame) -> DataFrame:
    """Saved answers about one wallet each (``body``: JSON) as columns."""
    return raw.select(F.from_json("body", BUNDLE).alias("b")).select("b.*")


def bundle_profiles(held: DataFrame, infra: DataFrame, lower_block: int, window: int) -> DataFrame:
    """A profile row of each bundle. Funding is the first inbound edge of the first hop that isn't of ``infra``; it may be cut off if it
    lies within ``window`` blocks of ``lower_block``, or if there is none although the wallet has traded."""
    asked = lambda c: F.coalesce(F.col(f"{c}.status") == 200, F.lit(False))
    trades = F.coalesce(F.size("activity_asc.body.data"), F.lit(0)) > 0
    activity = F.when(~asked("activity_asc"), "unavailable").when(trades, "ok").otherwise("empty")
    ways = F.array("transfers.in.status", "transfers.out.status")
    state = F.when(F.array_contains(ways, "capped"), "capped").when(F.array_contains(ways, "unavailable"), "unavailable").otherwise("ok")
    edges = held.select("wallet", F.explode("transfers.in.edges").alias("e")).select("wallet", "e.*").where("hop = 1 AND counterparty IS NOT NULL AND first_ts IS NOT NULL")
    first = edges.join(infra.select(F.col("address").alias("counterparty")), "counterparty", "left_anti").groupBy("wallet").agg(F.min(F.struct("first_ts", "first_block")).alias("f"))
    cut_off = F.coalesce(F.col("f.first_block") <= lower_block + window, F.lit(False)) | (F.col("f.first_ts").isNull() & (activity == "ok"))
    return held.join(first, "wallet", "left").select(
        "wallet", F.when(activity == "ok", F.col("activity_asc.body.data")[0]["timestamp"]).alias("first_trade"), F.col("f.first_ts").alias("first_funding"), F.col("f.first_block").alias("first_funding_block"),
        F.when(asked("stats"), F.col("stats.body.data.all_time_pnl.volume_usdc")).alias("lifetime_volume"), activity.alias("activity_status"), F.when(asked("stats"), "ok").otherwise("unavailable").alias("stats_status"),
        F.when(state == "ok", "ok").otherwise("unavailable").alias("transfers_status"), state.alias("transfers_detail"), cut_off.alias("truncated"), iso_seconds("t_snap").alias("snap"),
    )


def bundle_redeems(held: DataFrame) -> DataFrame:
    """The first redeem of each wallet and market and the next trade after it: null where none was seen or the answer failed."""
    each = held.select("wallet", F.explode("redeems").alias("market", "r")).where("r.status = 200 AND size(r.body.data) > 0")
    first = F.array_min(F.transform("r.body.data", lambda x: F.struct(x["timestamp"].alias("sec"), x["transaction_hash"].alias("tx"))))
    after = F.when(F.col("r.next_trade.status") == 200, F.get("r.next_trade.body.data", F.lit(0))["timestamp"])
    return each.select("wallet", "market", first["sec"].alias("sec"), first["tx"].alias("tx"), after.alias("next_trade"))


def bundle_transfers(held: DataFrame) -> DataFrame:
    """The transfer edges of each bundle, both directions; edges without a counterparty are no edges."""
    way = lambda d: held.select("wallet", F.lit(d).alias("direction"), F.explode(f"transfers.{d}.edges").alias("e"))
    return way("in").unionByName(way("out")).select("wallet", "direction", "e.*").where("counterparty IS NOT NULL")


def locked_toml(path: str, sha256: str) -> dict:
    """Parameters of a TOML file, if it has the hash it was locked with."""
    with open(path, "rb") as f:
        body = f.read()
    if hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError("the file is not the one that was locked")
    return tomllib.loads(body.decode())


def address_of_topic(c: Column) -> Column:
    """The address in a 32-byte topic: its last 40 hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.right(c, F.lit(40))))


def topic_of_address(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.substring(c, 3, 40)), 64, "0"))


def is_address(c: Column) -> Column:
    return c.rlike("^0x[0-9a-f]{40}$")


def payouts(words: Column) -> tuple[Column, Column]:
    """Whether a resolution is void (all payouts equal) and else which outcome won (the largest)."""
    void = F.size(F.array_distinct(words)) == 1
    return void, F.when(~void, (F.array_position(words, F.array_max(words)) - 1).cast("int"))


def resolutions(logs: DataFrame) -> DataFrame:
    """Markets' resolutions from their one log (``market``, ``block``, ``sec``, ``payouts``); several or none for a market are an error."""
    if not logs.groupBy("market").count().where("count <> 1").isEmpty():
        raise ValueError("a market must have exactly one resolution log")
    void, won = payouts(F.col("payouts"))
    return logs.select("market", F.col("sec").alias("resolved"), "block", void.alias("void"), won.alias("winner"))


def last_taker_time(fills: DataFrame, chain: DataFrame) -> DataFrame:
    """``market``, ``reference``: the last taker fill strictly before the resolution."""
    held = fills.where("walk = 'taker'").join(chain.select("market", "resolved"), "market").where("sec < resolved")
    return held.groupBy("market").agg(F.max("sec").alias("reference"))


def winner_differences(chain: DataFrame, api: DataFrame) -> DataFrame:
    """Markets for which chain and API name different winners; recorded, not enforced."""
    return chain.join(api.select("market", "api_winner"), "market").where(F.col("api_winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("api_winner"))).select("market", "winner", "api_winner")


def shape(to: Column, selector: Column, sender: Column, wallet: Column, hub: str, targets: list[str], entry: str) -> Column:
    """What kind of transaction a redeem was; the first rule that holds. Selectors are fixed values."""
    return (
        F.when((to == wallet) & (selector == "0x6a761202"), "safe_exec").when((to == hub) & (selector == "0x405cec67"), "relay_hub")
        .when((sender == wallet) & to.isin(*targets), "direct_eoa").when(to == entry, "erc4337").otherwise("other")
    )


def first_seen(logs: DataFrame) -> DataFrame:
    """Per wallet, direction and counterparty: how many logs, the exact sum, and the first by (block, log_index)."""
    per = logs.groupBy("wallet", "direction", "counterparty").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw").cast("decimal(38,0)")).alias("amount_raw"), F.min(F.struct("block", "log_index", "sec", "tx", "token")).alias("first"))
    return per.select("wallet", "direction", "counterparty", "n", F.col("amount_raw").cast("string").alias("amount_raw"), (F.col("amount_raw") / F.lit(1_000_000)).cast("double").alias("amount"), F.col("first.block").alias("first_block"), F.col("first.log_index").alias("log_index"), F.col("first.sec").alias("first_sec"), F.col("first.tx").alias("tx"), F.col("first.token").alias("token"))


def first_funding(transfers: DataFrame, infra: DataFrame) -> DataFrame:
    """A wallet's first inbound transfer that isn't from infrastructure: ``wallet``, ``first_funding``, ``first_funding_block``."""
    own = transfers.where("hop = 1 AND direction = 'in'").join(infra.select(F.col("address").alias("counterparty")), "counterparty", "left_anti")
    return own.groupBy("wallet").agg(F.min(F.struct("first_sec", "first_block")).alias("f")).select("wallet", F.col("f.first_sec").alias("first_funding"), F.col("f.first_block").alias("first_funding_block"))


def stop_list(infra: DataFrame, seed: DataFrame) -> DataFrame:
    """Addresses of both lists with their ``kind``, each once, infrastructure's first."""
    both = infra.select(F.lower("address").alias("address"), "kind", F.lit(0).alias("_o")).unionByName(seed.select(F.lower("address").alias("address"), "kind", F.lit(1).alias("_o")))
    return both.groupBy("address").agg(F.min(F.struct("_o", "kind"))["kind"].alias("kind"))


def targets(users: DataFrame, won: DataFrame) -> DataFrame:
    """Wallets to profile and the markets that each won in, maybe none."""
    own = users.where("profiled").select("wallet").distinct().join(won.select("wallet", "market").distinct(), "wallet", "left")
    return own.groupBy("wallet").agg(F.sort_array(F.collect_set("market")).alias("markets"))
