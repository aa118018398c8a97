import json

import pytest

from marlstone.functions import anchors
from marlstone.operators import audit, graph
from marlstone.sources import pages, sinks


def test_trade_pages_count_through(spark):
    row = lambda w: {"proxy_wallet": w, "side": "BUY", "token_id": "1" * 70, "condition_id": "c", "size": 1.5, "price": 0.5, "timestamp": 9, "transaction_hash": "x"}
    raw = spark.createDataFrame([(0, json.dumps({"data": [row("0xA"), row("0xA")]})), (1, json.dumps({"data": [row("0xB")]}))], "page int, body string")
    assert [(r["seq"], r["wallet"]) for r in pages.trades(raw, "S", "all").orderBy("seq").collect()] == [(0, "0xa"), (1, "0xa"), (2, "0xb")]


def test_nested_holders(spark):
    body = {"data": [{"token_id": "t", "holders": [{"proxy_wallet": "0xA", "amount": 1.0, "outcome_index": 0}]}, {"token_id": "u", "holders": []}]}
    assert [(r["seq"], r["token"], r["wallet"]) for r in pages.holders(spark.createDataFrame([(0, json.dumps(body))], "page int, body string"), "S").collect()] == [(0, "t", "0xa")]


def test_control_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("n,Wallet Address\n1, 0xAB \n2,0xab\n3,\n")
    assert [r[0] for r in pages.bypass_list(spark, str(tmp_path / "b.csv")).collect()] == ["0xab"]
    (tmp_path / "l.csv").write_text("wallet,label,unit\n0xA,pos,u\n")
    assert [tuple(r) for r in pages.labelled(spark, str(tmp_path / "l.csv")).collect()] == [("0xa", 1, "u")]
    with pytest.raises(ValueError, match="locked"):
        pages.labelled(spark, str(tmp_path / "l.csv"), "0" * 64)
    (tmp_path / "m.csv").write_text("wallet,label\n0xA,maybe\n")
    with pytest.raises(ValueError, match="missing"):
        pages.labelled(spark, str(tmp_path / "m.csv"))
    with pytest.raises(ValueError, match="unknown"):
        pages.checked_csv(spark, str(tmp_path / "l.csv"), {"wallet": ()})


@pytest.mark.parametrize(("zone", "want"), [("UTC", 0), ("GMT", 0), ("UTC+3", 180), ("+03:30", 210), ("IRST(UTC+03:30)", 210), ("-05:00", -300), ("CET", 840), ("", 840), (None, 840), ("+15:00", 840), ("+01:75", 840), ("Z", 0), ("+330", 210), ("+0330", 210), ("UTC -9", -540), ("EST (GMT-05)", -300), ("E(UTC+1)", 840), ("+1:5", 840), ("+", 840), ("+0a", 840), ("UTC+14", 840), ("UTC-14:00", -840)])
def test_zones(spark, zone, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(zone,)], "z string").select(anchors.offset_minutes(F.col("z"))).first()[0] == want


def test_anchor_is_the_earliest_floor(spark):
    kind = "market string, event_at long, event_unit string, event_zone string, event_inferred boolean, report_at long, report_unit string, report_zone string, report_inferred boolean, gap boolean, occurrence_unit string"
    at = 1_700_000_000
    rows = [("a", at, "hour", "+03:30", False, None, None, None, None, False, None), ("b", at, "day", "UTC", False, None, None, None, None, False, None), ("c", None, None, None, None, None, None, None, None, False, None), ("d", at, "hour", "UTC", False, at, "minute", "UTC", False, True, "day")]
    got = {r["market"]: r for r in anchors.anchors(spark.createDataFrame(rows, kind), 24).collect()}
    assert got["a"]["anchor"] == (at + 12600) // 3600 * 3600 - 12600 and got["a"]["na"] is None
    assert [got[m]["na"] for m in "bcd"] == ["event_ts_too_coarse", "no_event_ts", "event_ts_too_coarse"]


def test_fingerprints_ignore_partitions(spark):
    df = spark.range(500).selectExpr("id % 37 AS a", "CAST(id * 0.5 AS STRING) AS b", "CASE WHEN id % 3 = 0 THEN id END AS c")
    one = sorted(map(tuple, audit.fingerprints(df.repartition(1), 100).collect()))
    assert one == sorted(map(tuple, audit.fingerprints(df.repartition(7), 100).collect()))
    assert audit.differences(df, df.repartition(3)).count() == 0
    assert audit.differences(df, df.where("a <> 1").union(df.limit(1))).count() > 0


def test_manifest_and_json(spark, tmp_path):
    df = spark.createDataFrame([(2, float("inf")), (1, 0.5)], "k int, v double")
    sinks.write_ordered(df, str(tmp_path / "t"), "k", files=1)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_ordered(df, str(tmp_path / "t"), "k", files=1)
    said = json.loads(sinks.manifest(spark, {"t": str(tmp_path / "t")}, {"a": 1}))
    assert said["files"][0]["rows"] == 2
    assert {r["k"]: json.loads(r["json"]) for r in sinks.json_rows(df, "k").collect()} == {2: {"k": 2, "v": None}, 1: {"k": 1, "v": 0.5}}
    assert sinks.manifest_differences(["a", "b"], ["b", "c"]) == {"missing": ["a"], "unlisted": ["c"]}


def test_capped_neighbours(spark):
    logs = spark.createDataFrame([("x", "x", f"y{i % 6}", 100 - i, 0) for i in range(12)] + [("x", "x", "x", 1, 1), ("x", "z", "x", 2, 0), ("x", "z", "x", 2, 0)], "address string, sender string, receiver string, block long, log_index int")
    got = graph.capped_neighbours(logs, 3)
    assert [(r["y"], r["first_block"]) for r in got.orderBy("place").collect()] == [("z", 2), ("y5", 89), ("y4", 90)]
    assert graph.neighbour_caps(got, 3).first()["cap_block"] == 90


EVENT_HEADS = ["condition_id", "event_ts_utc", "event_ts_precision", "event_ts_tz", "hedged_report_ts_utc", "hedged_report_precision", "hedged_report_tz", "tier_gap", "occurrence_ts_precision", "event_ts_tz_inferred", "hedged_report_tz_inferred", "question"]


def event_file(spark, tmp_path, *rows, heads=EVENT_HEADS):
    path = tmp_path / "events.csv"
    path.write_text("\n".join(",".join(r) for r in [heads, *rows]) + "\n")
    return pages.event_times(spark.read.csv(str(path), header=True))


def test_event_file(spark, tmp_path):
    rows = [
        ["C1", "2026-02-03T04:05:06Z", "minute", "UTC", "2026-02-03 04:00", "hour", "+03:30", "no", "", "false", "0", "q"],
        ["c2", "", "", "", "2026-02-03T10:00:00+02", "hour", "UTC", "", "", "", "no", ""],
        ["c3", "2026-02-03T04:05:06", "hour", "UTC", "", "", "", "yes", "day", "no", "", ""],
        ["c4", "", "", "", "", "", "", "", "", "", "", ""],
        ["c5", "2026-02-03T04:05:06Z", "hour", "UTC", "", "", "", "", "", "yes", "", ""],
    ]
    got = {r["market"]: r for r in anchors.anchors(event_file(spark, tmp_path, *rows), 24).collect()}
    noon = 1_770_091_500 // 86400 * 86400  # 2026-02-03T00:00Z
    assert got["c1"]["anchor"] == noon + 3 * 3600 + 1800 and got["c1"]["precision"] == 3600  # 07:30 local is in the hour that began at 03:30Z
    assert got["c2"]["anchor"] == noon + 8 * 3600
    assert got["c3"]["na"] == "event_ts_too_coarse" and got["c4"]["na"] == "no_event_ts"
    assert got["c5"]["anchor"] == noon + 4 * 3600 and got["c5"]["na"] is None


@pytest.mark.parametrize("bad", [{1: "2026-02-03T04:05:06Z", 9: ""}, {1: "soon", 9: "no"}, {1: "2026-02-03T04:05:06Z", 2: "week", 9: "no"}, {1: "2026-02-03T04:05:06Z", 9: "perhaps"}])
def test_event_rows_are_refused(spark, tmp_path, bad):
    row = ["c", *[""] * 11]
    for place, value in bad.items():
        row[place] = value
    with pytest.raises(Exception, match="refused|no time|neither"):
        anchors.anchors(event_file(spark, tmp_path, row), 24).collect()


def test_event_columns_are_refused(spark, tmp_path):
    for heads, what in (([*EVENT_HEADS, "more"], "unknown"), (EVENT_HEADS[1:], "missing"), ([*EVENT_HEADS, "event_tz"], "both")):
        with pytest.raises(ValueError, match=what):
            event_file(spark, tmp_path, heads=heads)


def test_bundles(spark):
    edge = lambda c, ts, block, hop=1: {"hop": hop, "counterparty": c, "first_ts": ts, "first_block": block, "amount": 1.5, "n": 2, "tx": "x", "log_index": 3}
    ok = lambda **data: {"status": 200, "body": data}
    both = lambda into, out=(), state="ok": {"in": {"status": "ok", "edges": list(into)}, "out": {"status": state, "edges": list(out)}}
    volume = ok(data={"all_time_pnl": {"volume_usdc": 7.5}})
    given = [
        {"wallet": "a", "t_snap": "2026-01-01T00:00:00Z", "activity_asc": ok(data=[{"timestamp": 50}]), "stats": volume, "redeems": {"m": ok(data=[{"timestamp": 9, "transaction_hash": "t9"}, {"timestamp": 4, "transaction_hash": "t4"}]) | {"next_trade": ok(data=[{"timestamp": 12}])}, "n": ok(data=[]), "o": {"status": 500}}, "transfers": both([edge("infra", 1, 1), edge("p", 30, 900), edge("q", 20, 950), edge("r", 5, 5, 2), edge(None, 2, 2)])},
        {"wallet": "b", "t_snap": "2026-01-01T00:00:00Z", "activity_asc": ok(data=[]), "stats": {"status": 404}, "redeems": {}, "transfers": both([], [edge("p", 3, 3)], "capped")},
        {"wallet": "c", "t_snap": None, "activity_asc": ok(data=[{"timestamp": 5}]), "stats": ok(data={}), "redeems": {"m": ok(data=[{"timestamp": 1, "transaction_hash": "u"}]) | {"next_trade": {"status": 500}}}, "transfers": both([])},
        {"wallet": "d", "activity_asc": {"status": 503}, "stats": volume, "transfers": both([edge("p", 30, 100)])},
    ]
    held = pages.bundles(spark.createDataFrame([(json.dumps(b),) for b in given], "body string"))
    infra = spark.createDataFrame([("infra",)], "address string")
    got = {r["wallet"]: r for r in pages.bundle_profiles(held, infra, 90, 20).collect()}
    assert [(w, got[w]["activity_status"], got[w]["stats_status"], got[w]["transfers_status"], got[w]["transfers_detail"]) for w in "abcd"] == [("a", "ok", "ok", "ok", "ok"), ("b", "empty", "unavailable", "unavailable", "capped"), ("c", "ok", "ok", "ok", "ok"), ("d", "unavailable", "ok", "ok", "ok")]
    assert [(got[w]["first_trade"], got[w]["first_funding"], got[w]["first_funding_block"], got[w]["lifetime_volume"], got[w]["truncated"]) for w in "abcd"] == [(50, 20, 950, 7.5, False), (None, None, None, None, False), (5, None, None, None, True), (None, 30, 100, 7.5, True)]
    assert got["a"]["snap"] == 1767225600 and got["c"]["snap"] is None
    assert sorted(map(tuple, pages.bundle_redeems(held).collect())) == [("a", "m", 4, "t4", 12), ("c", "m", 1, "u", None)]
    assert sorted((r["wallet"], r["direction"], r["counterparty"]) for r in pages.bundle_transfers(held).collect()) == [("a", "in", "infra"), ("a", "in", "p"), ("a", "in", "q"), ("a", "in", "r"), ("b", "out", "p"), ("d", "in", "p")]


def test_markets_without_resolution_stop_scoring(spark):
    held = spark.createDataFrame([("a", 1), ("b", None)], "market string, resolved long")
    assert audit.resolved_only(held.where("market = 'a'")).count() == 1
    with pytest.raises(ValueError, match="1 markets"):
        audit.resolved_only(held)
