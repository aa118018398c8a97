"""The SQL of each query, in DuckDB's dialect, over the views of ``world.SQL``."""

from __future__ import annotations

from marlstone.plans.world import SQL

DBL = "CAST(CAST({} AS VARCHAR) AS DOUBLE)"


def log_scale(x: str, floor: float, cap: float) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} <= {floor} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, log10({x} / {floor}::DOUBLE) / log10({cap}::DOUBLE / {floor}::DOUBLE))) END"


#: Later views that several statements share.
BETS = """, positions AS (
  SELECT wallet, market, token, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS net,
    CAST(CAST(sum(stake) FILTER (WHERE side = 'BUY') AS VARCHAR) AS DOUBLE) / nullif(CAST(CAST(sum(size) FILTER (WHERE side = 'BUY') AS VARCHAR) AS DOUBLE), 0) AS entry
  FROM early WHERE walk = 'all' GROUP BY 1, 2, 3
), bets AS (
  SELECT s.scope, p.wallet, p.market, p.token, p.entry, m.void, coalesce(t.outcome = m.winner, false) AS won
  FROM positions p JOIN tokens t ON t.token = p.token JOIN markets m ON m.market = p.market JOIN scopes s ON s.market = p.market
  WHERE p.net > 0 AND p.entry IS NOT NULL
)
"""
S3 = f""", s3 AS (
  SELECT scope, wallet, v AS raw, {log_scale('v', 1000, 100000)} AS component, CAST(NULL AS VARCHAR) AS na FROM (
    SELECT s.scope, e.wallet, {DBL.format('sum(e.stake)')} AS v FROM early e JOIN scopes s USING (market)
    WHERE e.walk = 'all' AND e.side = 'BUY' AND e.price < CAST('0.2' AS DECIMAL(12,10)) GROUP BY 1, 2)
)
"""
S2 = f""", s2n AS (
  SELECT s.scope, e.wallet, {DBL.format('sum(e.stake)')} AS v FROM early e JOIN scopes s USING (market) WHERE e.walk = 'all' GROUP BY 1, 2
), s2 AS (
  SELECT scope, wallet, CASE WHEN na IS NULL THEN v / d END AS raw, CASE WHEN na IS NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, v / d)) END AS component, na FROM (
    SELECT u.scope, u.wallet, coalesce(n.v, 0.0::DOUBLE) AS v, p.lifetime_volume AS d,
      CASE WHEN p.stats_status IS NULL OR p.stats_status = 'unavailable' THEN 'stats_unavailable' WHEN coalesce(p.lifetime_volume, 0) = 0 THEN 'no_lifetime_volume' END AS na
    FROM users u LEFT JOIN profiles p USING (wallet) LEFT JOIN s2n n ON n.scope = u.scope AND n.wallet = u.wallet WHERE u.profiled)
)
"""
S7 = """, large AS (
  SELECT DISTINCT wallet, market, token, sec FROM early WHERE walk = 'all' AND side = 'BUY' AND price < CAST('0.2' AS DECIMAL(12,10)) AND stake >= 1000
), around AS (
  SELECT a.wallet, a.market, a.sec, count(DISTINCT b.wallet) AS n FROM large a LEFT JOIN large b ON a.token = b.token AND a.wallet <> b.wallet AND abs(a.sec - b.sec) <= 86400 GROUP BY 1, 2, 3
), s7 AS (
  SELECT s.scope, a.wallet, CAST(max(a.n) AS DOUBLE) AS raw, least(1.0::DOUBLE, max(a.n) / 5.0::DOUBLE) AS component, CAST(NULL AS VARCHAR) AS na FROM around a JOIN scopes s USING (market) GROUP BY 1, 2
)
"""
FLAGS = """, records AS (
  SELECT e.*, e.status = 'ok' AND e.gap_free AND e.to_block_ts >= 1009843200 AS whole
  FROM expansions e SEMI JOIN (SELECT wallet FROM users WHERE profiled) USING (wallet)
), shares AS (
  SELECT t.counterparty, count(DISTINCT t.wallet) AS wallets FROM transfers t SEMI JOIN (SELECT wallet FROM users WHERE profiled) USING (wallet) GROUP BY 1
), judged AS (
  SELECT t.wallet, t.direction, t.via, t.selected, child.status AS next_status,
    t.first_sec < 1009843200 AND NOT t.stop_listed AND t.counterparty <> t.wallet AND stops.address IS NULL AND s.wallets <= 25 AND coalesce(parent.whole AND parent.status <> 'hub', false)
      AND coalesce(child.status <> 'hub', true) AS counts,
    t.selected AND coalesce(child.whole AND (child.has_child_edges OR child.n_logs = 0), false) AS followed
  FROM transfers t JOIN shares s USING (counterparty)
    LEFT JOIN records child ON child.wallet = t.wallet AND child.direction = t.direction AND child.hop = 2 AND child.address = t.counterparty
    LEFT JOIN records parent ON parent.wallet = t.wallet AND parent.direction = t.direction AND parent.hop = 1 AND parent.address = t.via
    LEFT JOIN stops ON stops.address = t.counterparty
  WHERE t.hop = 1
), by_edges AS (
  SELECT wallet, bool_or(lost) AS lost, bool_or(narrow) AS narrow FROM (
    SELECT wallet, bool_or(selected AND next_status IS NULL) AS lost, count(*) FILTER (WHERE counts) > 3 OR coalesce(bool_or(NOT followed) FILTER (WHERE counts), false) AS narrow FROM judged GROUP BY wallet, direction, via)
  GROUP BY wallet
), by_records AS (
  SELECT wallet, bool_or(NOT whole AND status <> 'hub') AS lost, count(*) FILTER (WHERE status = 'hub') AS hubs, bool_or(hop = 1) AS begun,
    bool_and(whole) FILTER (WHERE hop = 1 AND direction = 'in' AND address = wallet AND status <> 'hub') AS inbound
  FROM records GROUP BY wallet
), flags AS (
  SELECT u.wallet, coalesce(e.lost, false) OR coalesce(r.lost, false) OR NOT coalesce(r.begun, false) AS incomplete, coalesce(e.narrow, false) AS breadth_truncated, coalesce(r.hubs, 0) AS hub_capped, coalesce(r.inbound, false) AS own_inbound_ok
  FROM (SELECT DISTINCT wallet FROM users WHERE profiled) u LEFT JOIN by_edges e USING (wallet) LEFT JOIN by_records r USING (wallet)
)
"""
LINKS = """, edges AS (
  SELECT DISTINCT t.wallet, t.counterparty, t.direction, u.passed AS is_natural FROM transfers t JOIN users u ON u.wallet = t.wallet AND u.scope = 'all' AND u.profiled
  WHERE t.hop = 1 AND t.first_block <= (SELECT block FROM until_block) AND t.counterparty NOT IN (SELECT address FROM stops) AND t.counterparty <> t.wallet
), shared AS (
  SELECT counterparty, count(*) AS sharers, count(*) FILTER (WHERE is_natural) AS natural_sharers FROM (SELECT DISTINCT counterparty, wallet, is_natural FROM edges) GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (WHERE is_natural) >= 1
), state AS (
  SELECT l.address, l.whole AND (l.capped OR 100000 >= (SELECT block FROM until_block)) AS complete,
    CASE WHEN NOT (l.capped AND coalesce(l.cap_block <= (SELECT block FROM until_block), false)) THEN coalesce(n.n, 0) END AS activity
  FROM lookups l LEFT JOIN (SELECT address, count(*) AS n FROM seen WHERE first_block <= (SELECT block FROM until_block) GROUP BY 1) n USING (address)
), population AS (
  SELECT x.activity FROM state x JOIN shared ON counterparty = x.address WHERE x.complete AND natural_sharers >= 2
), good AS (
  SELECT counterparty, coalesce(x.complete, false) AS complete, coalesce(x.complete AND x.activity <= 31, false) AS links FROM shared LEFT JOIN state x ON x.address = counterparty
)
"""


def partners(name: str, directions: str) -> str:
    return f""", {name}_own AS (
  SELECT DISTINCT e.wallet, e.counterparty, e.is_natural, g.complete, g.links FROM edges e JOIN good g USING (counterparty) WHERE e.direction IN ({directions})
), {name}_pairs AS (
  SELECT a.wallet, b.wallet AS other, a.complete, a.links FROM {name}_own a JOIN {name}_own b ON a.counterparty = b.counterparty AND a.wallet <> b.wallet AND b.is_natural
), {name} AS (
  SELECT wallet, count(DISTINCT other) FILTER (WHERE links) AS linked, bool_or(NOT complete) AS unverified FROM {name}_pairs GROUP BY 1
)
"""


S6 = (
    LINKS
    + partners("either", "'in', 'out'")
    + """, own AS (
  SELECT wallet, bool_and(status = 'ok' AND gap_free AND to_block_ts >= 1009843200) AS complete FROM expansions WHERE hop = 1 GROUP BY 1
), n_edges AS (
  SELECT wallet, count(*) AS n FROM transfers WHERE hop = 1 AND first_block <= (SELECT block FROM until_block) GROUP BY 1
), s6v AS (
  SELECT u.scope, u.wallet, coalesce(b.linked, 0) AS linked, least(1.0::DOUBLE, ln(1 + coalesce(b.linked, 0)) / ln(21.0::DOUBLE)) AS c, coalesce(NOT o.complete, true) AS incomplete, coalesce(b.unverified, false) AS unverified,
    p.transfers_status AS status, coalesce(e.n, 0) AS n
  FROM users u LEFT JOIN profiles p USING (wallet) LEFT JOIN either b USING (wallet) LEFT JOIN own o USING (wallet) LEFT JOIN n_edges e USING (wallet) WHERE u.profiled
), s6 AS (
  SELECT scope, wallet, CASE WHEN na IS NULL THEN CAST(linked AS DOUBLE) END AS raw, CASE WHEN na IS NULL THEN c END AS component, na, incomplete OR unverified AS path FROM (
    SELECT *, CASE WHEN status IS NULL OR status IN ('unavailable', 'capped') THEN 'transfers_unavailable' WHEN incomplete AND c < 1 THEN 'transfers_unverified' WHEN unverified AND c < 1 THEN 'activity_unverified' WHEN n = 0 THEN 'no_transfers_found' END AS na FROM s6v)
)
"""
)

S1 = """, s1 AS (
  WITH tb AS (
  SELECT s.scope, e.wallet, min(e.sec) AS bet FROM early e JOIN scopes s USING (market) WHERE e.walk = 'all' AND e.side = 'BUY' AND e.stake >= 1000 GROUP BY 1, 2
), x AS (
  SELECT u.scope, u.wallet, p.*, tb.bet, coalesce(f.own_inbound_ok, false) AS seen, coalesce(p.first_trade < p.lower_bound, false) AS old
  FROM users u LEFT JOIN profiles p USING (wallet) LEFT JOIN tb ON tb.scope = u.scope AND tb.wallet = u.wallet LEFT JOIN flags f ON f.wallet = u.wallet WHERE u.profiled
), y AS (
  SELECT *, CASE WHEN seen AND NOT truncated THEN least(first_trade, first_funding) ELSE first_trade END AS since FROM x
), z AS (
  SELECT *, greatest(0.0::DOUBLE, (bet - since) / 3600.0::DOUBLE) AS h, CASE WHEN activity_status IS NULL OR activity_status = 'unavailable' THEN 'activity_unavailable' WHEN NOT seen AND NOT old THEN 'transfers_unverified'
    WHEN seen AND truncated AND NOT old THEN 'funding_window_truncated' WHEN since IS NULL THEN 'no_first_ts' END AS na FROM y
)
SELECT scope, wallet, CASE WHEN na IS NULL THEN CASE WHEN bet IS NULL THEN 'inf'::DOUBLE ELSE h END END AS raw,
  CASE WHEN na IS NULL THEN CASE WHEN bet IS NULL THEN 0.0::DOUBLE WHEN h <= 48 THEN 1.0::DOUBLE WHEN h >= 720 THEN 0.0::DOUBLE ELSE (720.0::DOUBLE - h) / 672.0::DOUBLE END END AS component, na FROM z
)
"""
S4 = f""", s4 AS (
  WITH per AS (
  SELECT e.wallet, e.market, CASE WHEN m.void THEN 'no_winner' WHEN a.market IS NULL THEN 'no_event_ts' ELSE a.na END AS na, sum(e.stake) AS buy,
    sum(CASE WHEN t.outcome = m.winner AND a.anchor - e.sec > 0 AND a.anchor - e.sec <= 1440 * 3600 THEN e.stake ELSE 0 END) AS win
  FROM early e JOIN tokens t ON t.token = e.token JOIN markets m ON m.market = e.market LEFT JOIN anchors a ON a.market = e.market WHERE e.walk = 'all' AND e.side = 'BUY' GROUP BY 1, 2, 3
), g AS (
  SELECT s.scope, p.wallet, {DBL.format("sum(p.buy) FILTER (WHERE p.na IS NULL)")} AS buy, {DBL.format("sum(p.win) FILTER (WHERE p.na IS NULL)")} AS win, count(*) FILTER (WHERE p.na IS NULL) AS usable,
    bool_or(p.na = 'event_ts_too_coarse') AS coarse, bool_or(p.na = 'no_event_ts') AS none FROM per p JOIN scopes s USING (market) GROUP BY 1, 2
), h AS (
  SELECT *, CASE WHEN usable = 0 THEN CASE WHEN coarse THEN 'event_ts_too_coarse' WHEN none THEN 'no_event_ts' ELSE 'no_winner' END WHEN coalesce(buy, 0) <= 0 THEN 'no_buys' END AS na FROM g
)
SELECT scope, wallet, CASE WHEN na IS NULL THEN win / buy END AS raw, CASE WHEN na IS NULL THEN win / buy * {log_scale('win', 1000, 50000)} END AS component, na FROM h
)
"""
S5 = """, s5 AS (
  WITH RECURSIVE fair AS (
  SELECT scope, wallet, least(1 - 1e-6, greatest(1e-6, entry)) AS p, won, row_number() OVER (PARTITION BY scope, wallet ORDER BY entry) AS i FROM bets WHERE NOT void
), cnt AS (
  SELECT b.scope, b.wallet, count(*) FILTER (WHERE NOT void) AS n, count(*) FILTER (WHERE NOT void AND won) AS k FROM bets b GROUP BY 1, 2
), dp(scope, wallet, i, j, q) AS (
  SELECT scope, wallet, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0::DOUBLE FROM cnt WHERE n >= 3
  UNION ALL
  SELECT scope, wallet, i, j, sum(q) FROM (
    SELECT d.scope, d.wallet, d.i + 1 AS i, d.j + o.o AS j, CASE WHEN o.o = 1 THEN d.q * f.p ELSE d.q * (1 - f.p) END AS q
    FROM dp d JOIN fair f ON f.scope = d.scope AND f.wallet = d.wallet AND f.i = d.i + 1 CROSS JOIN (VALUES (0), (1)) o(o)) GROUP BY 1, 2, 3, 4
), tails AS (
  SELECT c.scope, c.wallet, CASE WHEN c.k = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, sum(d.q))) END AS pval FROM cnt c JOIN dp d ON d.scope = c.scope AND d.wallet = c.wallet AND d.i = c.n AND d.j >= c.k GROUP BY c.scope, c.wallet, c.k
)
SELECT c.scope, c.wallet, CASE WHEN c.n >= 3 THEN -log10(greatest(t.pval, 1e-300)) + 0.0 END AS raw, CASE WHEN c.n >= 3 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, -log10(greatest(t.pval, 1e-300)) / 6)) END AS component,
  CASE WHEN c.n = 0 THEN 'no_winner' WHEN c.n < 3 THEN 'n_resolved<min' END AS na FROM cnt c LEFT JOIN tails t USING (scope, wallet)
)
"""
S8 = """, s8 AS (
  WITH net AS (
  SELECT e.wallet, e.market, e.token, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS net FROM early e JOIN users u ON u.wallet = e.wallet AND u.scope = 'all' AND u.profiled WHERE e.walk = 'all' GROUP BY 1, 2, 3
), won AS (
  SELECT n.wallet, n.market, m.resolved FROM net n JOIN tokens t ON t.token = n.token JOIN markets m ON m.market = n.market WHERE n.net > 0 AND NOT m.void AND t.outcome = m.winner
), fr AS (
  SELECT wallet, market, sec AS redeemed, shape FROM (SELECT *, row_number() OVER (PARTITION BY wallet, market ORDER BY sec, shape) AS rn FROM redeems) WHERE rn = 1
), per AS (
  SELECT w.wallet, w.market, CASE WHEN f.redeemed IS NULL THEN NULL WHEN f.shape NOT IN ('safe_exec', 'relay_hub') THEN 'auto_redeem_unknown' WHEN p.snap IS NULL OR p.snap < f.redeemed + 30 * 86400 THEN 'dormancy_unobservable' END AS skip,
    f.redeemed, w.resolved, a.next_trade
  FROM won w LEFT JOIN fr f USING (wallet, market) LEFT JOIN after a USING (wallet, market) LEFT JOIN profiles p ON p.wallet = w.wallet
), val AS (
  SELECT wallet, market, skip, CASE WHEN redeemed IS NULL THEN 0.0::DOUBLE WHEN skip IS NULL THEN CASE WHEN redeemed - resolved BETWEEN 0 AND 24 * 3600 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN next_trade IS NULL OR next_trade > redeemed + 30 * 86400 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS v FROM per
), g AS (
  SELECT s.scope, v.wallet, max(v.v) AS best, min(v.skip) AS reason, count(*) AS n FROM val v JOIN scopes s USING (market) GROUP BY 1, 2
), x AS (
  SELECT u.scope, u.wallet, g.best, CASE WHEN p.activity_status IS NULL OR p.activity_status = 'unavailable' THEN 'activity_unavailable' WHEN g.n IS NULL THEN 'no_winning_bet' WHEN g.best IS NULL THEN g.reason END AS na
  FROM users u LEFT JOIN profiles p USING (wallet) LEFT JOIN g ON g.scope = u.scope AND g.wallet = u.wallet WHERE u.profiled
)
SELECT scope, wallet, CASE WHEN na IS NULL THEN best END AS raw, CASE WHEN na IS NULL THEN best END AS component, na FROM x
)
"""
NAMES = tuple(f"S{k}" for k in range(1, 9))
DENSE = (
    FLAGS + BETS + S1 + S2 + S3 + S4 + S5 + S6 + S7 + S8
    + f""", sparse AS (
  {" UNION ALL ".join(f"SELECT scope, wallet, '{n}' AS signal, raw, component, na FROM {n.lower()}" for n in NAMES)}
), signals AS (
  SELECT unnest({list(NAMES)}) AS signal
), dense AS MATERIALIZED (
  SELECT u.scope, u.wallet, g.signal, CASE WHEN x.signal IS NOT NULL THEN x.raw WHEN g.signal IN ('S3', 'S7') THEN 0.0::DOUBLE END AS raw,
    CASE WHEN x.signal IS NOT NULL THEN x.component WHEN g.signal IN ('S3', 'S7') THEN 0.0::DOUBLE END AS component,
    CASE WHEN x.signal IS NOT NULL THEN x.na WHEN g.signal IN ('S3', 'S7') THEN NULL WHEN g.signal = 'S4' THEN 'no_buys' WHEN g.signal = 'S5' THEN 'n_resolved<min' ELSE 'not_profiled' END AS na
  FROM users u CROSS JOIN signals g LEFT JOIN sparse x ON x.scope = u.scope AND x.wallet = u.wallet AND x.signal = g.signal
)
"""
)


def total(weight: str) -> str:
    """A row's parts, added in the order of the signals."""
    return "0.0::DOUBLE + " + " + ".join(f"coalesce(sum({weight} * component) FILTER (WHERE signal = '{n}'), 0.0::DOUBLE)" for n in NAMES)


SCORED = (
    DENSE
    + f""", usable AS (
  SELECT signal FROM dense WHERE scope = 'all' GROUP BY 1 HAVING count(component) > 0
), weights AS (
  SELECT g.signal, CASE WHEN u.signal IS NOT NULL THEN 1.0::DOUBLE / (SELECT count(*) FROM usable) ELSE 0.0::DOUBLE END AS weight FROM signals g LEFT JOIN usable u USING (signal)
), scored AS MATERIALIZED (
  SELECT scope, wallet, {total("weight")} AS total, count(na) AS n_na FROM dense JOIN weights USING (signal) GROUP BY 1, 2
)
"""
)


def signal(name: str) -> str:
    return f"SELECT scope, wallet, round(raw, 9) AS raw, round(component, 9) AS component, na FROM {name}"


PNL = """, flows AS (
  SELECT wallet, market, token, coalesce(sum(worth) FILTER (WHERE side = 'BUY'), 0) AS paid, coalesce(sum(worth) FILTER (WHERE side = 'SELL'), 0) AS got,
    coalesce(sum(size) FILTER (WHERE side = 'BUY'), 0) - coalesce(sum(size) FILTER (WHERE side = 'SELL'), 0) AS held
  FROM (SELECT *, CAST(size * price AS DECIMAL(38,16)) AS worth FROM fills WHERE walk = 'all') GROUP BY ALL
), pnl AS (
  SELECT wallet, market, void, cash_in, cash_out, payout, CASE WHEN NOT void THEN cash_out + payout - cash_in END AS profit, negative_net FROM (
    SELECT x.wallet, x.market, m.void, sum(x.paid) AS cash_in, sum(x.got) AS cash_out, coalesce(sum(x.held) FILTER (WHERE t.outcome = m.winner), 0) AS payout, min(x.held) < 0 AS negative_net
    FROM flows x JOIN tokens t ON t.token = x.token JOIN markets m ON m.market = x.market GROUP BY 1, 2, 3)
)
"""
HOURS = """, hours AS (
  SELECT market, token, sec // 3600 * 3600 AS hour, CAST(CAST(sum(CAST(size * price AS DECIMAL(38,16))) AS VARCHAR) AS DOUBLE) AS paid, CAST(CAST(sum(size) AS VARCHAR) AS DOUBLE) AS shares, count(*) AS n
  FROM fills WHERE walk = 'all' GROUP BY 1, 2, 3
)
"""
EVENTS = "SELECT user_id AS wallet, event_type AS token, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value, props FROM events"
GRID = """, configs AS (
  SELECT 'W0' AS config, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c UNION ALL SELECT 'LOO_S2', 0, 1, 1 UNION ALL SELECT 'LOO_S3', 1, 0, 1 UNION ALL SELECT 'LOO_S7', 1, 1, 0
  UNION ALL SELECT 'DBL_S2', 2, 1, 1 UNION ALL SELECT 'DBL_S3', 1, 2, 1 UNION ALL SELECT 'DBL_S7', 1, 1, 2
)
"""

STATEMENTS = {
    "scan_filter": SQL + f"SELECT wallet, market, sec, {DBL.format('stake')} AS stake, l_orderkey, l_linenumber FROM early WHERE walk = 'all' AND side = 'BUY' AND price < CAST('0.2' AS DECIMAL(12,10))",
    "scope_map": SQL + "SELECT scope, market FROM scopes",
    "universe_prefilter": SQL + "SELECT * FROM users",
    "s1_freshness": SQL + FLAGS + S1 + signal("s1"),
    "s2_concentration": SQL + S2 + signal("s2"),
    "s3_low_price_stake": SQL + S3 + signal("s3"),
    "s4_lead_window": SQL + S4 + signal("s4"),
    "s5_bets": SQL + BETS + "SELECT scope, wallet, market, token, round(entry, 9) AS entry, void, won FROM bets",
    "s5_reasons": SQL + BETS + """, n AS (SELECT scope, wallet, count(*) FILTER (WHERE NOT void) AS n, count(*) FILTER (WHERE void) AS v FROM bets GROUP BY 1, 2)
SELECT scope, wallet, CASE WHEN n = 0 THEN 'no_winner' ELSE 'n_resolved<min' END AS na, '{"n":' || n || ',"void_bets":' || v || '}' AS evidence FROM n WHERE n < 3""",
    "s5_tail": SQL + BETS + S5 + signal("s5"),
    "s6_links_v2": SQL + FLAGS + """, e2 AS (
  SELECT DISTINCT t.wallet, t.counterparty FROM transfers t SEMI JOIN (SELECT wallet FROM users WHERE profiled) USING (wallet) WHERE t.hop <= 2 AND t.counterparty NOT IN (SELECT address FROM stops)
), l2 AS (
  SELECT * FROM e2 WHERE counterparty IN (SELECT counterparty FROM e2 GROUP BY 1 HAVING count(*) <= 25)
), pr AS (
  SELECT DISTINCT a.wallet, b.wallet AS other FROM l2 a JOIN l2 b ON a.counterparty = b.counterparty AND a.wallet <> b.wallet
), cn AS (
  SELECT u.scope, u.wallet, count(*) AS linked FROM users u JOIN pr ON pr.wallet = u.wallet JOIN users v ON v.scope = u.scope AND v.wallet = pr.other AND v.profiled WHERE u.profiled GROUP BY 1, 2
), x AS (
  SELECT u.scope, u.wallet, p.transfers_status AS st, coalesce(n.n, 0) AS edges, coalesce(c.linked, 0) AS linked, coalesce(f.incomplete, true) AS inc, coalesce(f.breadth_truncated, false) AS cut
  FROM users u LEFT JOIN profiles p USING (wallet) LEFT JOIN (SELECT wallet, count(*) AS n FROM transfers GROUP BY 1) n USING (wallet) LEFT JOIN cn c ON c.scope = u.scope AND c.wallet = u.wallet LEFT JOIN flags f ON f.wallet = u.wallet WHERE u.profiled
), y AS (
  SELECT *, CASE WHEN st IS NULL OR st = 'unavailable' THEN 'transfers_unavailable' WHEN linked = 0 AND inc THEN 'transfers_unverified' WHEN linked = 0 AND cut THEN 'breadth_truncated' WHEN edges = 0 THEN 'no_transfers_found' END AS na FROM x
)
SELECT scope, wallet, CASE WHEN na IS NULL THEN CAST(linked AS DOUBLE) END AS raw, CASE WHEN na IS NULL THEN least(1.0::DOUBLE, linked / 5.0::DOUBLE) END AS component, na FROM y""",
    "s6_links_v3": SQL + S6 + signal("s6"),
    "s6_counts": SQL + S6 + """SELECT scope, count(*) FILTER (WHERE na = 'activity_unverified') AS n_activity_unverified, count(*) FILTER (WHERE na = 'transfers_unverified') AS n_transfers_unverified,
  count(*) FILTER (WHERE raw > 0) AS n_positive, count(*) FILTER (WHERE raw > 0 AND path) AS n_positive_on_incomplete_path FROM s6 GROUP BY 1""",
    "s6_inbound_only": SQL + LINKS + partners("inward", "'in'") + "SELECT wallet, linked, unverified FROM inward",
    "s6_path_flags": SQL + FLAGS + "SELECT * FROM flags",
    "s7_co_timing": SQL + S7 + signal("s7"),
    "s8_exit": SQL + S8 + signal("s8"),
    "redeem_shapes": SQL + """, checked AS (
  SELECT wallet, market, 'relay_hub' AS shape2, min(sec) % 14400 = 0 AS decoded FROM redeems WHERE sec % 7200 = 0 GROUP BY 1, 2
)
SELECT r.wallet, r.market, r.sec, CASE WHEN coalesce(c.shape2, r.shape) = 'relay_hub' AND NOT coalesce(c.decoded, false) THEN 'relay_hub_unverified' ELSE coalesce(c.shape2, r.shape) END AS shape FROM redeems r LEFT JOIN checked c USING (wallet, market)""",
    "signals_dense": SQL + DENSE + "SELECT scope, wallet, signal, round(raw, 9) AS raw, round(component, 9) AS component, na FROM dense",
    "applied_weights": SQL + SCORED + "SELECT signal, weight FROM weights",
    "score_total": SQL + SCORED + "SELECT s.scope, s.wallet, round(s.total, 9) AS total, CASE WHEN u.passed THEN round(s.total, 9) END AS total_passed, s.n_na FROM scored s JOIN users u USING (scope, wallet)",
    "score_override": SQL + SCORED + f""", w AS (
  SELECT g.signal, CASE WHEN u.signal IS NOT NULL AND g.signal <> 'S3' THEN 1.0::DOUBLE / (SELECT count(*) FROM usable WHERE signal <> 'S3') ELSE 0.0::DOUBLE END AS weight FROM signals g LEFT JOIN usable u USING (signal)
), o AS (
  SELECT scope, wallet, {total("weight")} AS total, count(na) AS n_na FROM dense JOIN w USING (signal) GROUP BY 1, 2
)
SELECT o.scope, o.wallet, round(o.total, 9) AS total, CASE WHEN u.passed THEN round(o.total, 9) END AS total_passed, o.n_na FROM o JOIN users u USING (scope, wallet)""",
    "score_recompute": SQL + SCORED + "SELECT scope, wallet, round(total + 0.001, 9) AS total FROM scored WHERE CAST(wallet[2:] AS BIGINT) % 41 = 0",
    "contributions": SQL + SCORED + """, c AS (SELECT d.scope, d.wallet, d.signal, coalesce(w.weight * d.component, 0) AS part FROM dense d JOIN weights w USING (signal) WHERE d.scope = 'all')
SELECT scope, wallet, signal, round(part, 9) AS part, round(part, 4) AS printed, rank() OVER (PARTITION BY scope, wallet ORDER BY round(part, 4) DESC) <= 2 AND round(part, 4) > 0 AS driver FROM c""",
    "pending_signals": SQL + DENSE + """, n AS (SELECT signal, na, count(*) AS n, row_number() OVER (PARTITION BY signal ORDER BY count(*) DESC, na) AS rn FROM dense GROUP BY 1, 2)
SELECT signal, na, n FROM n WHERE rn = 1 AND signal NOT IN (SELECT signal FROM dense WHERE na IS NULL)""",
    "shown_signals": SQL + DENSE + """SELECT d.scope, d.wallet, d.signal, CASE WHEN NOT h THEN round(raw, 9) END AS raw, CASE WHEN NOT h THEN round(component, 9) END AS component, CASE WHEN h THEN 'below_prefilter' ELSE na END AS na
FROM (SELECT d.*, d.signal IN ('S1', 'S2', 'S6', 'S8') AND NOT u.passed AS h FROM dense d JOIN users u USING (scope, wallet)) d""",
    "full_scores": SQL + SCORED + "SELECT s.scope, s.wallet, round(s.total, 9) AS total, CASE WHEN u.passed THEN round(s.total, 9) END AS total_passed, s.n_na FROM scored s JOIN users u USING (scope, wallet)",
    "leaderboard": SQL + SCORED + """SELECT row_number() OVER (ORDER BY round(s.total, 9) DESC, s.wallet) AS rank, s.wallet, round(s.total, 9) AS total, s.n_na, coalesce(h.n, 0) AS markets_hit
FROM scored s LEFT JOIN (SELECT wallet, count(DISTINCT market) AS n FROM early WHERE walk = 'all' GROUP BY 1) h USING (wallet) WHERE s.scope = 'all'""",
    "board_page": SQL + SCORED + "SELECT wallet, round(total, 9) AS total FROM scored WHERE scope = 'all' AND total >= 0.1 AND n_na < 8 ORDER BY round(scored.total, 9) DESC, wallet LIMIT 25 OFFSET 25",
    "topn_per_market": SQL + SCORED + """SELECT market, wallet, total, place FROM (SELECT scope AS market, wallet, round(total, 9) AS total, row_number() OVER (PARTITION BY scope ORDER BY round(scored.total, 9) DESC, wallet) AS place FROM scored
WHERE scope NOT LIKE 'event:%' AND scope <> 'all') WHERE place <= 5""",
    "pnl_market": SQL + PNL + f"SELECT wallet, market, void, {', '.join(DBL.format(c) + ' AS ' + c for c in ('cash_in', 'cash_out', 'payout', 'profit'))}, negative_net FROM pnl",
    "pnl_scope": SQL + PNL + f""", j AS (SELECT s.scope, p.* FROM pnl p JOIN scopes s USING (market))
SELECT u.scope, u.wallet, count(j.market) FILTER (WHERE NOT j.void) AS n_markets, count(j.market) FILTER (WHERE j.void) AS n_void,
  {', '.join(DBL.format(f"coalesce(sum(j.{c}) FILTER (WHERE NOT j.void), 0)") + ' AS ' + c for c in ('cash_in', 'cash_out', 'payout', 'profit'))}, coalesce(bool_or(j.negative_net) FILTER (WHERE NOT j.void), false) AS negative_net
FROM users u LEFT JOIN j ON j.scope = u.scope AND j.wallet = u.wallet GROUP BY 1, 2""",
    "trades_summary": SQL + f"SELECT s.scope, f.walk, count(*) AS fills, count(*) FILTER (WHERE f.sec < m.resolved) AS fills_early, {DBL.format('sum(f.size)')} AS shares FROM fills f JOIN scopes s USING (market) JOIN markets m ON m.market = f.market GROUP BY 1, 2",
    "trades_summary_wallet": SQL + f""", a AS (
  SELECT s.scope, f.walk, f.wallet, count(*) AS fills, count(*) FILTER (WHERE f.sec < m.resolved) AS fills_early, {DBL.format('sum(f.size)')} AS shares FROM fills f JOIN scopes s USING (market) JOIN markets m ON m.market = f.market GROUP BY 1, 2, 3
)
SELECT u.scope, u.wallet, w.walk, coalesce(a.fills, 0) AS fills, coalesce(a.fills_early, 0) AS fills_early, coalesce(a.shares, 0.0::DOUBLE) AS shares
FROM users u CROSS JOIN (VALUES ('all'), ('taker')) w(walk) LEFT JOIN a ON a.scope = u.scope AND a.walk = w.walk AND a.wallet = u.wallet""",
    "co_timing_pairs": SQL + """, b AS (
  SELECT DISTINCT f.market, f.token, f.wallet, f.sec FROM fills f JOIN users u ON u.scope = f.market AND u.wallet = f.wallet AND u.passed WHERE f.walk = 'all' AND f.side = 'BUY'
)
SELECT x.market, x.wallet AS a, y.wallet AS b, count(DISTINCT x.token) AS tokens FROM b x JOIN b y ON x.token = y.token AND x.wallet < y.wallet AND abs(x.sec - y.sec) <= 86400 GROUP BY 1, 2, 3""",
    "vwap_hourly": SQL + HOURS + "SELECT market, token, hour, round(paid / shares, 6) AS price, n FROM hours",
    "vwap_events": f"WITH e AS ({EVENTS}) SELECT token, sec // 3600 * 3600 AS hour, {DBL.format('sum(CAST(value AS DECIMAL(20,6)))')} AS value, count(*) AS n FROM e GROUP BY 1, 2",
    "market_view": SQL + f"""SELECT m.market, {DBL.format("coalesce(sum(f.size) FILTER (WHERE f.walk = 'taker'), 0)")} AS taker_shares, count(*) FILTER (WHERE f.walk = 'all' AND f.sec >= m.resolved) AS fills_after FROM markets m LEFT JOIN fills f USING (market) GROUP BY 1""",
    "holders_at_ref": SQL + f""", n AS (SELECT market, token, wallet, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS net FROM early WHERE walk = 'all' GROUP BY 1, 2, 3)
SELECT market, token, count(*) AS holders, {DBL.format('sum(net)')} AS shares FROM n WHERE net > 0 GROUP BY 1, 2""",
    "mean_entry": SQL + BETS + "SELECT scope, wallet, count(*) AS n, round(avg(entry), 9) AS entry FROM bets WHERE NOT void GROUP BY 1, 2",
    "wallet_lanes": SQL + """, s AS (SELECT wallet, min(sec) AS first, greatest(3600, CAST(ceil((max(sec) - min(sec)) / 120 / 3600) AS BIGINT) * 3600) AS width FROM fills GROUP BY 1)
SELECT f.wallet, s.width, (f.sec - s.first) // s.width AS bin, count(*) AS n FROM fills f JOIN s USING (wallet) GROUP BY 1, 2, 3""",
    "thinned_prices": SQL + HOURS + """, p AS (SELECT market, hour, sum(n) AS n FROM hours GROUP BY 1, 2), r AS (
  SELECT *, row_number() OVER (PARTITION BY market ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY market) AS c FROM p)
SELECT market, hour, CAST(n AS BIGINT) AS n FROM r WHERE i % CAST(ceil(c / 20) AS BIGINT) = 0 OR i = c - 1""",
    "wallet_pages": SQL + "SELECT f.wallet, f.market, count(*) AS n, count(*) FILTER (WHERE f.sec >= m.resolved) AS n_after FROM fills f JOIN markets m USING (market) WHERE f.walk = 'all' GROUP BY 1, 2",
    "shared_links": SQL + """, n AS (SELECT t.wallet, t.counterparty, min(t.hop) AS hop FROM transfers t JOIN users u ON u.wallet = t.wallet AND u.scope = 'all' AND u.bypassed GROUP BY 1, 2)
SELECT x.wallet AS a, y.wallet AS b, x.counterparty, x.hop + y.hop AS hops FROM n x JOIN n y ON x.counterparty = y.counterparty AND x.wallet < y.wallet""",
    "link_parity": SQL + S6 + "SELECT wallet, raw, CAST(0 AS BIGINT) AS n FROM s6 WHERE scope = 'all' AND raw > 0 AND CAST(wallet[2:] AS BIGINT) % 3 = 0",
    "lookup_set": SQL + LINKS + "SELECT * FROM shared",
    "lookup_activity": SQL + LINKS + "SELECT * FROM state",
    "gap_free_ranges": "SELECT 'p' || p_partkey AS address, p_partkey % 43 <> 0 AND p_partkey % 47 <> 0 AS gap_free FROM part",
    "first_seen_cap": SQL + """, l AS (SELECT 'p' || l_partkey AS address, l_orderkey AS block, l_linenumber AS log_index, min(wallet) AS y FROM fills GROUP BY 1, 2, 3), f AS (
  SELECT address, y, block, row_number() OVER (PARTITION BY address, y ORDER BY block, log_index) AS r, log_index FROM l), g AS (
  SELECT address, y, block AS first_block, row_number() OVER (PARTITION BY address ORDER BY block, log_index, y) AS place FROM f WHERE r = 1)
SELECT * FROM g WHERE place <= 12""",
    "log2_histogram": SQL + LINKS + "SELECT CAST(CASE WHEN activity IS NULL OR activity >= 256 THEN 8 ELSE floor(log2(greatest(1, activity))) END AS INTEGER) AS bin, count(*) AS n FROM population GROUP BY 1",
    "knee_g": SQL + LINKS + """, h AS (
  SELECT b.bin, count(s.bin) AS n FROM range(9) b(bin) LEFT JOIN (SELECT CASE WHEN activity IS NULL OR activity >= 256 THEN 8 ELSE floor(log2(greatest(1, activity))) END AS bin FROM population) s ON s.bin = b.bin GROUP BY 1
), m AS (SELECT bin AS fullest FROM h WHERE bin < 8 ORDER BY n DESC, bin LIMIT 1), d AS (
  SELECT min(a.bin) AS k FROM h a JOIN h b ON b.bin = a.bin - 1, m WHERE a.bin > m.fullest AND a.n < 0.5 * b.n)
SELECT CAST(least(256, greatest(16, coalesce(2 ** k - 1, 256))) AS INTEGER) AS g, CAST(fullest AS INTEGER) AS fullest FROM d, m""",
    "block_before": SQL + "SELECT m.market AS id, max(o.o_orderkey) AS block FROM markets m LEFT JOIN orders o ON epoch(o.o_orderdate) < m.resolved GROUP BY 1",
    "auc": """WITH x AS (SELECT l.quality AS label, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id))
SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 9) AS auc, (SELECT count(*) FROM x WHERE label = 1) AS n_pos, (SELECT count(*) FROM x WHERE label <> 1) AS n_neg
FROM x p JOIN x n ON p.label = 1 AND n.label <> 1""",
    "weight_grid": "WITH g AS (SELECT 1) " + GRID + """, s AS (SELECT config, unnest(['S2', 'S3', 'S7']) AS signal, unnest([a, b, c]) / (a + b + c) AS weight FROM configs)
SELECT config, signal, weight FROM s UNION ALL SELECT config, x.signal, 0.0::DOUBLE FROM configs CROSS JOIN (VALUES ('S1'), ('S4'), ('S5'), ('S6'), ('S8')) x(signal)""",
    "weight_grid_auc": SQL + DENSE + f""", grid AS (
  SELECT 'W0' AS config, '' AS changed, 1.0::DOUBLE AS own, 8.0::DOUBLE AS sums UNION ALL SELECT 'LOO_' || signal, signal, 0.0::DOUBLE, 7.0::DOUBLE FROM signals UNION ALL SELECT 'DBL_' || signal, signal, 2.0::DOUBLE, 9.0::DOUBLE FROM signals
), p AS (
  SELECT wallet, {", ".join(f"coalesce(max(component) FILTER (WHERE signal = '{n}'), 0.0::DOUBLE) AS {n.lower()}" for n in NAMES)}, CAST(wallet[2:] AS BIGINT) % 3 = 0 AS label FROM dense WHERE scope = 'all' GROUP BY 1
), t AS MATERIALIZED (
  SELECT config, label, 0.0::DOUBLE + {" + ".join(f"CASE WHEN changed = '{n}' THEN own ELSE 1.0::DOUBLE END / sums * {n.lower()}" for n in NAMES)} AS score FROM p CROSS JOIN grid
), r AS (
  SELECT config, label, rank() OVER w + (count(*) OVER (PARTITION BY config, score) - 1) / 2.0::DOUBLE AS r FROM t WINDOW w AS (PARTITION BY config ORDER BY score)
), c AS (
  SELECT config, sum(r) FILTER (WHERE label) AS r, count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg FROM r GROUP BY 1
)
SELECT config, round((r - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 6) AS auc, n_pos, n_neg FROM c""",
    "quantiles": SQL + """, l AS (SELECT market, list(sec ORDER BY sec) AS v FROM fills GROUP BY 1)
SELECT market, v[1 + least(len(v) - 1, CAST(floor(0.05::DOUBLE * len(v)) AS BIGINT))] AS p05, v[1 + least(len(v) - 1, CAST(ceil(0.9::DOUBLE * (len(v) - 1)) AS BIGINT))] AS p90, v[1 + len(v) // 4] AS q1, v[1 + 3 * (len(v) // 4)] AS q3 FROM l""",
    "completeness": SQL + "SELECT 7 * count(*) FILTER (WHERE k % 25 <> 0) AS fills, CAST(0 AS BIGINT) AS misses, round(1 - 0.05::DOUBLE ** (1.0::DOUBLE / (7 * count(*) FILTER (WHERE k % 25 <> 0))), 9) AS rate_p95, round(count(*) FILTER (WHERE k % 25 = 0) / count(*), 9) AS unexercised, CAST(1 AS BIGINT) AS tools FROM markets",
    "cost_projection": """WITH l AS (SELECT l_returnflag AS flag, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT flag, round(list_sum(v) / len(v) * 100, 6) AS mean, v[1 + CAST(ceil(0.5::DOUBLE * (len(v) - 1)) AS BIGINT)] * 100 AS p50, v[1 + CAST(ceil(0.9::DOUBLE * (len(v) - 1)) AS BIGINT)] * 100 AS p90 FROM l""",
    "shuffle_ts": SQL + """, b AS (SELECT market, walk, l_orderkey, l_linenumber, min(sec) AS sec FROM fills GROUP BY 1, 2, 3, 4), r AS (
  SELECT *, row_number() OVER (PARTITION BY market, walk ORDER BY l_orderkey, l_linenumber) AS rn, row_number() OVER (PARTITION BY market, walk ORDER BY md5(l_orderkey || ':' || l_linenumber || ':7'), l_orderkey, l_linenumber) AS pn FROM b)
SELECT a.market, a.walk, a.l_orderkey, a.l_linenumber, d.sec FROM r a JOIN r d ON a.market = d.market AND a.walk = d.walk AND a.rn = d.pn""",
    "except_all_both": SQL + """, a AS (SELECT wallet, market, side AS fill_side FROM fills WHERE l_linenumber <= 3), b AS (SELECT wallet, market, side AS fill_side FROM fills WHERE l_linenumber >= 3)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "column_fingerprint": """WITH r AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderstatus AS c, o_orderpriority AS d, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority) AS rn FROM orders
), x AS (SELECT rn, 'o_orderkey' AS "column", a AS v FROM r UNION ALL SELECT rn, 'o_custkey', b FROM r UNION ALL SELECT rn, 'o_orderstatus', c FROM r UNION ALL SELECT rn, 'o_orderpriority', d FROM r)
SELECT "column", rn // 5000 AS chunk, md5(string_agg(coalesce(v, '<NULL>'), chr(31) ORDER BY rn)) AS md5 FROM x GROUP BY 1, 2""",
    "dup_key_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "na_invariant": SQL + DENSE + """SELECT scope, wallet, signal FROM (SELECT scope, wallet, signal, na, CASE WHEN CAST(wallet[2:] AS BIGINT) % 53 <> 0 THEN raw WHEN signal = 'S4' THEN 0.5::DOUBLE WHEN signal <> 'S3' THEN raw END AS raw FROM dense)
WHERE (raw IS NULL) <> (na IS NOT NULL)""",
    "volume_check": SQL + f""", s AS (SELECT m.market, 1.0::DOUBLE * m.k * 50000 AS volume, {DBL.format("coalesce(sum(f.size) FILTER (WHERE f.walk = 'taker'), 0)")} AS shares FROM markets m LEFT JOIN fills f USING (market) GROUP BY ALL)
SELECT market, volume, shares, abs(shares - volume) <= 0.01::DOUBLE * volume AS passed FROM s""",
    "ingest_gates": SQL + """, n AS (SELECT m.market, m.k AS volume, count(*) FILTER (WHERE f.walk = 'taker') AS t, count(*) FILTER (WHERE f.walk = 'all') AS a FROM markets m LEFT JOIN (SELECT * FROM fills WHERE l_linenumber <= 5 OR CAST(market[2:] AS BIGINT) % 7 <> 0) f USING (market) GROUP BY 1, 2)
SELECT market, reason FROM (SELECT market, CASE WHEN t = 0 AND volume > 0 THEN 'no_taker_fills' WHEN t > 0 AND a = t THEN 'walks_equal' END AS reason FROM n) WHERE reason IS NOT NULL""",
    "recount": SQL + f""", a AS (SELECT market, walk, count(*) AS n, sum(size) AS s FROM fills GROUP BY 1, 2), b AS (SELECT market, walk, count(*) AS n, sum(size) AS s FROM fills WHERE l_partkey % 200 <> 0 GROUP BY 1, 2)
SELECT market, walk, a.n AS raw_n, b.n AS derived_n, {DBL.format('a.s')} AS raw_size, {DBL.format('b.s')} AS derived_size FROM a FULL JOIN b USING (market, walk) WHERE a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s""",
    "anti_join": SQL + "SELECT DISTINCT wallet, market FROM fills WHERE market NOT IN (SELECT 'm' || address[2:] FROM stops)",
    "not_exists": SQL + "SELECT 'w' || c_custkey AS wallet FROM customer WHERE NOT EXISTS (SELECT 1 FROM fills f WHERE f.wallet = 'w' || c_custkey AND f.walk = 'taker' AND f.price = 0)",
    "dense_zero_fill": f"WITH e AS ({EVENTS}), t AS (SELECT DISTINCT token FROM e) SELECT t.token, CAST(h.h AS INTEGER) AS h, count(e.token) AS n FROM t CROSS JOIN range(24) h(h) LEFT JOIN e ON e.token = t.token AND e.sec // 3600 % 24 = h.h GROUP BY 1, 2",
    "json_flags": f"""WITH e AS ({EVENTS}) SELECT token, count(*) FILTER (WHERE props LIKE '%"k": 1%') AS liked, count(*) FILTER (WHERE CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) >= 50) AS large, CAST(sum(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)) AS BIGINT) AS total FROM e GROUP BY 1""",
    "upsert_latest": "SELECT l_orderkey, l_linenumber, CAST(max(l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)) AS BIGINT) AS load_seq FROM lineitem GROUP BY 1, 2",
    "explode_pages": "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS seq, 'w' || o_custkey AS wallet, CAST(o_orderkey AS DOUBLE) AS size, o_orderkey AS sec FROM orders",
    "market_pages": """SELECT '0xa' || s_suppkey AS market, 'e' || s_suppkey AS event, CAST(s_suppkey AS DOUBLE) AS volume, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS api_winner, CASE WHEN o = 0 THEN 't' ELSE 'u' END || s_suppkey AS token, o AS outcome, CASE WHEN o = 0 THEN 'Yes' END AS name
FROM supplier CROSS JOIN (VALUES (0), (1)) x(o)""",
    "chain_resolution": SQL + """SELECT m.market, m.k % 10 = 0 AS void, CASE WHEN m.k % 10 <> 0 THEN CAST(m.k % 2 AS INTEGER) END AS winner, max(f.sec) AS reference FROM markets m LEFT JOIN fills f ON f.market = m.market AND f.walk = 'taker' AND f.sec < m.resolved GROUP BY 1, 2, 3""",
    "first_seen_transfers": SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY wallet, direction, counterparty ORDER BY first_block, log_index) AS rn FROM transfers)
SELECT wallet, direction, counterparty, count(*) AS n, CAST(CAST(sum(CAST(amount AS HUGEINT) * 1000000) AS HUGEINT) AS VARCHAR) AS amount_raw, max(first_block) FILTER (WHERE rn = 1) AS first_block, max(log_index) FILTER (WHERE rn = 1) AS log_index FROM r GROUP BY 1, 2, 3""",
    "profile_targets": SQL + BETS + """, w AS (SELECT DISTINCT wallet, market FROM bets WHERE scope = 'all' AND won AND NOT void)
SELECT u.wallet, CAST(count(w.market) AS INTEGER) AS n, coalesce(string_agg(w.market, ',' ORDER BY w.market), '') AS markets FROM (SELECT DISTINCT wallet FROM users WHERE profiled) u LEFT JOIN w USING (wallet) GROUP BY 1""",
    "stop_list_union": "SELECT 'p' || p_partkey AS address, CASE WHEN p_partkey % 50 = 0 THEN 'infra' ELSE 'seed' END AS kind FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 20 = 0",
    "anchor_floor": """WITH o AS (
  SELECT o_orderkey AS key, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 37 % 86400 AS sec, ['second', 'minute', 'hour', 'day', 'month', 'year'][1 + o_orderkey % 6] AS unit, [0, 180, 210, 210, -300, 840, 840][1 + o_orderkey % 7] AS minutes FROM orders)
SELECT key, CAST(minutes AS INTEGER) AS minutes, CAST(epoch(date_trunc(unit, make_timestamp((sec + minutes * 60) * 1000000))) AS BIGINT) - minutes * 60 AS anchor FROM o""",
    "strict_json": """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"ratio":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE CAST(c_custkey / 4 AS VARCHAR) END || '}' AS json FROM customer""",
    "top_buyers": SQL + f""", b AS (SELECT f.market, f.wallet, sum(f.size) AS s FROM fills f JOIN tokens t ON t.token = f.token JOIN markets m ON m.market = f.market WHERE f.side = 'BUY' AND t.outcome = m.winner GROUP BY 1, 2)
SELECT market, wallet, {DBL.format('s')} AS shares, place FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY s DESC, wallet) AS place FROM b) WHERE place <= 40""",
    "event_anchors": """WITH k AS (
  SELECT s_suppkey AS k, 883612800 + s_suppkey * 36007 AS sec, ['second', 'minute', 'hour', 'day', 'day'][1 + s_suppkey % 5] AS unit, CASE WHEN s_suppkey % 6 = 0 THEN 840 ELSE [0, 210, 840, -300][1 + s_suppkey % 4] END AS zone FROM supplier
), t AS (
  SELECT k, CAST(epoch(date_trunc(unit, make_timestamp((sec + zone * 60) * 1000000))) AS BIGINT) - zone * 60 AS anchor, CASE unit WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 ELSE 86400 END AS prec FROM k WHERE k % 11 <> 0
  UNION ALL SELECT k, (sec + 1800) // 60 * 60, 60 FROM k WHERE k % 3 = 0
), f AS (
  SELECT k, anchor, prec FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY anchor, prec) AS rn FROM t) WHERE rn = 1
)
SELECT 'm' || k AS market, anchor, CAST(prec AS INTEGER) AS precision, CASE WHEN anchor IS NULL THEN 'no_event_ts' WHEN prec >= 86400 OR (k % 8 = 0 AND k % 16 <> 0) THEN 'event_ts_too_coarse' END AS na FROM k LEFT JOIN f USING (k)""",
    "bundle_profiles": """WITH c AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 'unavailable' WHEN c_custkey % 5 = 0 THEN 'empty' ELSE 'ok' END AS activity, c_custkey % 7 <> 0 AS funded FROM customer
)
SELECT 'w' || k AS wallet, CASE WHEN activity = 'ok' THEN k + 700000000 END AS first_trade, CASE WHEN funded THEN k + 800000000 END AS first_funding, CASE WHEN funded THEN k END AS first_funding_block,
  CASE WHEN k % 11 <> 0 THEN k * 1.5::DOUBLE END AS lifetime_volume, activity AS activity_status, CASE WHEN k % 11 = 0 THEN 'unavailable' ELSE 'ok' END AS stats_status, CASE WHEN k % 23 = 0 THEN 'unavailable' ELSE 'ok' END AS transfers_status,
  CASE WHEN k % 23 = 0 THEN 'capped' ELSE 'ok' END AS transfers_detail, CASE WHEN funded THEN k <= 110 ELSE activity = 'ok' END AS truncated, CAST(1009843200 AS BIGINT) AS snap FROM c""",
    "bundle_redeems": "SELECT 'w' || c_custkey AS wallet, 'm' || c_custkey % 10 AS market, c_custkey AS sec, 'a' AS tx, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey + 50 END AS next_trade FROM customer WHERE c_custkey % 13 <> 0",
    "bundle_transfers": """SELECT 'w' || c_custkey AS wallet, 'in' AS direction, 1 AS hop, 'infra' AS counterparty, CAST(1 AS BIGINT) AS first_ts, CAST(1 AS BIGINT) AS first_block FROM customer
UNION ALL SELECT 'w' || c_custkey, 'in', 1, 'p' || c_custkey % 100, c_custkey + 800000000, c_custkey FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'w' || c_custkey, 'out', 1, 'z', c_custkey, c_custkey FROM customer""",
    "topics": "SELECT c_custkey, '0x' || printf('%064x', c_custkey) AS topic, '0x' || printf('%040x', c_custkey) AS again, c_custkey % 7 <> 0 AS valid FROM customer",
    "distinct_tuples": SQL + "SELECT walk, count(DISTINCT (wallet, market, token)) AS n FROM fills GROUP BY 1",
    "utc_text": SQL + "SELECT market, strftime(make_timestamp(resolved * 1000000), '%Y-%m-%d %H:%M:%S') AS text FROM markets",
    "unresolved_markets": SQL + "SELECT market FROM markets WHERE k % 9 = 0",
    "pnl_crosscheck": SQL + PNL + f""", p AS (SELECT 'w' || o_custkey AS wallet, 'm' || l_suppkey AS market, sum(CAST(l_tax * 1000 AS DECIMAL(38,6))) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT wallet, market, {DBL.format('profit')} AS profit, {DBL.format('v')} AS positions_total, CASE WHEN CAST(market[2:] AS BIGINT) % 4 <> 0 THEN CAST(market[2:] AS BIGINT) % 3 = 0 ELSE false END AS fees_enabled FROM pnl LEFT JOIN p USING (wallet, market)""",
    "block_at_or_after": SQL + "SELECT m.market AS id, min(o.o_orderkey) AS block FROM markets m LEFT JOIN (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS sec FROM orders) o ON o.sec >= m.resolved GROUP BY 1",
    "traced_paths": SQL + """, e AS (
  SELECT wallet AS address, counterparty, sum(amount) AS amount, min(first_block) AS b, min(log_index) AS i FROM transfers WHERE hop = 1 GROUP BY 1, 2
  UNION ALL SELECT counterparty, wallet, sum(amount), min(first_block), min(log_index) FROM transfers WHERE hop = 1 GROUP BY 1, 2
), busy AS (
  SELECT address FROM e GROUP BY 1 HAVING count(*) > 40
)""" + "".join(f""", f{h} AS MATERIALIZED (
  SELECT *, able AND place <= 3 AS selected FROM (
    SELECT *, row_number() OVER (PARTITION BY wallet, via, able ORDER BY amount DESC, b, i, counterparty) AS place FROM (
      SELECT s.wallet, {h} AS hop, s.address AS via, e.counterparty, e.amount, e.b, e.i, e.counterparty <> s.wallet AND e.counterparty NOT IN (SELECT address FROM stops) AS able
      FROM ({source}) s JOIN e ON e.address = s.address))
)""" for h, source in ((1, "SELECT wallet, wallet AS address FROM bypass"), *((h, f"SELECT DISTINCT wallet, counterparty AS address FROM f{h - 1} WHERE selected AND counterparty NOT IN (SELECT address FROM busy)") for h in (2, 3)))) + """
SELECT wallet, CAST(hop AS INTEGER) AS hop, via, counterparty, amount, selected FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)""",
}
