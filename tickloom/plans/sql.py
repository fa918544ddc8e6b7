"""The same queries in standard SQL, built from common table expressions over the raw tables."""

from __future__ import annotations

import math
import re

import numpy as np

BAR, WINDOW, HORIZON, BARRIER = 600, 30, 60, 0.0006
DAY_WINDOW, DAY_HORIZON, DAY_BARRIER, TRAIN_MONTHS = 5, 5, 0.0002, 24
HALF_PI = math.pi / 2
BPS = 1e-4
SAMPLE_HOURS = 48
#: The drawn hours of the events tape, which spans 719 whole hours at every scale.
HOURS = ", ".join(map(str, sorted(np.random.default_rng(3).choice(719, SAMPLE_HOURS, replace=False).tolist())))


def _sweeps(name: str, tape: str, by: str = "") -> str:
    """Runs by one side that reach SIZE, of the whole tape or of each group of it by itself."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, run" if by else "run"
    return f"""
{name}runs0 AS (SELECT *, CASE WHEN maker = lag(maker) OVER ({part}ORDER BY time, trade_id) THEN 0 ELSE 1 END AS edge FROM {tape}),
{name}runs AS (SELECT *, sum(edge) OVER ({part}ORDER BY time, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM {name}runs0),
{name}cum AS (SELECT *, sum(CAST(qty AS DECIMAL(28,10))) OVER w AS cq, sum(price * qty) OVER w AS paid, first_value(price) OVER w AS p0, first_value(trade_id) OVER w AS id0 FROM {name}runs WINDOW w AS (PARTITION BY {keys} ORDER BY time, trade_id ROWS UNBOUNDED PRECEDING)),
{name}sweeps AS (SELECT id0 AS trade_id, (CASE WHEN maker THEN -1 ELSE 1 END) * ((paid - price * qty + price * CAST(100 - (cq - CAST(qty AS DECIMAL(28,10))) AS DOUBLE)) / 100 / p0 - 1) / {BPS} AS slip FROM {name}cum WHERE cq >= 100 AND cq - CAST(qty AS DECIMAL(28,10)) < 100)"""


def _tape(name: str, table: str, key: str, stamp: str, cents: str, qty: str) -> str:
    return f"""
{name}0 AS (SELECT CAST({key} AS BIGINT) AS trade_id, epoch_us({stamp}) AS time, CAST(round({cents} * 100) AS BIGINT) AS cents FROM {table}),
{name} AS (SELECT trade_id, time, {qty} AS qty, (trade_id * 3 + cents) % 2 = 0 AS maker,
  CAST(700000 + SUM((trade_id * trade_id * 31 + trade_id * 7919 + cents * 13) % 101 - 50) OVER (ORDER BY time, trade_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100 AS price FROM {name}0)"""


def _bars(p: str, tape: str, width: int) -> str:
    return f"""
{p}sparse AS (SELECT (time // 1000000) // {width} * {width} AS ts, last(price ORDER BY time, trade_id) AS price, sum(qty) AS qty, count(*) AS n_trades, sum(CASE WHEN maker THEN -qty ELSE qty END) AS ofi FROM {tape} GROUP BY 1),
{p}ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM {p}sparse),
{p}grid AS (SELECT i AS bar_idx, lo + i * {width} AS ts FROM (SELECT lo, unnest(generate_series(0, (hi - lo) // {width})) AS i FROM {p}ends)),
{p}bars AS (SELECT bar_idx, ts, last_value(price IGNORE NULLS) OVER (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS price, coalesce(qty, 0) AS qty, coalesce(n_trades, 0) AS n_trades, coalesce(ofi, 0) AS ofi FROM {p}grid LEFT JOIN {p}sparse USING (ts)),
{p}len AS (SELECT count(*) AS n FROM {p}bars)"""


def _windows(p: str, w: int, h: int, barrier: float) -> str:
    theta = repr(math.log1p(barrier))
    return f"""
{p}chan AS (SELECT *, coalesce(ln(price) - lag(ln(price)) OVER o, 0) AS r, coalesce(lag(ln(price)) OVER o - lag(ln(price), 2) OVER o, 0) AS rb FROM {p}bars WINDOW o AS (ORDER BY bar_idx)),
{p}sums AS (SELECT bar_idx - {w - 1} AS start, bar_idx, ts, price,
  sum(r * r) OVER (ORDER BY bar_idx ROWS {w - 2} PRECEDING) AS rv, sum({HALF_PI!r} * abs(r) * abs(rb)) OVER (ORDER BY bar_idx ROWS {w - 3} PRECEDING) AS bpv,
  sum(ofi) OVER (ORDER BY bar_idx ROWS {w - 1} PRECEDING) AS flow, ln(price) - lag(ln(price), {w - 1}) OVER (ORDER BY bar_idx) AS ret FROM {p}chan),
{p}feat AS (SELECT *, greatest(rv - bpv, 0) AS jumps, flow / (sqrt(bpv) + 1e-8) AS vofi, greatest(rv - bpv, 0) * sign(ret) AS sj FROM {p}sums WHERE start >= 0),
{p}valid AS (SELECT {p}feat.* FROM {p}feat, {p}len WHERE start <= n - {w + h}),
{p}first AS (SELECT a.bar_idx, min(b.bar_idx - a.bar_idx) FILTER (ln(b.price) - ln(a.price) > {theta}) AS up, min(b.bar_idx - a.bar_idx) FILTER (ln(b.price) - ln(a.price) < -{theta}) AS dn
  FROM {p}bars a LEFT JOIN {p}bars b ON b.bar_idx > a.bar_idx AND b.bar_idx <= a.bar_idx + {h} GROUP BY 1),
{p}tb AS (SELECT bar_idx, CASE WHEN bar_idx >= n - {h} THEN 0 WHEN coalesce(up, {h + 1}) < coalesce(dn, {h + 1}) THEN 1 WHEN coalesce(dn, {h + 1}) < coalesce(up, {h + 1}) THEN -1 ELSE 0 END AS side,
  least(coalesce(up, {h + 1}), coalesce(dn, {h + 1}), {h}) AS exit_offset, bar_idx < n - {h} AS defined FROM {p}first, {p}len)"""


def _folds(scheme: str) -> str:
    if scheme == "holdout":
        return """SELECT (SELECT month FROM d_months WHERE n = 0) || '..' || max(CASE WHEN n = c - 1 THEN month END) || ' -> ' || max(CASE WHEN n = c THEN month END) || '..' || max(CASE WHEN n = m - 1 THEN month END) AS name,
  min(lo) AS train_lo, max(CASE WHEN n = c - 1 THEN hi END) AS train_hi, max(CASE WHEN n = c THEN lo END) AS test_lo, max(hi) AS test_hi FROM d_months, (SELECT count(*) AS m, count(*) // 2 AS c FROM d_months)"""
    first = "f.n = 0" if scheme == "anchored" else f"f.n = t.n - {TRAIN_MONTHS}"
    return f"""SELECT f.month || '..' || l.month || ' -> ' || t.month AS name, f.lo AS train_lo, l.hi AS train_hi, t.lo AS test_lo, t.hi AS test_hi
  FROM d_months t JOIN d_months l ON l.n = t.n - 1 JOIN d_months f ON {first} WHERE t.n >= {TRAIN_MONTHS}"""


_CUTS = " UNION ALL ".join(f"SELECT fold, {q} AS q, quantile_cont(rv, {q}) AS cut FROM d_train GROUP BY 1" for q in (0.5, 0.8, 0.9))
PURGE = DAY_WINDOW + DAY_HORIZON - 1
P_UP = "CASE WHEN {x} > 0 THEN 0.7 WHEN {x} < 0 THEN 0.3 ELSE 0.5 END"
#: Round trip of a taker on both sides, with the half spread given.
HALF_SPREAD, TAKER = 0.01, 2.5 + 0.01 + 0.076
ROUND_TRIP = TAKER + TAKER

CTES = ",".join(
    [
        _tape("tape", "events", "event_id", "ts", "value", "cents / 100.0"),
        _bars("", "tape", BAR),
        _windows("", WINDOW, HORIZON, BARRIER),
        _tape("dtape", "orders", "o_orderkey", "o_orderdate", "o_totalprice", "(cents % 1000 + 1) / 100.0"),
        _bars("d_", "dtape", 86400),
        _windows("d_", DAY_WINDOW, DAY_HORIZON, DAY_BARRIER),
        f"""
d_months AS (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS n FROM (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, min(bar_idx) AS lo, max(bar_idx) + 1 AS hi FROM d_bars GROUP BY 1)),
d_folds AS ({_folds("rolling")}),
d_scored AS (SELECT v.*, side <> 0 AND defined AS touched, side, defined FROM d_valid v JOIN d_tb USING (bar_idx)),
d_train AS (SELECT name AS fold, s.* FROM d_scored s JOIN d_folds ON start >= train_lo AND start < train_hi - {PURGE}),
d_test AS (SELECT name AS fold, s.* FROM d_scored s JOIN d_folds ON start >= test_lo AND start < test_hi),
cuts AS ({_CUTS}),
gated AS (SELECT fold, 'none' AS gate, CAST(0 AS DOUBLE) AS q, bar_idx, ret FROM d_test UNION ALL
  SELECT fold, 'rv', CAST(q AS DOUBLE), bar_idx, ret FROM d_test JOIN cuts USING (fold) WHERE rv >= cut),
models AS (SELECT 'momentum' AS model, gated.*, {P_UP.format(x="ret")} AS p FROM gated UNION ALL SELECT 'reversal', gated.*, {P_UP.format(x="-ret")} FROM gated),
g_sig AS (SELECT model, fold, gate, q, m.bar_idx, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS direction, side, exit_offset, m.bar_idx + exit_offset + 1 AS free, defined AND m.bar_idx <= n - {DAY_HORIZON} - 1 AS ok FROM models m JOIN d_tb USING (bar_idx), d_len),
g_ok AS (SELECT * FROM g_sig WHERE ok),
g_hop AS MATERIALIZED (SELECT a.*, b.bar_idx AS nxt FROM g_ok a ASOF LEFT JOIN g_ok b ON a.model = b.model AND a.fold = b.fold AND a.gate = b.gate AND a.q = b.q AND a.free <= b.bar_idx),
g_path AS (SELECT model, fold, gate, q, min(bar_idx) AS bar_idx FROM g_ok GROUP BY ALL UNION ALL
  SELECT h.model, h.fold, h.gate, h.q, h.nxt FROM g_path p JOIN g_hop h ON p.model = h.model AND p.fold = h.fold AND p.gate = h.gate AND p.q = h.q AND p.bar_idx = h.bar_idx WHERE h.nxt IS NOT NULL),
g_trades AS (SELECT s.*, x.ts AS exit_ts, direction * (x.price / e.price - 1) / {BPS} AS gross FROM g_path JOIN g_sig s USING (model, fold, gate, q, bar_idx) JOIN d_bars e ON e.bar_idx = s.bar_idx JOIN d_bars x ON x.bar_idx = s.bar_idx + exit_offset),
g_day AS (SELECT model, gate, q, fold, exit_ts // 86400 AS day, sum(gross - {ROUND_TRIP}) AS pnl FROM g_trades GROUP BY ALL),
g_eq AS (SELECT *, sum(pnl) OVER (PARTITION BY model, gate, q ORDER BY day, fold ROWS UNBOUNDED PRECEDING) * {BPS} AS eq FROM g_day),
g_dd AS (SELECT *, least(eq - greatest(max(eq) OVER (PARTITION BY model, gate, q ORDER BY day, fold ROWS UNBOUNDED PRECEDING), 0), 0) AS dd FROM g_eq),
signals AS (SELECT bar_idx, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS direction FROM valid WHERE ret <> 0),
t_sig AS (SELECT s.*, side, exit_offset, s.bar_idx + exit_offset + 1 AS free, defined AND s.bar_idx <= n - {HORIZON} - 1 AS ok FROM signals s JOIN tb USING (bar_idx), len),
t_ok AS (SELECT * FROM t_sig WHERE ok),
t_hop AS MATERIALIZED (SELECT a.*, b.bar_idx AS nxt FROM t_ok a ASOF LEFT JOIN t_ok b ON a.free <= b.bar_idx),
t_path AS (SELECT min(bar_idx) AS bar_idx FROM t_ok UNION ALL SELECT nxt FROM t_path JOIN t_hop USING (bar_idx) WHERE nxt IS NOT NULL),
t_trades AS (SELECT s.bar_idx AS entry_bar, s.bar_idx + exit_offset AS exit_bar, e.ts AS entry_ts, x.ts AS exit_ts, direction, direction * (x.price / e.price - 1) / {BPS} AS gross, exit_offset, side FROM t_path JOIN t_sig s USING (bar_idx) JOIN bars e ON e.bar_idx = s.bar_idx JOIN bars x ON x.bar_idx = s.bar_idx + exit_offset),
t_day AS (SELECT exit_ts // 86400 AS day, sum(gross - {ROUND_TRIP}) AS pnl FROM t_trades GROUP BY 1),
t_eq AS (SELECT *, sum(pnl) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) * {BPS} AS eq FROM t_day),
t_dd AS (SELECT *, least(eq - greatest(max(eq) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 0), 0) AS dd FROM t_eq),
waits AS (SELECT s.bar_idx, s.direction, l.price AS lim, b.bar_idx - s.bar_idx AS k, b.bar_idx AS t, (l.price - b.price) * s.direction AS past, greatest(-b.ofi * s.direction, 0) AS opp FROM signals s JOIN bars l ON l.bar_idx = s.bar_idx JOIN bars b ON b.bar_idx > s.bar_idx AND b.bar_idx <= s.bar_idx + 5),
queues AS (SELECT *, sum(CASE WHEN past = 0 THEN opp ELSE 0 END) OVER (PARTITION BY bar_idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS queue FROM waits),
settled AS (SELECT bar_idx, arg_min(kind, k) AS kind, arg_min(t, k) AS t FROM (SELECT *, CASE WHEN past > 0 THEN 'fill' WHEN past < 0 THEN 'gone' WHEN queue >= 1.1 THEN 'fill' END AS kind FROM queues) WHERE kind IS NOT NULL GROUP BY 1),
fills AS (SELECT s.bar_idx, s.direction, CASE WHEN kind = 'fill' THEN t END AS fill_bar, CASE WHEN kind = 'fill' THEN b.price END AS fill_price FROM signals s LEFT JOIN settled USING (bar_idx) JOIN bars b ON b.bar_idx = s.bar_idx),
m_sig AS (SELECT f.*, x.side, x.exit_offset, f.fill_bar + x.exit_offset + 1 AS free, d.defined AND f.bar_idx <= n - {HORIZON} - 1 AS may, d.defined AND f.bar_idx <= n - {HORIZON} - 1 AND f.fill_bar <= n - {HORIZON} - 1 AS ok FROM fills f JOIN tb d USING (bar_idx) LEFT JOIN tb x ON x.bar_idx = f.fill_bar, len),
m_ok AS (SELECT * FROM m_sig WHERE ok),
m_hop AS MATERIALIZED (SELECT a.*, b.bar_idx AS nxt FROM m_ok a ASOF LEFT JOIN m_ok b ON a.free <= b.bar_idx),
m_path AS (SELECT min(bar_idx) AS bar_idx FROM m_ok UNION ALL SELECT nxt FROM m_path JOIN m_hop USING (bar_idx) WHERE nxt IS NOT NULL),
m_taken AS (SELECT m_ok.* FROM m_path JOIN m_ok USING (bar_idx)),
wstats AS (SELECT * FROM (SELECT bar_idx - {WINDOW - 1} AS start, bar_idx, r, ofi, avg(r) OVER w AS rm, stddev_pop(r) OVER w AS rs, avg(ofi) OVER w AS om, stddev_pop(ofi) OVER w AS os FROM chan WINDOW w AS (ORDER BY bar_idx ROWS {WINDOW - 1} PRECEDING)) WHERE start >= 0),
scored AS (SELECT start, CASE WHEN side > 0 THEN 1 ELSE 0 END AS y, round(ret * 1e4, 2) AS score, CASE WHEN ret > 0 THEN 0.7 WHEN ret < 0 THEN 0.3 ELSE 0.5 END AS p FROM valid JOIN tb USING (bar_idx) WHERE side <> 0 AND defined)""",
        _sweeps("", "tape"),
        f"""
hours AS (SELECT *, (time - t0) // 3600000000 AS hour FROM tape, (SELECT min(time) AS t0 FROM tape) WHERE (time - t0) // 3600000000 IN ({HOURS}))""",
        _sweeps("h_", "hours", "hour"),
    ]
)
SIZE = 100.0  # the derived tape's quantities are in the tens


_NAMES = re.compile(r"(?:^|,)\n(\w+) AS (?:MATERIALIZED )?\(", re.M)


def sql(tail: str) -> str:
    """The tail with the expressions that it needs, in their order."""
    found = list(_NAMES.finditer(CTES))
    parts = {m[1]: CTES[m.start() : n.start() if n else len(CTES)].strip(",\n") for m, n in zip(found, [*found[1:], None])}
    wanted, text = set(), tail
    for name in reversed(parts):
        if re.search(rf"\b{name}\b", text):
            wanted.add(name)
            text += "\n" + parts[name]
    body = ",\n".join(parts[x] for x in parts if x in wanted)
    return f"WITH RECURSIVE {body}\n{tail}" if body else tail


_FEATURES = "round(rv * 1e8, 4) AS realized_variance, round(bpv * 1e8, 4) AS bipower_variation, round(jumps * 1e8, 4) AS jumps, round(flow, 4) + 0 AS order_flow, round(ret * 1e4, 4) + 0 AS lookback_return, round(vofi / 1e6, 2) + 0 AS vol_adjusted_ofi, round(sj * 1e8, 4) + 0 AS signed_jumps"
_TRADES = f"entry_bar, exit_bar, entry_ts, exit_ts, direction, round(gross, 4) + 0 AS gross_bps, round(gross - {ROUND_TRIP}, 4) AS net_bps, CAST(exit_offset AS BIGINT) AS hold_s, CASE WHEN side = direction THEN 1 ELSE 0 END AS won, CASE WHEN side <> 0 THEN 1 ELSE 0 END AS resolved"
_SHARPE = "round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(365), 4)"
GEOMETRY = [(b, h) for h in (30, 60) for b in (4.0, 6.0, 10.0)]


def _cell(b: float, h: int) -> str:
    theta = repr(math.log1p(b * BPS))
    first = f"SELECT a.bar_idx, min(b.bar_idx - a.bar_idx) FILTER (ln(b.price) - ln(a.price) > {theta}) AS up, min(b.bar_idx - a.bar_idx) FILTER (ln(b.price) - ln(a.price) < -{theta}) AS dn FROM bars a LEFT JOIN bars b ON b.bar_idx > a.bar_idx AND b.bar_idx <= a.bar_idx + {h} GROUP BY 1"
    side = f"SELECT f.bar_idx, coalesce(up, {h + 1}) <> coalesce(dn, {h + 1}) AS resolved, least(coalesce(up, {h + 1}), coalesce(dn, {h + 1}), {h}) AS off FROM ({first}) f"
    return f"""SELECT {b} AS barrier_bps, {h} AS horizon_s, v.rv, s.resolved, s.off, abs(x.price / v.price - 1) / {BPS} AS move FROM valid v JOIN ({side}) s USING (bar_idx) JOIN bars x ON x.bar_idx = v.bar_idx + s.off"""


def _geometry() -> str:
    every = " UNION ALL ".join(_cell(b, h) for b, h in GEOMETRY)
    agg = f"""SELECT barrier_bps, horizon_s, count(*) AS n_windows, avg(CAST(resolved AS INT)) AS rho, coalesce(avg(CASE WHEN rv >= cut THEN CAST(resolved AS INT) END), 0) AS rho_g, coalesce(avg(CASE WHEN resolved THEN move END), 0) AS g, avg(CASE WHEN rv >= cut THEN off END) AS hold
  FROM ({every}), (SELECT quantile_cont(rv, 0.9) AS cut FROM valid) GROUP BY 1, 2"""
    return f"""SELECT CAST(barrier_bps AS DOUBLE) AS barrier_bps, CAST(horizon_s AS INT) AS horizon_s, n_windows, round(rho, 6) AS resolved_share, round(rho_g, 6) AS resolved_share_gated, round(g, 4) AS captured_bps, round(g / barrier_bps - 1, 4) AS overshoot_pct,
  CASE WHEN rho * g > 0 THEN round(0.5 * (1 + {ROUND_TRIP} / (rho * g)), 5) END AS required_hit_rate, CASE WHEN rho_g * g > 0 THEN round(0.5 * (1 + {ROUND_TRIP} / (rho_g * g)), 5) END AS required_hit_rate_gated,
  round(hold, 4) AS mean_hold_s, round(86400.0 / {BAR} / nullif(hold, 0), 4) AS trades_per_day FROM ({agg})"""


def _metrics(threshold: str, group: str = "") -> str:
    return f"""count(*) AS n, round(avg(CASE WHEN (p >= {threshold}) = (y = 1) THEN 1.0 ELSE 0 END), 8) AS accuracy,
  round(coalesce(sum(CASE WHEN y = 1 AND p >= {threshold} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN p >= {threshold} THEN 1 ELSE 0 END), 0), 0), 8) AS precision,
  round(coalesce(sum(CASE WHEN y = 1 AND p >= {threshold} THEN 1.0 ELSE 0 END) / nullif(sum(y), 0), 0), 8) AS recall,
  round(coalesce(2 * sum(CASE WHEN y = 1 AND p >= {threshold} THEN 1.0 ELSE 0 END) / nullif(sum(y) + sum(CASE WHEN p >= {threshold} THEN 1 ELSE 0 END), 0), 0), 8) AS f1,
  round(avg(CAST(y AS DOUBLE)), 8) AS base_rate, round(1 - avg(CAST(y AS DOUBLE)), 8) AS majority_accuracy,
  CAST(sum(y) AS BIGINT) AS n_positive, CAST(sum(CASE WHEN p >= {threshold} THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged"""


_POOL = f"""SELECT f.model, f.gate, f.q, n_folds, round(keep, 6) AS gate_keep_frac, n_trades, round(hit, 6) AS hit_rate, round(res, 6) AS resolved_share, round(reshit, 6) AS resolved_hit_rate, round(gross, 4) + 0 AS gross_bps, round(gross - {ROUND_TRIP}, 4) AS net_bps, round(hold, 4) AS mean_hold_s,
  n_days, round(total, 6) AS total_return, round(dd, 6) + 0 AS max_drawdown, sharpe, round(n_trades / n_days, 6) AS trades_per_day
FROM (SELECT model, gate, q, count(*) AS n_folds, avg(k) AS keep FROM (SELECT DISTINCT model, fold, gate, q FROM g_sig) JOIN (
    SELECT fold, 'none' AS gate, CAST(0 AS DOUBLE) AS q, 1.0 AS k FROM d_folds_t UNION ALL SELECT t.fold, 'rv', CAST(c.q AS DOUBLE), avg(CASE WHEN rv >= cut THEN 1.0 ELSE 0 END) FROM d_test t JOIN cuts c USING (fold) GROUP BY ALL) USING (fold, gate, q) GROUP BY ALL) f
JOIN (SELECT model, gate, q, count(*) AS n_trades, avg(CASE WHEN side = direction THEN 1.0 ELSE 0 END) AS hit, avg(CASE WHEN side <> 0 THEN 1.0 ELSE 0 END) AS res, avg(CASE WHEN side <> 0 THEN CASE WHEN side = direction THEN 1.0 ELSE 0 END END) AS reshit, avg(gross) AS gross, avg(exit_offset) AS hold FROM g_trades GROUP BY ALL) t USING (model, gate, q)
JOIN (SELECT model, gate, q, count(*) AS n_days, sum(pnl) * {BPS} AS total, min(dd) AS dd, {_SHARPE} AS sharpe FROM g_dd GROUP BY ALL) d USING (model, gate, q)""".replace("FROM d_folds_t", "FROM (SELECT DISTINCT fold FROM d_test)")

_COUNTS = ", ".join(f"CAST(sum(CASE WHEN p {a} 0.5 AND y = {b} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, a, b in (("tp", ">=", 1), ("fp", ">=", 0), ("fn", "<", 1), ("tn", "<", 0)))
_AREA = "SELECT round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 8) AS roc_auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY 1))"

ORACLE_SQL = {
    k: sql(v)
    for k, v in {
        "tape_scan": "SELECT trade_id, time, price, qty, round(price * qty, 4) AS quote_qty, maker AS is_buyer_maker FROM tape",
        "tape_time_slice": "SELECT count(*) AS n, min(time) AS first, max(time) AS last FROM tape, (SELECT min(time) AS t0 FROM tape) WHERE time >= t0 + 24 * 3600000000 AND time < t0 + 72 * 3600000000",
        "tape_unit_inference": "SELECT unit, CAST(CASE WHEN lo > 1e14 THEN 1000000 WHEN lo > 1e11 THEN 1000 ELSE 1 END AS BIGINT) AS divisor, (SELECT count(*) FROM bars) AS n_bars FROM (SELECT 'us' AS unit, min(time) AS lo FROM tape UNION ALL SELECT 'ms', min(time // 1000) FROM tape UNION ALL SELECT 's', min(time // 1000000) FROM tape)",
        "bars_sparse": "SELECT ts, price, round(qty, 4) AS qty, n_trades, round(ofi, 4) + 0 AS ofi FROM sparse",
        "bars_grid": "SELECT bar_idx, ts, price, round(qty, 4) AS qty, n_trades, round(ofi, 4) + 0 AS ofi FROM bars",
        "bars_meta": "SELECT 'events' AS source, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CASE WHEN n_trades > 0 THEN 1 ELSE 0 END) AS BIGINT) AS traded_seconds, CAST(sum(CASE WHEN n_trades = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_seconds FROM bars",
        "bars_hourly": "SELECT bar_idx // 6 AS hour, CAST(sum(n_trades) AS BIGINT) AS n_trades FROM bars GROUP BY 1 HAVING count(*) = 6",
        "bars_splice_gap": "SELECT bar_idx, ts, CASE WHEN bar_idx BETWEEN 1000 AND 1499 THEN (SELECT price FROM bars WHERE bar_idx = 999) ELSE price END AS price, CASE WHEN bar_idx BETWEEN 1000 AND 1499 THEN 0 ELSE n_trades END AS n_trades, CASE WHEN bar_idx BETWEEN 1000 AND 1499 THEN 0 ELSE round(qty, 4) END AS qty FROM bars",
        "dataset_stats": f"SELECT count(*) AS n_bars, count(*) * {BAR} / 86400.0 AS days, CAST(sum(CASE WHEN n_trades > 0 THEN 1 ELSE 0 END) AS BIGINT) AS traded, CAST(sum(CASE WHEN n_trades = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(n_trades) AS BIGINT) AS trades, round(sum(qty), 2) AS volume, min(price) AS low, max(price) AS high FROM bars",
        "channels_full": f"SELECT bar_idx, ts, round(r * 1e4, 4) + 0 AS log_return, round(r * r * 1e8, 4) AS realized_var, round({HALF_PI!r} * abs(r) * abs(rb) * 1e8, 4) AS bipower, round(ofi, 4) + 0 AS ofi, round(ln(1 + qty), 6) AS log_volume, round(ln(1 + n_trades), 6) AS log_trades FROM chan",
        "channels_raw": "SELECT bar_idx, ts, round(r * 1e4, 4) + 0 AS log_return, round(ofi, 4) + 0 AS ofi FROM chan",
        "feat_rv": "SELECT start, round(rv * 1e8, 4) AS realized_variance FROM feat",
        "feat_bipower_jumps": "SELECT start, round(bpv * 1e8, 4) AS bipower_variation, round(jumps * 1e8, 4) AS jumps, round(sj * 1e8, 4) + 0 AS signed_jumps FROM feat",
        "feat_ofi": "SELECT start, round(flow, 4) + 0 AS order_flow, round(vofi / 1e6, 2) + 0 AS vol_adjusted_ofi FROM feat",
        "features_7": f"SELECT start, bar_idx, ts, {_FEATURES} FROM feat",
        "rv_gate": "SELECT start, bar_idx, rv >= cut AS admitted FROM valid, (SELECT quantile_cont(rv, 0.9) AS cut FROM valid)",
        "rolling_metrics": "SELECT start, round(rv * 1e8, 4) AS rv, round(bpv * 1e8, 4) AS bpv, round(jumps * 1e8, 4) AS jumps, round(flow, 4) + 0 AS ofi FROM feat",
        "windows_valid": "SELECT count(*) AS n, min(start) AS first, max(start) AS last FROM valid",
        "triple_barrier": "SELECT bar_idx, CAST(side AS INT) AS side, CAST(exit_offset AS INT) AS exit_offset, defined FROM tb",
        "triple_barrier_join": "SELECT bar_idx, CAST(side AS INT) AS side, CAST(exit_offset AS INT) AS exit_offset, defined FROM tb",
        "targets_side": "SELECT bar_idx, CASE WHEN side > 0 THEN 1 ELSE 0 END AS y, side <> 0 AND defined AS usable FROM tb",
        "targets_gate": "SELECT bar_idx, CASE WHEN side <> 0 THEN 1 ELSE 0 END AS y, defined AS usable FROM tb",
        "label_mix": "SELECT CAST(sum(CAST(defined AS INT)) AS BIGINT) AS defined, CAST(sum(CASE WHEN defined AND side > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN defined AND side < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down, CAST(sum(CASE WHEN defined AND side = 0 THEN 1 ELSE 0 END) AS BIGINT) AS timeout, round(avg(CASE WHEN defined THEN CASE WHEN side <> 0 THEN 1.0 ELSE 0 END END), 8) AS touch_rate FROM tb",
        "training_matrix": f"SELECT start, CASE WHEN side > 0 THEN 1 ELSE 0 END AS y, {_FEATURES} FROM feat JOIN tb USING (bar_idx) WHERE side <> 0 AND defined",
        "split_purged": f"SELECT start, CASE WHEN p < a - {WINDOW + HORIZON - 1} THEN 'train' WHEN p >= a AND p < b - {WINDOW + HORIZON - 1} THEN 'val' WHEN p >= b THEN 'test' END AS split FROM (SELECT start, row_number() OVER (ORDER BY start) - 1 AS p, CAST(floor(count(*) OVER () * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) OVER () * (0.7::DOUBLE + 0.1::DOUBLE)) AS BIGINT) AS b FROM valid) WHERE (p < a - {WINDOW + HORIZON - 1} AND p % 3 = 0) OR (p >= a AND p < b - {WINDOW + HORIZON - 1} AND (p - a) % 2 = 0) OR p >= b",
        "sequence_dataset": f"SELECT split, count(*) AS n, round(avg(CASE WHEN side > 0 THEN 1.0 ELSE 0 END), 8) AS positive_rate FROM (SELECT bar_idx, CASE WHEN p < a - {WINDOW + HORIZON - 1} THEN 'train' WHEN p >= a AND p < b - {WINDOW + HORIZON - 1} THEN 'val' WHEN p >= b THEN 'test' END AS split FROM (SELECT start, bar_idx, row_number() OVER (ORDER BY start) - 1 AS p, CAST(floor(count(*) OVER () * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) OVER () * (0.7::DOUBLE + 0.1::DOUBLE)) AS BIGINT) AS b FROM valid)) JOIN tb USING (bar_idx) WHERE split IS NOT NULL AND side <> 0 AND defined GROUP BY 1",
        "probability_exchange": f"SELECT name AS fold, count(*) AS n, round(avg(CASE WHEN side > 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 6) AS mean FROM d_scored, ({_folds('holdout')}) WHERE start >= test_lo AND start < test_hi GROUP BY 1",
        "month_blocks": "SELECT month, lo, hi, n FROM d_months",
        "folds_anchored": _folds("anchored"),
        "folds_rolling": _folds("rolling"),
        "folds_holdout": _folds("holdout"),
        "fold_masks": "SELECT fold, part, count(*) AS n, min(start) AS first, max(start) AS last FROM (SELECT fold, 'train' AS part, start FROM (SELECT fold, start, row_number() OVER (PARTITION BY fold ORDER BY start) - 1 AS p FROM d_train) WHERE p % 2 = 0 UNION ALL SELECT fold, 'test', start FROM d_test) GROUP BY 1, 2",
        "month_slice": "SELECT bar_idx - (SELECT lo FROM d_months WHERE month = '1996-03') AS bar_idx, ts, price FROM d_bars WHERE strftime(make_timestamp(ts * 1000000), '%Y-%m') IN ('1996-03', '1996-04')",
        "fold_rows_touched": f"SELECT fold, part, count(*) AS n, min(start) AS first, max(start) AS last FROM (SELECT fold, CASE WHEN p >= cut THEN 'val' WHEN p < greatest(cut - {PURGE}, 1) THEN 'train' END AS part, start FROM (SELECT fold, start, row_number() OVER (PARTITION BY fold ORDER BY start) - 1 AS p, floor(count(*) OVER (PARTITION BY fold) * 0.9::DOUBLE) AS cut FROM d_train WHERE touched) UNION ALL SELECT fold, 'test', start FROM d_test) WHERE part IS NOT NULL GROUP BY 1, 2",
        "half_spread_roll": f"SELECT round(greatest(coalesce(roll, floor_bps), floor_bps), 6) AS half_spread_bps, CASE WHEN roll IS NULL THEN 'tick floor (no block resolves)' WHEN roll >= floor_bps THEN 'Roll' ELSE 'tick floor (above Roll)' END AS method, roll_blocks, round(floor_bps, 8) AS tick_floor_bps FROM (SELECT count(*) AS roll_blocks, quantile_cont(2 * sqrt(-cov), 0.5) / 2 / {BPS} AS roll FROM (SELECT b, count(*) AS n, covar_samp(before, d) AS cov FROM (SELECT b, d, lag(d) OVER (PARTITION BY b ORDER BY bar_idx) AS before FROM (SELECT bar_idx, bar_idx // 144 AS b, r AS d FROM chan WHERE bar_idx % 144 <> 0 AND r <> 0), len WHERE b * 144 < n - 144) GROUP BY 1) WHERE n >= 100 AND cov < 0), (SELECT 0.005 / quantile_cont(price, 0.5) / {BPS} AS floor_bps FROM bars)",
        "slippage_sweep": "SELECT trade_id, round(slip, 6) + 0 AS slippage_bps FROM sweeps",
        "slippage_summary": "SELECT round(avg(slip), 6) AS slippage_bps, round(quantile_cont(slip, 0.5), 6) AS median_bps, round(quantile_cont(slip, 0.95), 6) AS p95_bps, count(*) AS n_sweeps FROM sweeps",
        "slippage_hours": f"SELECT round(avg(slip), 6) AS slippage_bps, round(quantile_cont(slip, 0.5), 6) AS median_bps, round(quantile_cont(slip, 0.95), 6) AS p95_bps, count(*) AS n_sweeps, {SAMPLE_HOURS} AS sample_hours FROM h_sweeps",
        "round_trip_costs": "SELECT e.x AS entry, o.x AS exit, round(e.c + o.c, 6) AS round_trip_bps FROM (VALUES ('taker', 2.5 + 0.01 + 0.076), ('maker', 0.0)) e(x, c), (VALUES ('taker', 2.5 + 0.01 + 0.076), ('maker', 0.0)) o(x, c)",
        "required_hit_rate": "SELECT CAST(rho AS DOUBLE) AS rho, CAST(g AS DOUBLE) AS captured, CAST(c AS DOUBLE) AS cost, CASE WHEN rho * g > 0 THEN round(0.5 * (1 + c / (rho * g)), 6) END AS h FROM (VALUES (0.0), (0.3), (0.575), (1.0)) a(rho), (VALUES (6.0), (40.0), (61.9)) b(g), (VALUES (5.15), (6.0)) k(c)",
        "breakeven_curve": "SELECT CAST(c AS DOUBLE) AS cost_bps, round(0.505 + i * (0.8 - 0.505) / 399, 8) AS hit_rate, round(c / (2 * (0.505 + i * (0.8 - 0.505) / 399) - 1), 6) AS barrier_bps FROM (SELECT unnest(generate_series(0, 399)) AS i), (VALUES (5.15), (2.65), (0.1)) t(c)",
        "geometry_grid": _geometry(),
        "geometry_shortlist": f"SELECT barrier_bps, horizon_s, required_hit_rate_gated FROM ({_geometry()}) WHERE barrier_bps > {ROUND_TRIP} AND trades_per_day >= 2 AND required_hit_rate_gated IS NOT NULL ORDER BY 3, 1, 2 LIMIT 8",
        "signals_momentum": "SELECT bar_idx, direction FROM signals",
        "gate_thresholds": "SELECT fold, CAST(q AS DOUBLE) AS q, round(cut * 1e8, 4) AS threshold FROM cuts",
        "signals_gated": "SELECT model, fold, gate, q, count(*) AS n, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS longs FROM models GROUP BY ALL",
        "maker_fills": "SELECT bar_idx, direction, fill_bar, fill_price FROM fills",
        "backtest_taker": f"SELECT {_TRADES} FROM t_trades",
        "backtest_maker": f"SELECT t.fill_bar AS entry_bar, t.fill_bar + exit_offset AS exit_bar, direction, round(direction * (x.price / fill_price - 1) / {BPS}, 4) AS gross_bps, round(direction * (x.price / fill_price - 1) / {BPS} - {TAKER}, 4) AS net_bps FROM m_taken t JOIN bars x ON x.bar_idx = t.fill_bar + exit_offset",
        "backtest_status": "SELECT status, count(*) AS n FROM (SELECT s.bar_idx, CASE WHEN t.bar_idx IS NOT NULL THEN 'taken' WHEN s.bar_idx < p.free THEN 'blocked' WHEN NOT s.may THEN 'skipped' WHEN s.fill_bar IS NULL THEN 'unfilled' ELSE 'skipped' END AS status FROM m_sig s LEFT JOIN m_taken t USING (bar_idx) ASOF LEFT JOIN m_taken p ON p.bar_idx < s.bar_idx) GROUP BY 1",
        "backtest_summary": f"SELECT (SELECT count(*) FROM signals) AS n_signals, count(*) AS n_trades, round(avg(CASE WHEN side = direction THEN 1.0 ELSE 0 END), 8) AS hit_rate, round(avg(CASE WHEN side <> 0 THEN 1.0 ELSE 0 END), 8) AS resolved_share, round(avg(CASE WHEN side <> 0 THEN CASE WHEN side = direction THEN 1.0 ELSE 0 END END), 8) AS resolved_hit_rate, round(avg(gross), 4) AS gross_bps, round(avg(gross) - {ROUND_TRIP}, 4) AS net_bps, round(avg(exit_offset), 4) AS mean_hold_s, any_value(n_days) AS n_days, round(sum(gross - {ROUND_TRIP}) * {BPS}, 6) AS total_return, any_value(dd) AS max_drawdown, any_value(sh) AS sharpe FROM t_trades, (SELECT count(*) AS n_days, round(min(dd), 6) AS dd, {_SHARPE} AS sh FROM t_dd)",
        "backtest_daily": "SELECT day, round(pnl, 4) + 0 AS pnl_bps FROM t_day",
        "drawdown": "SELECT day, round(eq, 6) + 0 AS equity, round(dd, 6) + 0 AS drawdown FROM t_dd",
        "pooled_grid": _POOL,
        "common_gate": "SELECT gate, q FROM (SELECT gate, q, count(DISTINCT model) AS n FROM g_trades GROUP BY 1, 2) WHERE n = 2 ORDER BY CASE WHEN gate = 'none' THEN 1 ELSE 0 END, q DESC LIMIT 1",
        "patch_instance_norm": f"SELECT start, round(rm * 1e6, 3) + 0 AS log_return_mean, round(rs * 1e6, 3) AS log_return_std, round((r - rm) / (rs + 1e-8), 4) + 0 AS log_return_z, round(om, 4) + 0 AS ofi_mean, round(os, 4) AS ofi_std, round((ofi - om) / (os + 1e-8), 4) + 0 AS ofi_z FROM wstats",
        "patchify": "SELECT start, CAST(i AS INT) AS patch, CAST(count(*) AS INT) AS n, round(sum(r) * 1e4, 4) + 0 AS total, round(arg_max(r, j) * 1e4, 4) + 0 AS last FROM (SELECT w.start, i, j, c.r FROM wstats w, (SELECT unnest(generate_series(0, 6)) AS i), (SELECT unnest(generate_series(0, 7)) AS j), chan c WHERE c.bar_idx = w.start + least(i * 4 + j, 29)) GROUP BY 1, 2",
        "patch_aux_stats": "SELECT aux, round(avg(x), 4) + 0 AS mean, round(greatest(stddev_pop(x), CASE WHEN aux = 'log_return_mean' THEN 1.0 ELSE 1e-6 END), 4) AS std FROM (SELECT 'log_return_mean' AS aux, rm * 1e6 AS x FROM wstats UNION ALL SELECT 'ofi_mean', om FROM wstats UNION ALL SELECT 'log_return_logstd', ln(rs + 1e-8) FROM wstats UNION ALL SELECT 'ofi_logstd', ln(os + 1e-8) FROM wstats) GROUP BY 1",
        "auc_exact": "SELECT round(sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0), 8) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM (SELECT score, p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM scored GROUP BY 1))",
        "binary_metrics": f"SELECT {_metrics('0.5')} FROM scored",
        "model_metrics": f"SELECT * FROM (SELECT {_metrics('0.5')} FROM scored), ({_AREA}), (SELECT {_COUNTS} FROM scored)",
        "best_by_sharpe": f"SELECT * FROM ({_POOL}) WHERE sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gate ORDER BY sharpe DESC, model, gate, q) = 1",
        "threshold_sweep": f"SELECT CAST(t AS DOUBLE) AS threshold, {_metrics('t')} FROM scored, (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) x(t) GROUP BY 1",
    }.items()
}
