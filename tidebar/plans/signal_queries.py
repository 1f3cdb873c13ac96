"""Queries of rules, votes and their backtest, with SQL that derives every rule from the bars again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, signals
from ..operators.indicators import PATTERNS
from ..sources.bars import bars_daily
from . import indicator_queries as iq
from . import oracle as q
from .study_queries import EQUITY, HOLD, METRICS, flat, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, f, sql):
    QUERIES[name], ORACLE[name] = f, sql


def apart(name: str, ctes: list[str], columns: dict[str, str], *joined: str) -> str:
    """A CTE of its own for an indicator, so that names inside it meet no others."""
    picks = ", ".join(f"{x} AS {n}" for n, x in columns.items())
    return f"{name} AS MATERIALIZED (WITH RECURSIVE {', '.join(ctes)} SELECT b.symbol, b.ts, {picks} FROM bars b {q.left(*joined)})"


INDICATORS = [
    apart("i_ma", [iq.E("close", 20, q.ema_a(20), "e1", "bars"), iq.E("close", 60, q.ema_a(60), "e2", "bars")], {"e20": "e1.y", "e60": "e2.y"}, "e1", "e2"),
    apart("i_macd", iq.MACD, {"macd": "m.x", "macds": "nn_.y", "hist": "m.x - nn_.y"}, "m", "nn_"),
    apart("i_rsi", iq.RSI, {"rsi": "rs.x"}, "rs"),
    apart("i_st", [iq.TREND], {"st": "sv.way"}, "sv"),
    apart("i_adx", [q.TR, iq.DM, *iq.DI, iq.E("x", 14, q.rma_a(14), "ax", "dx")], {"adx": "ax.y", "pdi": "di.p", "mdi": "di.n"}, "ax", "di"),
    apart("i_sq", [q.TR, iq.SQ, iq.E("x", 20, q.rma_a(20), "a", "tr"), iq.E("close", 20, q.ema_a(20), "e", "bars")], {"mom": "sl.fit", "sqz": "sl.m + 2 * sl.s < e.y + 1.5 * a.y AND sl.m - 2 * sl.s > e.y - 1.5 * a.y"}, "sl", "a", "e"),
    apart("i_fi", [iq.FISHER], {"fish": "fi.f", "trig": "fi.g"}, "fi"),
]
CROSSES = {"tk": ("tenkan", "kijun", 3), "ma": ("e20", "e60", 3), "mc": ("macd", "macds", 2), "fc": ("fish", "trig", 2), "kd": ("stk", "std_", 2)}
_flags = ", ".join(f"CAST({a} {op} {b} AND {q.lag(a)} {no} {q.lag(b)} AS INT) AS {n}_{d}0" for n, (a, b, _) in CROSSES.items() for d, op, no in (("up", ">", "<="), ("dn", "<", ">=")))
_recent = ", ".join(f"coalesce(max({n}_{d}0) {q.over(k)}, 0) = 1 AS {n}_{d}" for n, (_, _, k) in CROSSES.items() for d in ("up", "dn"))
_low14, _high14 = q.full("min", "low", 14), q.full("max", "high", 14)
STEPS = [
    f"SELECT *, row_number() OVER ({q.P}) AS i, {iq.mid(9)} AS tenkan, {iq.mid(26)} AS kijun, {iq.mid(52)} AS lead_b, 100 * {q.ratio(f'close - ({_low14})', f'({_high14}) - ({_low14})')} AS raw, {q.full('avg', 'close', 20)} AS bm, {q.full('stddev_pop', 'close', 20)} AS bd, {q.CLV} * volume AS flow, list(high) {iq.AROUND} AS hs, list(low) {iq.AROUND} AS ls FROM b",
    f"SELECT *, {q.lag('(tenkan + kijun) / 2', 26)} AS span_a, {q.lag('lead_b', 26)} AS span_b, {q.full('avg', 'raw', 3)} AS stk, {q.ratio('close - (bm - 2 * bd)', '4 * bd')} AS pb, ({q.full('sum', 'flow', 20)}) / nullif({q.full('sum', 'volume', 20)}, 0.0::DOUBLE) AS cmf FROM b",
    f"SELECT b.*, {q.full('avg', 'stk', 3)} AS std_, e20, e60, macd, macds, hist, rsi, st, adx, pdi, mdi, mom, sqz, fish, trig FROM b " + " ".join(f"JOIN {x.split(' ')[0]} USING (symbol, ts)" for x in INDICATORS),
    f"SELECT *, {_flags}, {q.lag('hist')} AS hist1, {q.lag('st')} AS st1, {q.lag('sqz')} AS sqz1 FROM b",
    f"SELECT *, {_recent} FROM b",
    *iq.BODIES,
]
#: Swings with the one before; a bar sees those that are five bars old.
SWINGS = [
    f"{name} AS (SELECT symbol, i AS at, x AS p1, r AS r1, lag(x) OVER (PARTITION BY symbol ORDER BY i) AS p0, lag(r) OVER (PARTITION BY symbol ORDER BY i) AS r0 FROM (SELECT symbol, i, {x} AS x, rsi AS r FROM wide WHERE len({xs}) = 11 AND {x} = {best}({xs}) AND len(list_filter({xs}, lambda v: v = {x})) = 1))"
    for name, x, xs, best in (("peaks", "high", "hs", "list_max"), ("troughs", "low", "ls", "list_min"))
]
VIEW = """seen AS (SELECT x.*, h.at AS hi, h.p1 AS h1, h.p0 AS h0, h.r1 AS hr1, h.r0 AS hr0 FROM wide x ASOF LEFT JOIN peaks h ON h.symbol = x.symbol AND x.i - 5 >= h.at),
full_ AS (SELECT x.*, l.at AS li, l.p1 AS l1, l.p0 AS l0, l.r1 AS lr1, l.r0 AS lr0, CASE WHEN hi > l.at THEN l.p1 ELSE h1 END AS leg0, CASE WHEN hi > l.at THEN h1 ELSE l.p1 END AS leg1 FROM seen x ASOF LEFT JOIN troughs l ON l.symbol = x.symbol AND x.i - 5 >= l.at)"""


def _sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1 ELSE -1 END"


_gap = "100 * (e20 - e60) / e60"
_near = " OR ".join(f"abs(close - (leg1 - {r}::DOUBLE * (leg1 - leg0))) / close < 0.005::DOUBLE" for r in (0.382, 0.5, 0.618))
_cloud = "span_a IS NOT NULL AND span_b IS NOT NULL"
_patterns = [(f"coalesce({(iq.BULL | iq.BEAR)[k]}, false)", str(v), "0.5", 0.6) for k, v in PATTERNS.items() if v]
#: (condition, direction, strength, weight); the first that holds is the rule's hit.
CASES = {
    "ichimoku_cloud": [
        (f"{_cloud} AND close > greatest(span_a, span_b)", "1", "least(1, 100 * (close / greatest(span_a, span_b) - 1) / 3)", 1.5),
        (f"{_cloud} AND close < least(span_a, span_b)", "-1", "least(1, 100 * (1 - close / least(span_a, span_b)) / 3)", 1.5),
        (_cloud, "0", "0.2", 1.5),
    ],
    "ichimoku_tk_cross": [("tk_up", "1", "0.7", 1), ("tk_dn", "-1", "0.7", 1)],
    "ma_cross": [("ma_up", "1", "0.8", 1), ("ma_dn", "-1", "0.8", 1), ("e60 IS NOT NULL", _sign("e20 - e60"), f"least(1, abs({_gap}) / 5)", 0.6)],
    "macd_cross": [("mc_up", "1", "0.7", 1), ("mc_dn", "-1", "0.7", 1), ("hist > 0 AND hist > hist1", "1", "0.4", 0.6), ("hist < 0 AND hist < hist1", "-1", "0.4", 0.6)],
    "rsi_zone": [("rsi >= 70", "-1", "least(1, (rsi - 70) / 20)", 1), ("rsi <= 30", "1", "least(1, (30 - rsi) / 20)", 1), ("rsi IS NOT NULL", _sign("rsi - 50"), "abs(rsi - 50) / 50", 0.5)],
    "rsi_divergence": [("h1 > h0 AND hr1 < hr0", "-1", "0.8", 1.3), ("l1 < l0 AND lr1 > lr0", "1", "0.8", 1.3)],
    "supertrend": [("st IS NOT NULL AND (st1 IS NULL OR st1 <> st)", "st", "0.9", 1), ("st IS NOT NULL", "st", "0.5", 0.7)],
    "bollinger": [("pb > 1", "-1", "least(1, 5 * (pb - 1))", 1), ("pb < 0", "1", "least(1, -5 * pb)", 1)],
    "squeeze": [("sqz1 AND NOT sqz AND mom IS NOT NULL", _sign("mom"), "0.9", 1.4), ("sqz AND mom IS NOT NULL", "0", "0.3", 0.8)],
    "adx_strength": [("adx < 20 AND pdi IS NOT NULL AND mdi IS NOT NULL", "0", "0.3", 0.8), ("adx IS NOT NULL AND pdi IS NOT NULL AND mdi IS NOT NULL", _sign("pdi - mdi"), "least(1, adx / 50)", 1)],
    "fisher": [("fc_up", "1", "0.7", 1), ("fc_dn", "-1", "0.7", 1)],
    "stoch": [("stk < 20 AND kd_up", "1", "0.6", 1), ("stk > 80 AND kd_dn", "-1", "0.6", 1)],
    "money_flow": [("abs(cmf) >= 0.05::DOUBLE", _sign("cmf"), "least(1, 4 * abs(cmf))", 0.7)],
    "candle_pattern": _patterns,
    "fib_level": [(f"leg0 <> leg1 AND ({_near})", _sign("leg1 - leg0"), "0.6", 0.9)],
}


def _case(cases, place: int) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {c[0]} THEN {c[place]}" for c in cases) + " END AS DOUBLE)"


_steps, _last = [], "bars"
for _n, _step in enumerate(STEPS):
    _name = "wide" if _n == len(STEPS) - 1 else f"w{_n}"
    _steps.append(f"{_name} AS MATERIALIZED ({_step.replace('FROM b', f'FROM {_last} AS b')})")
    _last = _name
_long = " UNION ALL ".join(f"SELECT symbol, ts, '{k}' AS rule, {_case(v, 1)} AS direction, {_case(v, 2)} AS strength, {_case(v, 3)} AS weight FROM full_" for k, v in CASES.items())
HITS = f"{', '.join([*INDICATORS, *_steps, *SWINGS])}, {VIEW}, hits AS (SELECT * FROM ({_long}) WHERE direction IS NOT NULL)"
VOTE = f"""{HITS}, vote AS (SELECT b.symbol, b.ts, coalesce(sum(direction * strength * weight) / sum(weight), 0.0::DOUBLE) AS score FROM bars b LEFT JOIN hits h ON h.symbol = b.symbol AND h.ts = b.ts GROUP BY b.symbol, b.ts),
told AS (SELECT *, CASE WHEN score > 0.15::DOUBLE THEN 1 WHEN score < -0.15::DOUBLE THEN -1 ELSE 0 END AS direction, least(1, 1.6::DOUBLE * abs(score)) AS confidence FROM vote)"""
HELD = f"{VOTE}, dd AS (SELECT bars.*, n, CASE WHEN n < 120 THEN 0 ELSE direction END AS d FROM bars JOIN (SELECT symbol, ts, direction, row_number() OVER ({q.P}) - 1 AS n FROM told) USING (symbol, ts)), {HOLD}, {EQUITY}, {METRICS}"
BARS = q.DAILY.replace("bars AS (", "bars AS MATERIALIZED (")


def four(sql: str) -> str:
    return sql.replace(", 6) + 0.0", ", 4) + 0.0")


add(
    "rules_long",
    lambda spark, d: flat(signals.hits(bars_daily(spark, d)).select("symbol", "ts", F.explode("hits").alias("h")).select("symbol", "ts", "h.*"), ["symbol", "ts", "rule"], ["direction", "strength", "weight"], 4),
    four(rows(["symbol", "ts", "rule"], {n: n for n in ("direction", "strength", "weight")}, f"{HITS}||hits", BARS)),
)
add(
    "signal_eval",
    lambda spark, d: flat(signals.evaluate(signals.hits(bars_daily(spark, d))), ["symbol", "ts"], ["score", "direction", "confidence"], 4),
    four(rows(["symbol", "ts"], {n: n for n in ("score", "direction", "confidence")}, f"{VOTE}||told", BARS)),
)
_met = ["total_return", "max_drawdown", "trades", "win_rate"]
add(
    "signal_backtest",
    lambda spark, d: flat(backtest.metrics(backtest.positions(signals.decisions(bars_daily(spark, d)), "decision")), ["symbol"], _met, 4),
    four(rows(["symbol"], {n: n for n in _met}, f"{HELD}||z", BARS)),
)
