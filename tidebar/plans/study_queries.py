"""Queries of context, volatility, labels, backtests, cross-sections and events."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import backtest, context, crosssection, events, ranges
from ..operators.recurrence import compute_all
from ..sources.bars import UNITS, bars_daily, bars_hourly
from ..sources.shared import kept
from . import indicator_queries as iq
from . import oracle as q

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql is not None:
        ORACLE[name] = sql


def flat(df, keys: list[str], columns: list[str], digits: int = 6):
    return df.select(*keys, *[(F.round(F.col(c) + 1.23456789e-8, digits) + F.lit(0.0)).alias(c) for c in columns])


def r6(x: str) -> str:
    return f"round(({x}) + 1.23456789e-8::DOUBLE, 6) + 0.0::DOUBLE"


def rows(keys: list[str], columns: dict[str, str], body: str, base: str = q.DAILY) -> str:
    """SELECT keys and rounded columns FROM body, whose CTEs follow base."""
    picks = ", ".join([*keys, *(f"{r6(x)} AS {n}" for n, x in columns.items())])
    ctes, _, source = body.rpartition("||")
    return f"WITH RECURSIVE {base.strip()}{', ' + ctes if ctes else ''} SELECT {picks} FROM {source}"


# Calendar
CAL = ["hour", "weekday", "month", "quarter", "month_progress", "quarter_progress", "year_progress", "asia", "europe", "us"]
CIRCLES = [f"{n}_{f}" for n in ("hour", "weekday", "month", "quarter") for f in ("sin", "cos")]
T = "make_timestamp(ts * 1000)"
_cal = {
    "hour": f"hour({T}) + minute({T}) / 60.0::DOUBLE",
    "weekday": f"CAST(isodow({T}) - 1 AS DOUBLE)",
    "month": f"CAST(month({T}) AS DOUBLE)",
    "quarter": f"CAST(quarter({T}) AS DOUBLE)",
    "month_progress": f"CAST(day({T}) - 1 AS DOUBLE) / (day(last_day({T})) - 1)",
    "quarter_progress": f"CAST(date_diff('second', date_trunc('quarter', {T}), {T}) AS DOUBLE) / date_diff('second', date_trunc('quarter', {T}), date_trunc('quarter', {T}) + INTERVAL 3 MONTH)",
    "year_progress": f"(dayofyear({T}) - 1) / 365.0::DOUBLE",
    "asia": f"CAST(hour({T}) < 8 AS DOUBLE)",
    "europe": f"CAST(hour({T}) BETWEEN 7 AND 15 AS DOUBLE)",
    "us": f"CAST(hour({T}) BETWEEN 13 AND 20 AS DOUBLE)",
}
for _n, _of, _x in (("hour", 24, _cal["hour"]), ("weekday", 7, _cal["weekday"]), ("month", 12, f"month({T})"), ("quarter", 4, f"quarter({T})")):
    for _f in ("sin", "cos"):
        _cal[f"{_n}_{_f}"] = f"{_f}(2 * pi() * ({_x}) / {_of})"
add("calendar_axes", lambda spark, d: flat(context.calendar(bars_hourly(spark, d)), ["symbol", "ts"], [*CAL, *CIRCLES]), rows(["symbol", "ts"], _cal, "hours", q.HOURLY))
_states = ["vol_percentile", "volatility", "trend"]
SLOPE = f"ln(close / {q.lag('close', 20)})"
REGIME = f"""{', '.join([q.TR, iq.DM, *iq.DI, q.seeded('x', 14, q.rma_a(14), 'ax', 'dx')])},
r0 AS (SELECT b.*, a.y AS atr, ax.y AS adx, a.y / nullif(close, 0.0::DOUBLE) AS ap, {SLOPE.replace('symbol', 'b.symbol').replace('ORDER BY ts', 'ORDER BY b.ts')} AS slope FROM bars b {q.left('a', 'ax')}),
r1 AS (SELECT *, list(ap) {q.over(250)} AS w_ap FROM r0),
r2 AS (SELECT *, CASE WHEN list_count(w_ap) >= 30 THEN coalesce(CAST(len(list_filter(w_ap[1:len(w_ap)-1], lambda v: v < ap)) AS DOUBLE) / (len(w_ap) - 1), 0) END AS vp FROM r1),
rg AS (SELECT *, CASE WHEN vp < 0.35 THEN 0 WHEN vp < 0.75 THEN 1 WHEN vp IS NOT NULL THEN 2 END AS vol, CASE WHEN adx IS NULL OR slope IS NULL THEN NULL WHEN adx < 20 THEN 0 WHEN slope > 0 THEN 1 ELSE -1 END AS trend FROM r2)"""
add("regime", lambda spark, d: flat(context.regime(bars_daily(spark, d)), ["symbol", "ts"], _states, 4), rows(["symbol", "ts"], {"vol_percentile": "vp", "volatility": "vol", "trend": "trend"}, f"{REGIME}||rg").replace(", 6) + 0.0", ", 4) + 0.0"))
add(
    "regime_latest",
    lambda spark, d: flat(context.latest_regime(bars_daily(spark, d)), ["symbol", "ts"], [*_states, "adx"], 4),
    rows(["symbol", "ts"], {"vol_percentile": "vp", "volatility": "coalesce(vol, 1)", "trend": "coalesce(trend, 0)", "adx": "adx"}, f"{REGIME}, la AS (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)||la").replace(", 6) + 0.0", ", 4) + 0.0"),
)
_clip = lambda x, lo=-1.0, hi=1.0: f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE) END"
SITUATION = f"""{REGIME}, {q.seeded('close', 20, q.ema_a(20), 'e', 'bars')}, {q.seeded('close', 60, q.ema_a(60), 'es', 'bars')}, {', '.join([*iq.RSI, *iq.MACD, iq.FISHER, iq.SQ, q.seeded('x', 20, q.rma_a(20), 'ka', 'tr')])},
u0 AS (SELECT b.*, e.y AS e20, es.y AS e60, rs.x AS rsi, m.x - nn_.y AS hist, fi.f AS fisher, CASE WHEN sl.s IS NOT NULL AND ka.y IS NOT NULL THEN CAST((sl.m + 2 * sl.s < e.y + 1.5 * ka.y AND sl.m - 2 * sl.s > e.y - 1.5 * ka.y) AS DOUBLE) END AS onn, sl.m AS bm, sl.s AS bs
       FROM rg b {q.left('e', 'es', 'rs', 'm', 'nn_', 'fi', 'sl', 'ka')}),
u1 AS (SELECT *, {q.lag('e20', 10)} AS e20b, {q.full('max', 'high', 20)} AS h20, {q.full('min', 'low', 20)} AS l20, CASE WHEN count(volume) {q.over(20)} >= 5 THEN avg(volume) {q.over(20)} END AS v20, ({q.full('sum', 'cv', 20)}) / nullif({q.full('sum', 'volume', 20)}, 0.0::DOUBLE) AS cmf,
       100 * (close - ({q.full('min', 'low', 14)})) / nullif(({q.full('max', 'high', 14)}) - ({q.full('min', 'low', 14)}), 0.0::DOUBLE) AS raw, (({iq.mid(9)}) + ({iq.mid(26)})) / 2 AS lead_a, {iq.mid(52)} AS lead_b, count(*) OVER (PARTITION BY symbol) AS nb FROM (SELECT *, {q.CLV} * volume AS cv FROM u0)),
u2 AS (SELECT *, {q.full('avg', 'raw', 3)} AS k, {q.lag('lead_a', 26)} AS sa, {q.lag('lead_b', 26)} AS sb FROM u1),
si AS (SELECT *, greatest(sa, sb) AS top, least(sa, sb) AS bot, make_timestamp(ts * 1000) AS tt FROM u2 WHERE nb >= 30)"""
_axes = {
    "px_over_ema20": "tanh((close / e20 - 1) / 0.05::DOUBLE)",
    "px_over_ema60": "tanh((close / e60 - 1) / 0.1::DOUBLE)",
    "ema_spread": "tanh((e20 / e60 - 1) / 0.05::DOUBLE)",
    "ema_slope": "tanh(ln(e20 / e20b) / 0.05::DOUBLE)",
    "rsi": "rsi / 50 - 1",
    "stoch_k": "k / 50 - 1",
    "macd_hist": "tanh(hist / close / 0.005::DOUBLE)",
    "roc_20": "tanh(slope / 0.1::DOUBLE)",
    "fisher": "tanh(fisher / 2)",
    "percent_b": _clip(f"({_clip('(close - (bm - 2 * bs)) / nullif(4 * bs, 0.0::DOUBLE)', -0.5, 1.5)}) * 2 - 1"),
    "range_position": _clip("(close - l20) / nullif(h20 - l20, 0.0::DOUBLE) * 2 - 1"),
    "cloud_position": "tanh(CASE WHEN close > top THEN (close - top) / nullif(top - bot, 0.0::DOUBLE) WHEN close < bot THEN (close - bot) / nullif(top - bot, 0.0::DOUBLE) ELSE 0 END)",
    "atr_pct": "tanh(ap / 0.02::DOUBLE)",
    "bandwidth": "tanh(4 * bs / nullif(bm, 0.0::DOUBLE) / 0.08::DOUBLE)",
    "squeeze": "onn * 2 - 1",
    "volume_ratio": "CASE WHEN volume = 0 AND v20 > 0 THEN -1 WHEN volume > 0 THEN tanh(ln(volume / nullif(v20, 0.0::DOUBLE)) / 0.7::DOUBLE) END",
    "cmf": _clip("cmf"),
    "vol_percentile": "vp * 2 - 1",
    "trend_state": "trend",
    "adx": "tanh(adx / 25 - 1)",
    **{f"{n}_{f}": f"{f}(2 * pi() * {x} / {k})" for n, x, k in (("hour", "(hour(tt) + minute(tt) / 60.0::DOUBLE)", 24), ("weekday", "(isodow(tt) - 1)", 7), ("month", "month(tt)", 12)) for f in ("sin", "cos")},
    "month_progress": "CAST(day(tt) - 1 AS DOUBLE) / (day(last_day(tt)) - 1) * 2 - 1",
    "quarter_progress": "CAST(date_diff('second', date_trunc('quarter', tt), tt) AS DOUBLE) / date_diff('second', date_trunc('quarter', tt), date_trunc('quarter', tt) + INTERVAL 3 MONTH) * 2 - 1",
}
add("situation_vector", lambda spark, d: flat(context.situation(bars_daily(spark, d)).where("month_sin IS NOT NULL"), ["symbol", "ts"], context.AXES, 4), rows(["symbol", "ts"], {a: _axes[a] for a in context.AXES}, f"{SITUATION}||si").replace(", 6) + 0.0", ", 4) + 0.0"))

# Range volatility, micro-structure, labels
_est = ["parkinson", "garman_klass", "rogers_satchell", "yang_zhang"]
_root = lambda agg: f"sqrt(greatest({agg}, 0.0::DOUBLE))"
_k = 0.34 / (1.34 + 21 / 19)
_full = lambda x: f"count({x}) {q.over(20)} = 20"
add(
    "range_volatility",
    lambda spark, d: flat(ranges.range_volatility(bars_daily(spark, d)), ["symbol", "ts"], _est),
    rows(
        ["symbol", "ts"],
        {
            "parkinson": f"CASE WHEN {_full('p')} THEN {_root('avg(p) ' + q.over(20))} END",
            "garman_klass": f"CASE WHEN {_full('g')} THEN {_root('avg(g) ' + q.over(20))} END",
            "rogers_satchell": f"CASE WHEN {_full('r')} THEN {_root('avg(r) ' + q.over(20))} END",
            "yang_zhang": f"CASE WHEN {_full('o')} THEN {_root(f'var_samp(o) {q.over(20)} + {_k}::DOUBLE * var_samp(co) {q.over(20)} + (1 - {_k}::DOUBLE) * avg(r) {q.over(20)}')} END",
        },
        f"""l AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(open / {q.lag('close')}) AS o,
                ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS r FROM bars),
            e AS (SELECT *, hl * hl / {4 * math.log(2)}::DOUBLE AS p, 0.5::DOUBLE * hl * hl - {2 * math.log(2) - 1}::DOUBLE * co * co AS g FROM l)||e""",
    ),
)
_tanh = lambda x: f"tanh({x})"
add(
    "micro_features",
    lambda spark, d: flat(ranges.micro(bars_daily(spark, d)), ["symbol", "ts"], ["clv", "signed_volume", "pressure", "wick_bias"]),
    rows(
        ["symbol", "ts"],
        {
            "clv": "k",
            "signed_volume": "sv",
            "pressure": f"CASE WHEN count(sv) {q.over(10)} >= 3 THEN tanh(3 * avg(sv) {q.over(10)}) END",
            "wick_bias": "coalesce(((least(open, close) - low) - (high - greatest(open, close))) / nullif(high - low, 0.0::DOUBLE), 0.0::DOUBLE)",
        },
        f"m AS (SELECT *, {q.CLV} AS k, CASE WHEN count(volume) {q.over(20)} >= 5 THEN avg(volume) {q.over(20)} END AS v20 FROM bars), mv AS (SELECT *, tanh(k * volume / nullif(v20, 0.0::DOUBLE)) AS sv FROM m)||mv",
    ),
)
add("forward_return", lambda spark, d: flat(ranges.forward_return(bars_daily(spark, d), 5), ["symbol", "ts"], ["fwd"]), rows(["symbol", "ts"], {"fwd": f"ln({q.lead('close', 5)} / close)"}, "bars"))
WILDER = q.seeded("x", 14, q.rma_a(14), "atr", "tr")
ATR = f"{q.TR}, {WILDER}"
AHEAD = f"OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"
add(
    "triple_barrier",
    lambda spark, d: flat(ranges.triple_barrier(compute_all(bars_daily(spark, d), [("atr", {})], lambda key, out: "w"), "w"), ["symbol", "ts"], ["label", "hit_bars", "ret"]),
    rows(
        ["symbol", "ts"],
        {
            "label": "CASE WHEN fin IS NOT NULL AND w > 0 THEN CASE WHEN dn <= up AND dn <= 10 THEN -1.0 WHEN up < dn AND up <= 10 THEN 1.0 ELSE 0.0 END END",
            "hit_bars": "CASE WHEN fin IS NOT NULL AND w > 0 THEN least(dn, up, 10) END",
            "ret": "CASE WHEN fin IS NOT NULL AND w > 0 THEN cs[least(dn, up, 10)] / close - 1 END",
        },
        f"""{ATR}, aw AS (SELECT bars.*, atr.y AS w FROM bars LEFT JOIN atr ON atr.symbol = bars.symbol AND atr.ts = bars.ts),
            w AS (SELECT *, list(high) {AHEAD} AS hs, list(low) {AHEAD} AS ls, list(close) {AHEAD} AS cs, {q.lead('close', 10)} AS fin FROM aw),
            f AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN hs[i] >= close + 2 * w THEN i END), lambda i: i IS NOT NULL)), 11) AS up,
                     coalesce(list_min(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] <= close - w THEN i END), lambda i: i IS NOT NULL)), 11) AS dn FROM w)||f""",
    ),
)


# Backtest of a moving-average cross
def _held(spark, d):
    df = bars_daily(spark, d).withColumns({"_f": s.sma("close", 10), "_s": s.sma("close", 30)})
    df = df.withColumn("decision", F.when(F.col("_f") > F.col("_s"), 1).when(F.col("_f") < F.col("_s"), -1).otherwise(0)).drop("_f", "_s")
    return backtest.positions(df, "decision")


DECIDED = f"""sm AS (SELECT *, {q.full('avg', 'close', 10)} AS f, {q.full('avg', 'close', 30)} AS g, row_number() OVER ({q.P}) - 1 AS n FROM bars),
dd AS (SELECT *, CASE WHEN n < 120 THEN 0 WHEN f > g THEN 1 WHEN f < g THEN -1 ELSE 0 END AS d FROM sm)"""
#: CTEs from dd, a decision d and the number n of each bar, to holdings, trades and equity.
HOLD = f"""pp AS (SELECT *, coalesce({q.lag('d')}, 0) AS pos FROM dd),
hh AS (SELECT *, sum(CASE WHEN pos <> prev THEN 1 ELSE 0 END) OVER ({q.P} ROWS UNBOUNDED PRECEDING) AS trade, coalesce(pos * (close / {q.lag('close')} - 1), 0.0::DOUBLE) AS step, {q.lead('open')} AS no, {q.lead('ts')} AS nt FROM (SELECT *, coalesce({q.lag('pos')}, 0) AS prev FROM pp)),
tr AS (SELECT symbol, trade, arg_min(pos, ts) AS direction, min(ts) AS entry_ts, arg_max(coalesce(nt, ts), ts) AS exit_ts, arg_min(open, ts) AS entry, arg_max(coalesce(no, close), ts) AS exit, max(n + CASE WHEN no IS NULL THEN 0 ELSE 1 END) - min(n) AS held FROM hh WHERE pos <> 0 GROUP BY symbol, trade),
tt AS (SELECT *, direction * (exit / entry - 1) - 0.002::DOUBLE AS ret FROM tr)"""
HELD = f"{DECIDED}, {HOLD}"
add(
    "backtest_trades",
    lambda spark, d: flat(backtest.trades(_held(spark, d)), ["symbol", "entry_ts", "exit_ts"], ["direction", "entry", "exit", "ret", "bars"], 4),
    rows(["symbol", "entry_ts", "exit_ts"], {"direction": "direction", "entry": "entry", "exit": "exit", "ret": "ret", "bars": "held"}, f"{HELD}||tt").replace(", 6) + 0.0", ", 4) + 0.0"),
)
EQUITY = f"eq AS (SELECT *, product(1 + step) OVER ({q.P} ROWS UNBOUNDED PRECEDING) AS equity FROM hh)"
EQ = f"{HELD}, {EQUITY}"
add("backtest_equity", lambda spark, d: flat(backtest.equity(_held(spark, d)), ["symbol", "ts"], ["step", "equity"], 6), rows(["symbol", "ts"], {"step": "step", "equity": "equity"}, f"{EQ}||eq"))
#: CTEs from equity and trades to z, the measures of a symbol.
METRICS = f"""pk AS (SELECT *, max(equity) OVER ({q.P} ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
x AS (SELECT symbol, count(*) > 122 AS l, arg_max(equity, ts) - 1 AS tr, min(equity / peak - 1) AS dd, avg(step) FILTER (WHERE n > 0) / nullif(stddev_samp(step) FILTER (WHERE n > 0), 0.0::DOUBLE) * sqrt(365.0::DOUBLE) AS sh, arg_max(close, ts) / max(close) FILTER (WHERE n = 120) - 1 AS bh FROM pk GROUP BY symbol),
y AS (SELECT symbol, count(*) AS k, avg(CAST(ret > 0 AS DOUBLE)) AS wr, avg(ret) FILTER (WHERE ret > 0) AS aw, avg(ret) FILTER (WHERE ret <= 0) AS al, coalesce(sum(ret) FILTER (WHERE ret > 0), 0.0::DOUBLE) / nullif(abs(sum(ret) FILTER (WHERE ret <= 0)), 0.0::DOUBLE) AS pf FROM tt GROUP BY symbol),
z AS (SELECT symbol, CASE WHEN l THEN tr ELSE 0 END AS total_return, CASE WHEN l THEN dd ELSE 0 END AS max_drawdown, CASE WHEN l THEN sh END AS sharpe, CASE WHEN l THEN coalesce(k, 0) ELSE 0 END AS trades, CASE WHEN l THEN coalesce(wr, 0) ELSE 0 END AS win_rate,
CASE WHEN l THEN coalesce(aw, 0) ELSE 0 END AS avg_win, CASE WHEN l THEN coalesce(al, 0) ELSE 0 END AS avg_loss, CASE WHEN l THEN pf END AS profit_factor, CASE WHEN l THEN aw / nullif(abs(al), 0.0::DOUBLE) END AS payoff, CASE WHEN l THEN bh ELSE 0 END AS buy_hold FROM x LEFT JOIN y USING (symbol))"""
_met = ["total_return", "max_drawdown", "sharpe", "trades", "win_rate", "avg_win", "avg_loss", "profit_factor", "payoff", "buy_hold"]
add(
    "backtest_metrics",
    lambda spark, d: flat(backtest.metrics(_held(spark, d)), ["symbol"], _met),
    rows(
        ["symbol"],
        {n: n for n in _met},
        f"{EQ}, {METRICS}||z",
    ),
)

# Cross-section
RET = f"rr AS (SELECT *, ln(close / {q.lag('close')}) AS ret FROM bars), mk AS (SELECT ts, quantile_cont(ret, 0.5) AS market_ret, count(*) AS breadth FROM rr WHERE ret IS NOT NULL GROUP BY ts)"
add("market_series", lambda spark, d: flat(crosssection.market_series(bars_daily(spark, d)), ["ts"], ["market_ret", "breadth"]), rows(["ts"], {"market_ret": "market_ret", "breadth": "breadth"}, f"{RET}||mk"))
_mf = ["market_ret_5", "market_ret_20", "rel_strength_5", "rel_strength_20", "beta", "market_vol"]
_place = lambda x, least: f"CASE WHEN list_count(w_{x}) >= {least} THEN coalesce(CAST(len(list_filter(w_{x}[1:len(w_{x})-1], lambda v: v < {x})) AS DOUBLE) / (len(w_{x}) - 1), 0) END"
_sum = lambda x, n: f"CASE WHEN count({x}) {q.over(n)} = {n} THEN sum({x}) {q.over(n)} END"
add(
    "market_features",
    lambda spark, d: flat(crosssection.market_features(bars_daily(spark, d)), ["symbol", "ts"], _mf, 5),
    rows(
        ["symbol", "ts"],
        {f"market_ret_{n}": f"CASE WHEN enough THEN tanh(({_sum('m', n)}) / 0.05::DOUBLE) END" for n in (5, 20)}
        | {f"rel_strength_{n}": f"CASE WHEN enough THEN tanh((({_sum('ret', n)}) - ({_sum('m', n)})) / 0.03::DOUBLE) END" for n in (5, 20)}
        | {"beta": f"CASE WHEN enough AND count(ret + m) {q.over(120)} >= 60 THEN tanh(covar_samp(ret, m) {q.over(120)} / nullif(var_samp(m) {q.over(120)}, 0.0::DOUBLE) - 1) END", "market_vol": f"CASE WHEN enough THEN ({_place('mv', 120)}) * 2 - 1 END"},
        f"""{RET}, jj AS (SELECT rr.*, mk.market_ret AS m FROM rr LEFT JOIN mk USING (ts)),
            jm AS (SELECT *, CASE WHEN count(m) {q.over(120)} >= 60 THEN stddev_pop(m) {q.over(120)} END AS mv, count(*) OVER (PARTITION BY symbol) >= 145 AND count(m) OVER (PARTITION BY symbol) >= 120 AS enough FROM jj),
            jw AS (SELECT *, list(mv) {q.over(240)} AS w_mv FROM jm)||jw""",
    ).replace(", 6) + 0.0", ", 5) + 0.0"),
)


def _panel(spark, d):
    return ranges.forward_return(bars_daily(spark, d), 1).withColumn("factor", F.round(100 * (F.col("close") / s.lag("close", 5) - 1) + 1.2345e-8, 2))


PANEL = f"pa AS (SELECT *, ln({q.lead('close')} / close) AS fwd, round(100 * (close / {q.lag('close', 5)} - 1) + 1.2345e-8::DOUBLE, 2) AS factor FROM bars), pv AS (SELECT * FROM pa WHERE factor IS NOT NULL AND fwd IS NOT NULL)"
IC = f"""{PANEL}, rk AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY factor) + (count(*) OVER (PARTITION BY ts, factor) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2.0::DOUBLE AS y FROM pv),
ic AS (SELECT ts, count(*) AS n, CASE WHEN count(*) >= 5 THEN (avg(x * y) - avg(x) * avg(y)) / nullif(stddev_pop(x) * stddev_pop(y), 0.0::DOUBLE) END AS ic FROM rk GROUP BY ts)"""
add("spearman_ic", lambda spark, d: flat(crosssection.spearman(_panel(spark, d), "factor", "fwd"), ["ts"], ["n", "ic"]), rows(["ts"], {"n": "n", "ic": "ic"}, f"{IC}||ic"))
add(
    "factor_measure",
    lambda spark, d: flat(crosssection.measure(_panel(spark, d), "factor", "fwd", UNITS["d"]).withColumn("usable", F.col("usable").cast("double")), [], ["ic", "t", "folds", "coverage", "usable"]),
    rows(
        [],
        {
            "ic": "CASE WHEN n < 40 THEN 0 WHEN k >= 3 THEN m ELSE av END",
            "t": "CASE WHEN n >= 40 AND k >= 3 AND sd > 0 THEN m * sqrt(n) / sd ELSE 0 END",
            "folds": "CASE WHEN n < 40 THEN 0 ELSE k END",
            "coverage": "n",
            "usable": "CAST(coalesce(n >= 40 AND k >= 3 AND abs(m) >= 0.01 AND same = k, false) AS DOUBLE)",
        },
        f"""{IC}, iv AS (SELECT * FROM ic WHERE ic IS NOT NULL), sp AS (SELECT min(ts) AS a, max(ts) AS z, count(*) AS n, avg(ic) AS av, stddev_samp(ic) AS sd FROM iv),
            pf AS (SELECT fold, count(*) FILTER (WHERE ts <= a + (z - a) * fold / 5.0::DOUBLE) AS tr, count(*) FILTER (WHERE te) AS ten, avg(ic) FILTER (WHERE te) AS m
                   FROM (SELECT iv.*, f.fold, sp.a, sp.z, ts > a + (z - a) * f.fold / 5.0::DOUBLE + 86400000 AND ts <= a + (z - a) * (f.fold + 1) / 5.0::DOUBLE AS te FROM iv, sp, (SELECT unnest([1, 2, 3, 4]) AS fold) f) GROUP BY fold),
            pm AS (SELECT avg(m) AS m, count(*) AS k, abs(sum(sign(m))) AS same FROM pf WHERE tr >= 200 AND ten >= 60), ms AS (SELECT * FROM sp, pm)||ms""",
    ),
)
add(
    "rank_score",
    lambda spark, d: flat(crosssection.score(_panel(spark, d), {"factor": -1.0, "volume": 1.0}), ["symbol", "ts"], ["score"]),
    rows(
        ["symbol", "ts"],
        {"score": "CASE WHEN nv >= 5 THEN (CASE WHEN nf >= 5 THEN -coalesce((ff - avg(ff) OVER (PARTITION BY ts)) / nullif(stddev_pop(ff) OVER (PARTITION BY ts), 0.0::DOUBLE), 0.0::DOUBLE) ELSE 0 END + coalesce((volume - avg(volume) OVER (PARTITION BY ts)) / nullif(stddev_pop(volume) OVER (PARTITION BY ts), 0.0::DOUBLE), 0.0::DOUBLE)) / CASE WHEN nf >= 5 THEN 2 ELSE 1 END END"},
        f"{PANEL}, fl AS (SELECT *, coalesce(factor, quantile_cont(factor, 0.5) OVER (PARTITION BY ts)) AS ff, count(factor) OVER (PARTITION BY ts) AS nf, count(volume) OVER (PARTITION BY ts) AS nv FROM pa)||fl",
    ),
)
add(
    "spread_buckets",
    lambda spark, d: flat(crosssection.spread(_panel(spark, d), {"factor": -1.0, "volume": 1.0}, "fwd"), [], ["bucket", "n", "mean"]),
    rows([], {"bucket": "bucket", "n": "n", "mean": "mean"}, f"""{PANEL}, pz AS (SELECT *, -(factor - avg(factor) OVER (PARTITION BY ts)) / nullif(stddev_samp(factor) OVER (PARTITION BY ts), 0.0::DOUBLE) AS zf, (volume - avg(volume) OVER (PARTITION BY ts)) / nullif(stddev_samp(volume) OVER (PARTITION BY ts), 0.0::DOUBLE) AS zv FROM pa WHERE fwd IS NOT NULL),
        ps AS (SELECT *, (coalesce(zf, 0) + coalesce(zv, 0)) / nullif(CAST(zf IS NOT NULL AS INT) + CAST(zv IS NOT NULL AS INT), 0) AS score FROM pz),
        pl AS (SELECT fwd, least(floor(CAST(row_number() OVER (PARTITION BY ts ORDER BY score, symbol) AS DOUBLE) / count(*) OVER (PARTITION BY ts) * 3), 2) AS bucket FROM ps WHERE score IS NOT NULL), bk AS (SELECT bucket, count(*) AS n, avg(fwd) AS mean FROM pl GROUP BY bucket)||bk"""),
)

# Events
PRE = f"OVER ({q.P} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"
_rank = lambda x: _place(x, 60)
_sev = lambda x: f"greatest(0.1::DOUBLE, least(1.0::DOUBLE, {x}))"
FOUND = f"""{WILDER}, c0 AS (SELECT b.*, a.y / nullif(close, 0.0::DOUBLE) AS ap FROM bars b LEFT JOIN atr a ON a.symbol = b.symbol AND a.ts = b.ts),
c1 AS (SELECT *, close / {q.lag('close')} - 1 AS chg, abs(open / {q.lag('close')} - 1) AS ag, CASE WHEN count(high) {PRE} >= 60 THEN max(high) {PRE} END AS top, CASE WHEN count(low) {PRE} >= 60 THEN min(low) {PRE} END AS bottom,
       CASE WHEN count(volume) {q.over(20)} >= 5 THEN avg(volume) {q.over(20)} END AS v20, CAST(row_number() OVER ({q.P}) AS BIGINT) AS i, count(*) OVER (PARTITION BY symbol) AS bars_ FROM c0),
c2 AS (SELECT *, abs(ln(1 + chg)) AS ar, high > top AND {q.lag('high')} <= {q.lag('top')} AS up, low < bottom AND {q.lag('low')} >= {q.lag('bottom')} AS dn FROM c1),
c3 AS (SELECT *, list(ar) {q.over(250)} AS w_ar, list(volume) {q.over(250)} AS w_volume, list(ag) {q.over(250)} AS w_ag, list(ap) {q.over(250)} AS w_ap FROM c2),
c4 AS (SELECT *, {_rank('ar')} AS ra, {_rank('volume')} AS rv, {_rank('ag')} AS rg, {_rank('ap')} AS rp FROM c3),
c5 AS (SELECT *, {q.lag('rp')} AS before FROM c4),
br AS (SELECT symbol, ts, i, 'new_high' AS kind FROM c5 WHERE up AND bars_ >= 65 UNION ALL SELECT symbol, ts, i, 'new_low' FROM c5 WHERE dn AND bars_ >= 65),
ck(symbol, kind, i) AS (
  SELECT symbol, kind, min(i) FROM br GROUP BY symbol, kind
  UNION ALL
  SELECT symbol, kind, i FROM (SELECT br.symbol, br.kind, min(br.i) OVER (PARTITION BY br.symbol, br.kind) AS i, br.i AS j FROM ck JOIN br ON br.symbol = ck.symbol AND br.kind = ck.kind AND br.i - ck.i > 25) WHERE i = j),
found AS (
  SELECT symbol, ts, 'spike' AS kind, {_sev('abs(chg) / 0.15::DOUBLE')} AS severity FROM c5 WHERE ra >= 0.99 AND bars_ >= 65
  UNION ALL SELECT symbol, ts, 'volume', {_sev('volume / v20 / 6')} FROM c5 WHERE rv >= 0.99 AND v20 > 0 AND bars_ >= 65
  UNION ALL SELECT symbol, ts, 'volatility', {_sev('ap / 0.05::DOUBLE')} FROM c5 WHERE rp >= 0.99 AND before < 0.9 AND bars_ >= 65
  UNION ALL SELECT symbol, ts, 'gap', {_sev('ag / 0.05::DOUBLE')} FROM c5 WHERE rg >= 0.99 AND ag >= 0.002 AND bars_ >= 65
  UNION ALL SELECT br.symbol, br.ts, br.kind, 0.5::DOUBLE FROM br JOIN ck ON ck.symbol = br.symbol AND ck.kind = br.kind AND ck.i = br.i)"""
DETECT = f"{q.TR}, {FOUND}"
add("detect_events", lambda spark, d: flat(events.detect(bars_daily(spark, d)), ["symbol", "ts", "kind"], ["severity"], 5), rows(["symbol", "ts", "kind"], {"severity": "severity"}, f"{DETECT}||found").replace(", 6) + 0.0", ", 5) + 0.0"))
add("merge_same_bar", lambda spark, d: flat(events.merge(events.detect(bars_daily(spark, d))), ["symbol", "ts", "kinds"], ["severity"], 5), rows(["symbol", "ts", "kinds"], {"severity": "severity"}, f"{DETECT}, mg AS (SELECT symbol, ts, string_agg(kind, '+' ORDER BY severity DESC, kind) AS kinds, least(1.0::DOUBLE, greatest(0.1::DOUBLE, max(severity) + 0.1::DOUBLE * (count(*) - 1))) AS severity FROM found GROUP BY symbol, ts)||mg").replace(", 6) + 0.0", ", 5) + 0.0"))


def _partners(spark, d):
    """Half an hour past every hourly bar, under the symbol next by name (the last one's is the first): times to look up."""
    h = bars_hourly(spark, d)
    names = F.array_sort(F.collect_set("symbol"))
    nxt = h.agg(names.alias("n")).select(F.posexplode("n").alias("i", "symbol"), "n").select("symbol", F.get("n", F.pmod(F.col("i") + 1, F.size("n"))).alias("other"))
    return h.join(nxt, "symbol").select(F.col("other").alias("symbol"), (F.col("ts") + 1_800_000).alias("ts"))


for _name, _fwd, _op in (("asof_backward", False, ">="), ("asof_forward", True, "<=")):
    add(
        _name,
        lambda spark, d, fwd=_fwd: flat(events.asof(_partners(spark, d), bars_hourly(spark, d), "close", fwd), ["symbol", "ts"], ["value"]),
        rows(
            ["symbol", "ts"],
            {"value": "close"},
            f"""sy AS (SELECT symbol, coalesce(lead(symbol) OVER (ORDER BY symbol), min(symbol) OVER ()) AS other FROM (SELECT DISTINCT symbol FROM hours)),
                er AS (SELECT other AS symbol, ts + 1800000 AS ts FROM hours JOIN sy USING (symbol)), ao AS (SELECT er.symbol, er.ts, h.close FROM er ASOF LEFT JOIN hours h ON h.symbol = er.symbol AND er.ts {_op} h.ts)||ao""",
            q.HOURLY,
        ),
    )
STUDY = f"""rr AS (SELECT *, ln(close / {q.lag('close')}) AS ret FROM bars),
est AS (SELECT *, count(ret) OVER ({q.P} ROWS BETWEEN 130 PRECEDING AND 11 PRECEDING) AS k, avg(ret) OVER ({q.P} ROWS BETWEEN 130 PRECEDING AND 11 PRECEDING) AS mu, row_number() OVER ({q.P}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rr),
hit AS (SELECT f.kind, est.* FROM est JOIN found f ON f.symbol = est.symbol AND f.ts = est.ts WHERE k >= 60 AND i > 131 AND i + 20 <= n),
ab AS (SELECT h.kind, h.symbol, h.ts, e.i - h.i AS o, e.ret - h.mu AS ar FROM hit h JOIN est e ON e.symbol = h.symbol AND e.i BETWEEN h.i - 5 AND h.i + 20),
ca AS (SELECT *, sum(ar) OVER (PARTITION BY kind, symbol, ts ORDER BY o) AS car FROM ab)"""
_study = {"events": "events", "mean_ar": "(exp(ar) - 1) * 100", "mean_car": "(exp(car) - 1) * 100", "median_car": "(exp(mid) - 1) * 100", "car_low": "(exp(lo) - 1) * 100", "car_high": "(exp(hi) - 1) * 100", "t": "t"}


def _windows(spark, d):
    bars = kept(bars_daily(spark, d))  # read by the detector and by the study
    return events.event_windows(bars, events.detect(bars))


add(
    "event_study_car",
    lambda spark, d: flat(events.event_study(_windows(spark, d), "kind"), ["kind"], ["offset", *_study], 5),
    rows(
        ["kind"],
        {"offset": "o"} | _study,
        f"""{DETECT}, {STUDY}, st AS (SELECT kind, o, count(*) AS events, avg(ar) AS ar, avg(car) AS car, quantile_cont(car, 0.5) AS mid, quantile_cont(car, 0.25) AS lo, quantile_cont(car, 0.75) AS hi,
            coalesce(avg(car) * sqrt(count(*)) / nullif(stddev_samp(car), 0.0::DOUBLE), 0.0::DOUBLE) AS t FROM ca GROUP BY kind, o HAVING count(*) >= 3)||st""",
    ).replace(", 6) + 0.0", ", 5) + 0.0").replace("AS offset", 'AS "offset"'),
)
_groups = ["events", "available", "final_car", "final_t", "hit_rate", "significant", "overlapping"]
add(
    "event_study_groups",
    lambda spark, d: flat(events.study_groups(_windows(spark, d), "kind").withColumns({c: F.col(c).cast("double") for c in ("available", "significant", "overlapping")}), ["kind"], _groups, 5),
    rows(
        ["kind"],
        {
            "events": "n",
            "available": "CAST(n >= 3 AS DOUBLE)",
            "final_car": "CASE WHEN n >= 3 THEN (exp(m) - 1) * 100 END",
            "final_t": "CASE WHEN n >= 3 THEN t END",
            "hit_rate": "CASE WHEN n >= 3 THEN up END",
            "significant": "CASE WHEN n >= 3 THEN CAST(abs(t) >= 1.96 AS DOUBLE) END",
            "overlapping": "CASE WHEN n >= 3 THEN near END",
        },
        f"""{DETECT}, {STUDY}, fin AS (SELECT * FROM ca WHERE o = 20), ov AS (SELECT kind, max(CAST(coalesce(i - p < 25, false) AS DOUBLE)) AS near FROM (SELECT kind, i, lag(i) OVER (PARTITION BY kind, symbol ORDER BY i) AS p FROM hit) GROUP BY kind),
            gp AS (SELECT kind, count(*) AS n, avg(car) AS m, coalesce(avg(car) * sqrt(count(*)) / nullif(stddev_samp(car), 0.0::DOUBLE), 0.0::DOUBLE) AS t, avg(CAST(car > 0 AS DOUBLE)) AS up FROM fin GROUP BY kind), gv AS (SELECT * FROM gp JOIN ov USING (kind))||gv""",
    ).replace(", 6) + 0.0", ", 5) + 0.0"),
)
add(
    "spike_islands",
    lambda spark, d: flat(events.spike_islands(bars_daily(spark, d).select("symbol", "ts", F.col("volume").alias("value"))), ["symbol", "ts"], ["value"]),
    rows(["symbol", "ts"], {"value": "v"}, f"nn AS (SELECT symbol, ts, volume, row_number() OVER ({q.P}) AS n FROM bars), ct AS (SELECT symbol, quantile_cont(volume, 0.97) AS cut FROM bars GROUP BY symbol), ab AS (SELECT nn.*, n - row_number() OVER (PARTITION BY symbol ORDER BY ts) AS run FROM nn JOIN ct USING (symbol) WHERE volume >= cut), pk AS (SELECT symbol, max(volume) AS v, arg_max(ts, (volume, -ts)) AS ts FROM ab GROUP BY symbol, run)||pk"),
)
