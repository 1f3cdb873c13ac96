"""Queries of feature tables, factor measurement, rankings, session ends and overlays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import candles, context, crosssection, events, ranges, scenario
from ..sources.bars import UNITS, bar_closed, bars_daily, next_ts, session_end
from ..sources.shared import kept
from . import oracle as q
from .study_queries import DETECT, FOUND, REGIME, RET, flat, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql is not None:
        ORACLE[name] = sql


_full = lambda x, n=20: f"count({x}) {q.over(n)} = {n}"
_root = lambda x: f"CASE WHEN {_full(x)} THEN sqrt(greatest(avg({x}) {q.over(20)}, 0.0::DOUBLE)) END"
_k = 0.34 / (1.34 + 21 / 19)
_logs = lambda a, b: f"ln(least(greatest({a} / CASE WHEN {b} > 0 THEN {b} END, {math.exp(-6)!r}::DOUBLE), {math.exp(6)!r}::DOUBLE))"
RANGE = f"""g0 AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(open / {q.lag('close')}) AS o, ln(close / {q.lag('close')}) AS ret, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS r FROM bars),
g1 AS (SELECT *, hl * hl / {4 * math.log(2)}::DOUBLE AS p, 0.5::DOUBLE * hl * hl - {2 * math.log(2) - 1}::DOUBLE * co * co AS g, greatest(r, 0.0::DOUBLE) AS rv FROM g0),
g2 AS (SELECT *, {_root('p')} AS pk, {_root('g')} AS gk, {_root('r')} AS rs, CASE WHEN {_full('o')} THEN var_samp(o) {q.over(20)} END AS vo, CASE WHEN {_full('ret')} THEN stddev_samp(ret) {q.over(20)} END AS sd,
       CASE WHEN {_full('o')} THEN sqrt(greatest(var_samp(o) {q.over(20)} + {_k}::DOUBLE * var_samp(co) {q.over(20)} + (1 - {_k}::DOUBLE) * avg(r) {q.over(20)}, 0.0::DOUBLE)) END AS yz,
       CASE WHEN count(rv) {q.over(5)} >= 3 THEN avg(rv) {q.over(5)} END AS wk, CASE WHEN count(rv) {q.over(22)} >= 11 THEN avg(rv) {q.over(22)} END AS mo, CASE WHEN {_full('hl')} THEN avg(hl) {q.over(20)} END AS mean FROM g1),
g3 AS (SELECT *, CASE WHEN sd > 1e-12 THEN sd END AS base, CASE WHEN mean > 1e-12 THEN hl / mean END AS now, CASE WHEN yz * yz > 1e-12 THEN vo / (yz * yz) END AS share FROM g2)"""
_range = {
    "parkinson_ratio": "pk / base",
    "gk_ratio": "gk / base",
    "rs_ratio": "rs / base",
    "yz_ratio": "yz / base",
    "overnight_share": "CASE WHEN share IS NOT NULL THEN least(greatest(share, 0.0::DOUBLE), 1.0::DOUBLE) END",
    "har_short": f"CASE WHEN wk > 0 THEN {_logs('rv', 'wk')} END",
    "har_long": f"CASE WHEN mo > 0 AND wk IS NOT NULL THEN {_logs('wk', 'mo')} END",
    "range_pressure": "CASE WHEN now > 0 THEN ln(now) END",
}
add("range_features", lambda spark, d: flat(ranges.range_features(bars_daily(spark, d)), ["symbol", "ts"], list(ranges.RANGE), 5), rows(["symbol", "ts"], _range, f"{RANGE}||g3").replace(", 6) + 0.0", ", 5) + 0.0"))


def _happened(spark, d):
    """The detector's events: gaps stand for what is not of the chart, new highs for what was scheduled."""
    bars = kept(bars_daily(spark, d))
    found = events.detect(bars).select("symbol", "ts", "severity", (F.col("kind") != "gap").alias("chart"), (F.col("kind") == "new_high").alias("scheduled"))
    return ranges.event_features(bars, found)


_mean = lambda y, x: f"r.{y} + (v.{x} - r.{y}) * 2 / 21.0::DOUBLE"
add(
    "event_features",
    lambda spark, d: flat(_happened(spark, d), ["symbol", "ts"], list(ranges.EVENT), 5),
    rows(
        ["symbol", "ts"],
        {"event_recency": "coalesce(exp(-(i - last) / 20.0::DOUBLE) * 2 - 1, -1)", "event_severity": "a", "event_chart": "b", "event_macro": "c", "event_scheduled": "d"},
        f"""{DETECT}, hb AS (SELECT symbol, ts, max(severity) AS a, coalesce(max(severity) FILTER (WHERE kind <> 'gap'), 0) AS b, coalesce(max(severity) FILTER (WHERE kind = 'gap'), 0) AS c, CASE WHEN bool_or(kind = 'new_high') THEN 1.0 ELSE 0.0 END::DOUBLE AS d FROM found GROUP BY symbol, ts),
            hn AS (SELECT b.symbol, b.ts, CAST(row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS BIGINT) AS i, h.a IS NOT NULL AS hit, coalesce(h.a, 0)::DOUBLE AS a, coalesce(h.b, 0)::DOUBLE AS b, coalesce(h.c, 0)::DOUBLE AS c, coalesce(h.d, 0)::DOUBLE AS d FROM bars b LEFT JOIN hb h ON h.symbol = b.symbol AND h.ts = b.ts),
            hr(symbol, i, a, b, c, d) AS (SELECT symbol, i, a, b, c, d FROM hn WHERE i = 1 UNION ALL SELECT v.symbol, v.i, {_mean('a', 'a')}, {_mean('b', 'b')}, {_mean('c', 'c')}, {_mean('d', 'd')} FROM hr r JOIN hn v ON v.symbol = r.symbol AND v.i = r.i + 1),
            hl AS (SELECT symbol, ts, i, max(CASE WHEN hit THEN i END) OVER ({q.P} ROWS UNBOUNDED PRECEDING) AS last FROM hn),
            he AS (SELECT hl.symbol, hl.ts, hl.i, hl.last, hr.a, hr.b, hr.c, hr.d FROM hl JOIN hr ON hr.symbol = hl.symbol AND hr.i = hl.i)||he""",
    ).replace(", 6) + 0.0", ", 5) + 0.0"),
)
AHEAD = f"OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
add(
    "market_forward",
    lambda spark, d: flat(crosssection.market_forward(bars_daily(spark, d), 5), ["symbol", "ts"], ["market_fwd"]),
    rows(["symbol", "ts"], {"market_fwd": f"CASE WHEN count(m) {AHEAD} = 5 THEN sum(m) {AHEAD} END"}, f"{RET}, mj AS (SELECT bars.symbol, bars.ts, mk.market_ret AS m FROM bars LEFT JOIN mk ON mk.ts = bars.ts)||mj"),
)

# Factors: what a bar says of itself, and the same against the symbol's own past.
MICRO = ["clv", "signed_volume", "pressure", "wick_bias"]
FACTORS = [*MICRO, *(f + crosssection.REL for f in MICRO)]


def _panel(spark, d):
    p = ranges.forward_return(ranges.micro(bars_daily(spark, d)), 3).withColumns({f: F.round(f, 6) for f in MICRO})
    return crosssection.with_relative(p, MICRO).withColumns({"fwd_abs": F.abs("fwd"), **{f + crosssection.REL: F.round(f + crosssection.REL, 5) for f in MICRO}})


_rel = lambda f: f"round(CASE WHEN count({f}) {q.over(120)} >= 60 THEN ({f} - avg({f}) {q.over(120)}) / nullif(stddev_pop({f}) {q.over(120)}, 0.0::DOUBLE) END, 5) AS {f}__rel"
PANEL = f"""x0 AS (SELECT *, {q.CLV} AS k, CASE WHEN count(volume) {q.over(20)} >= 5 THEN avg(volume) {q.over(20)} END AS v20 FROM bars), x1 AS (SELECT *, tanh(k * volume / nullif(v20, 0.0::DOUBLE)) AS sv FROM x0),
x2 AS (SELECT symbol, ts, close, round(k, 6) AS clv, round(sv, 6) AS signed_volume, round(CASE WHEN count(sv) {q.over(10)} >= 3 THEN tanh(3 * avg(sv) {q.over(10)}) END, 6) AS pressure,
       round(coalesce(((least(open, close) - low) - (high - greatest(open, close))) / nullif(high - low, 0.0::DOUBLE), 0.0::DOUBLE), 6) AS wick_bias, ln({q.lead('close', 3)} / close) AS fwd FROM x1),
x3 AS (SELECT *, abs(fwd) AS fwd_abs, {', '.join(_rel(f) for f in MICRO)} FROM x2)"""
MEASURED = f"""{PANEL}, lg AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, '{f}' AS factor, ts, {f} AS x, {y} AS y FROM x3 WHERE {f} IS NOT NULL AND {y} IS NOT NULL" for f in FACTORS for k, y in (('direction', 'fwd'), ('move', 'fwd_abs')))}),
rk AS (SELECT kind, factor, ts, rank() OVER (PARTITION BY kind, factor, ts ORDER BY x) + (count(*) OVER (PARTITION BY kind, factor, ts, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY kind, factor, ts ORDER BY y) + (count(*) OVER (PARTITION BY kind, factor, ts, y) - 1) / 2.0::DOUBLE AS y FROM lg),
iv AS (SELECT * FROM (SELECT kind, factor, ts, (avg(x * y) - avg(x) * avg(y)) / nullif(stddev_pop(x) * stddev_pop(y), 0.0::DOUBLE) AS ic FROM rk GROUP BY kind, factor, ts HAVING count(*) >= 5) WHERE ic IS NOT NULL),
sp AS (SELECT kind, factor, min(ts) AS a, max(ts) AS z, count(*) AS n, avg(ic) AS av, stddev_samp(ic) AS sd FROM iv GROUP BY kind, factor),
pf AS (SELECT kind, factor, fold, count(*) FILTER (WHERE ts <= a + (z - a) * fold / 5.0::DOUBLE) AS tr, count(*) FILTER (WHERE te) AS ten, avg(ic) FILTER (WHERE te) AS m
       FROM (SELECT iv.*, f.fold, sp.a, sp.z, ts > a + (z - a) * f.fold / 5.0::DOUBLE + {3 * UNITS['d']} AND ts <= a + (z - a) * (f.fold + 1) / 5.0::DOUBLE AS te FROM iv JOIN sp USING (kind, factor), (SELECT unnest([1, 2, 3, 4]) AS fold) f) GROUP BY kind, factor, fold),
pm AS (SELECT kind, factor, avg(m) AS m, count(*) AS k, abs(sum(sign(m))) AS same FROM pf WHERE tr >= 200 AND ten >= 60 GROUP BY kind, factor),
ms AS (SELECT kind, factor, n, coalesce(k, 0) AS k, CASE WHEN n < 40 THEN 0 WHEN k >= 3 THEN m ELSE av END AS ic, CASE WHEN n >= 40 AND k >= 3 AND sd > 0 THEN m * sqrt(n) / sd ELSE 0 END AS t, coalesce(n >= 40 AND k >= 3 AND abs(m) >= 0.01 AND same = k, false) AS usable FROM sp LEFT JOIN pm USING (kind, factor))"""


def _measured(panel):
    return crosssection.measure_all(panel, FACTORS, {"direction": "fwd", "move": "fwd_abs"}, 3 * UNITS["d"])


add(
    "factor_measure_all",
    lambda spark, d: flat(_measured(_panel(spark, d)).withColumn("usable", F.col("usable").cast("double")), ["kind", "factor"], ["ic", "t", "folds", "coverage", "usable"], 4),
    rows(["kind", "factor"], {"ic": "ic", "t": "t", "folds": "CASE WHEN n < 40 THEN 0 ELSE k END", "coverage": "n", "usable": "CAST(usable AS DOUBLE)"}, f"{MEASURED}||ms").replace(", 6) + 0.0", ", 4) + 0.0"),
)


def _ranked(spark, d):
    panel = kept(_panel(spark, d))
    return crosssection.rank(panel, _measured(panel), FACTORS, 5)


add("rank_latest", lambda spark, d: flat(_ranked(spark, d), ["symbol", "ts"], ["place", "move", "direction"], 4))
add("factor_panel", lambda spark, d: flat(crosssection.with_relative(context.situation(bars_daily(spark, d)), context.AXES[:20]), ["symbol", "ts"], [a + crosssection.REL for a in context.AXES[:20]], 3))

# Sessions and overlays
_now = lambda spark, d: bars_daily(spark, d).withColumn("now", F.max("ts").over(s.Window.partitionBy("symbol")) + 21 * UNITS["h"])
_markets = lambda: F.when(F.col("symbol") < "LARGE", "kr").when(F.col("symbol") < "PROMO", "us").otherwise("crypto")
add(
    "session_ends",
    lambda spark, d: _now(spark, d).withColumn("market", _markets()).select("symbol", "ts", next_ts("ts", UNITS["d"]).alias("next"), session_end("ts", "market").alias("session_end"), bar_closed("ts", UNITS["d"], F.col("now"), "market").alias("closed")),
    f"""WITH {q.DAILY.strip()}, b AS (SELECT symbol, ts, max(ts) OVER (PARTITION BY symbol) + 75600000 AS now, CASE WHEN symbol < 'LARGE' THEN 'kr' WHEN symbol < 'PROMO' THEN 'us' ELSE 'crypto' END AS market FROM bars),
        e AS (SELECT *, CASE market WHEN 'kr' THEN epoch_ms((make_timestamp(ts * 1000) + INTERVAL 930 MINUTE) AT TIME ZONE 'Asia/Seoul') WHEN 'us' THEN epoch_ms((make_timestamp(ts * 1000) + INTERVAL 960 MINUTE) AT TIME ZONE 'America/New_York') END AS se FROM b)
        SELECT symbol, ts, CAST(ts + 86400000 AS BIGINT) AS "next", CAST(se AS BIGINT) AS session_end, ts + 86400000 <= now OR coalesce(now >= se + 1800000, false) AS closed FROM e""",
)
add(
    "overlay_bars",
    lambda spark, d: flat(candles.overlay(bars_daily(spark, d).where("volume > 40").withColumn("close", F.col("close") * 1.5), bars_daily(spark, d).where("volume < 60")), ["symbol", "ts"], ["open", "close", "volume"], 4),
    rows(["symbol", "ts"], {"open": "open", "close": "CASE WHEN volume > 40 THEN close * 1.5::DOUBLE ELSE close END", "volume": "volume"}, "bars").replace(", 6) + 0.0", ", 4) + 0.0"),
)


def _masked(spark, d):
    """Around return spikes in high volatility and an upward trend."""
    bars = kept(bars_daily(spark, d))
    return scenario.mask(bars, events.detect(bars).where("kind = 'spike'"), 2, 1)


add(
    "scenario_mask",
    lambda spark, d: _masked(spark, d),
    f"""WITH RECURSIVE {q.DAILY.strip()}, {REGIME}, {FOUND},
        ev AS (SELECT DISTINCT symbol, ts FROM found WHERE kind = 'spike'),
        ma AS (SELECT rg.symbol, rg.ts, ev.ts IS NOT NULL AS hit, coalesce(vol = 2 AND trend = 1, false) AS regime FROM rg LEFT JOIN ev ON ev.symbol = rg.symbol AND ev.ts = rg.ts),
        mb AS (SELECT symbol, ts, regime, bool_or(hit) {q.over(3)} OR NOT bool_or(hit) OVER (PARTITION BY symbol) AS event FROM ma),
        mc AS (SELECT *, count(*) FILTER (WHERE event AND regime) OVER (PARTITION BY symbol) AS nb, count(*) FILTER (WHERE event) OVER (PARTITION BY symbol) AS ne, count(*) FILTER (WHERE regime) OVER (PARTITION BY symbol) AS nr FROM mb),
        md AS (SELECT *, CASE WHEN nb >= 60 THEN 'both' WHEN ne >= 60 THEN 'event' WHEN nr >= 60 THEN 'regime' ELSE 'none' END AS applied FROM mc)
        SELECT symbol, ts, event, regime, CASE applied WHEN 'both' THEN event AND regime WHEN 'event' THEN event WHEN 'regime' THEN regime ELSE true END AS mask, applied FROM md""",
)
