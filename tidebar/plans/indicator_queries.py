"""Queries of candles, rolling kernels and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import candles, indicators, levels, recurrence  # noqa: F401  levels and recurrence register their indicators
from ..sources.bars import bars_daily, bars_hourly
from . import oracle as q

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select("symbol", "ts", *[(F.round(F.col(c) + 1.23456789e-6, digits) + F.lit(0.0)).alias(c) for c in columns])


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE[name] = sql


def by_key(name: str, key: str, sql: str | None = None, **given) -> None:
    outputs = indicators.REGISTRY[key].outputs
    add(name, lambda spark, d: rounded(indicators.compute(bars_daily(spark, d), key, **given), *outputs), sql)


OHLCV = {c: c for c in ("open", "high", "low", "close", "volume")}
add("bars_daily", lambda spark, d: rounded(bars_daily(spark, d), *OHLCV), q.query(OHLCV))
add("bars_hourly", lambda spark, d: rounded(bars_hourly(spark, d), *OHLCV), q.query(OHLCV, base="hours", with_=q.HOURLY))
add(
    "resample_week",
    lambda spark, d: rounded(candles.resample(bars_daily(spark, d), 604_800_000), *OHLCV),
    q.query(OHLCV, "SELECT symbol, CAST(ts - ts % 604800000 AS BIGINT) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, b.ts - b.ts % 604800000"),
)


def kernel(name: str, column, sql: str, numbered: bool = False, digits: int = 4) -> None:
    def run(spark, d):
        df = bars_daily(spark, d)
        return rounded((s.numbered(df) if numbered else df).withColumn(name, column()), name, digits=digits)

    add(f"kernel_{name}", run, q.query({name: (sql, digits)}))


kernel("sma", lambda: s.sma("close", 20), q.full("avg", "close", 20))
kernel("stdev_pop", lambda: s.stdev("close", 20), q.full("stddev_pop", "close", 20))
kernel("rolling_max", lambda: s.rolling_max("high", 20), q.full("max", "high", 20))
kernel("rolling_min", lambda: s.rolling_min("low", 20), q.full("min", "low", 20))
kernel("wma", lambda: s.wma("close", 10), q.wma("close", 10), numbered=True)
kernel("true_range", lambda: s.true_range(), f"greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')}))")
kernel("relative_z", lambda: s.relative_z("close"), f"CASE WHEN count(close) {q.over(120)} >= 60 THEN (close - avg(close) {q.over(120)}) / nullif(stddev_pop(close) {q.over(120)}, 0.0::DOUBLE) END")
add(
    "kernel_linreg_end",
    lambda spark, d: rounded(s.numbered(bars_daily(spark, d)).withColumn("fit", s.linreg_end("close", 20)), "fit"),
    q.query({"fit": f"CASE WHEN count(close) {q.over(20)} = 20 THEN regr_intercept(close, i) {q.over(20)} + regr_slope(close, i) {q.over(20)} * i END"}, q.NUMBERED),
)
add(
    "kernel_rolling_rank",
    lambda spark, d: rounded(bars_daily(spark, d).withColumn("rank", s.rolling_rank("volume", 100, 60)), "rank"),
    q.query({"rank": f"CASE WHEN len(w) >= 60 THEN CAST(len(list_filter(w[1:len(w)-1], lambda v: v < volume)) AS DOUBLE) / (len(w) - 1) END"}, f"SELECT *, list(volume) {q.over(100)} AS w FROM b"),
)
add(
    "kernel_crossover",
    lambda spark, d: rounded(bars_daily(spark, d).withColumns({"_f": s.sma("close", 5), "_s": s.sma("close", 20)}).withColumns({"up": s.crossed_up("_f", "_s").cast("double"), "down": s.crossed_up("_s", "_f").cast("double")}), "up", "down"),
    q.query(
        {"up": f"CAST(coalesce(f > s AND {q.lag('f')} <= {q.lag('s')}, false) AS DOUBLE)", "down": f"CAST(coalesce(f < s AND {q.lag('f')} >= {q.lag('s')}, false) AS DOUBLE)"},
        f"SELECT *, {q.full('avg', 'close', 5)} AS f, {q.full('avg', 'close', 20)} AS s FROM b",
    ),
)
add(
    "ma_hma",
    lambda spark, d: rounded(indicators.add_hma(bars_daily(spark, d), "close", 16, "value"), "value"),
    q.query({"value": q.wma("w", 4)}, f"SELECT *, 2 * {q.wma('close', 8)} - {q.wma('close', 16)} AS w FROM b"),
)

mid = lambda n: f"({q.full('max', 'high', n)} + {q.full('min', 'low', n)}) / 2"
by_key(
    "ichimoku",
    "ichimoku",
    q.query(
        {"tenkan": "t", "kijun": "k", "span_a": q.lag("a", 26), "span_b": q.lag("c", 26), "chikou": q.lead("close", 26), "span_a_lead": "a", "span_b_lead": "c"},
        f"SELECT *, {mid(9)} AS t, {mid(26)} AS k, {mid(52)} AS c FROM b",
        "SELECT *, (t + k) / 2 AS a FROM b",
    ),
)
by_key("stoch", "stoch", q.query({"k": "k", "d": q.full("avg", "k", 3)}, f"SELECT *, 100 * {q.ratio('close - ' + '(' + q.full('min', 'low', 14) + ')', '(' + q.full('max', 'high', 14) + ') - (' + q.full('min', 'low', 14) + ')')} AS r FROM b", f"SELECT *, {q.full('avg', 'r', 3)} AS k FROM b"))
by_key("cci", "cci", q.query({"cci": q.ratio("tp - m", "0.015::DOUBLE * list_avg(list_transform(w, lambda v: abs(v - m)))")}, f"SELECT *, {q.TP} AS tp FROM b", f"SELECT *, {q.full('avg', 'tp', 20)} AS m, list(tp) {q.over(20)} AS w FROM b"))
by_key("willr", "willr", q.query({"willr": f"-100 * {q.ratio('(' + q.full('max', 'high', 14) + ') - close', '(' + q.full('max', 'high', 14) + ') - (' + q.full('min', 'low', 14) + ')')}"}))
by_key("roc", "roc", q.query({"roc": f"100 * {q.ratio('close - ' + q.lag('close', 12), q.lag('close', 12))}"}))
by_key(
    "mfi",
    "mfi",
    q.query(
        {"mfi": "CASE WHEN dn = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + up / nullif(dn, 0.0::DOUBLE)) END"},
        f"SELECT *, {q.TP} AS tp FROM b",
        f"SELECT *, tp - {q.lag('tp')} AS d FROM b",
        "SELECT *, CASE WHEN d > 0 THEN tp * volume ELSE 0.0::DOUBLE END AS u, CASE WHEN d < 0 THEN tp * volume ELSE 0.0::DOUBLE END AS n FROM b",
        f"SELECT *, {q.full('sum', 'u', 14)} AS up, {q.full('sum', 'n', 14)} AS dn FROM b",
    ),
)
by_key("ao", "ao", q.query({"ao": f"({q.full('avg', 'm', 5)}) - ({q.full('avg', 'm', 34)})"}, "SELECT *, (high + low) / 2 AS m FROM b"))
by_key(
    "bbands",
    "bbands",
    q.query({"upper": "m + 2 * d", "middle": "m", "lower": "m - 2 * d", "percent_b": q.ratio("close - (m - 2 * d)", "4 * d"), "bandwidth": q.ratio("4 * d", "m")}, f"SELECT *, {q.full('avg', 'close', 20)} AS m, {q.full('stddev_pop', 'close', 20)} AS d FROM b"),
)
by_key("donchian", "donchian", q.query({"upper": q.full("max", "high", 20), "middle": mid(20), "lower": q.full("min", "low", 20)}))
by_key("stdev", "stdev", q.query({"stdev": q.full("stddev_pop", "close", 20)}))
RUN = f"OVER ({q.P} ROWS UNBOUNDED PRECEDING)"
by_key("obv", "obv", q.query({"obv": f"sum(x) {RUN}"}, f"SELECT *, coalesce(sign(close - {q.lag('close')}) * volume, 0.0::DOUBLE) AS x FROM b"))
for anchor, step in (("day", 86_400_000), ("week", 604_800_000), ("all", 0)):
    part = f"symbol, ts // {step}" if step else "symbol"
    w = f"OVER (PARTITION BY {part} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    by_key(f"vwap_{anchor}", "vwap", q.query({"vwap": f"sum({q.TP} * volume) {w} / sum(volume) {w}"}), anchor=anchor)
by_key("ad", "ad", q.query({"ad": f"sum({q.CLV} * volume) {RUN}"}))
by_key("cmf", "cmf", q.query({"cmf": f"({q.full('sum', 'x', 20)}) / ({q.full('sum', 'volume', 20)})"}, f"SELECT *, {q.CLV} * volume AS x FROM b"))
AROUND = f"OVER ({q.P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
by_key(
    "swings",
    "swings",
    q.query(
        {"swing_high": "CASE WHEN len(hs) = 11 AND high = list_max(hs) AND len(list_filter(hs, lambda v: v = high)) = 1 THEN high END", "swing_low": "CASE WHEN len(ls) = 11 AND low = list_min(ls) AND len(list_filter(ls, lambda v: v = low)) = 1 THEN low END"},
        f"SELECT *, list(high) {AROUND} AS hs, list(low) {AROUND} AS ls FROM b",
    ),
)
_LEVELS = {
    "classic": ("(h + l + c) / 3", ["2 * p - l", "p + (h - l)", "h + 2 * (p - l)", "2 * p - h", "p - (h - l)", "l - 2 * (h - p)"]),
    "woodie": ("(h + l + 2 * c) / 4", ["2 * p - l", "p + (h - l)", "h + 2 * (p - l)", "2 * p - h", "p - (h - l)", "l - 2 * (h - p)"]),
    "fibonacci": ("(h + l + c) / 3", [f"p {sign} {k}::DOUBLE * (h - l)" for sign in "+-" for k in (0.382, 0.618, 1.0)]),
    "camarilla": ("(h + l + c) / 3", [f"c {sign} (h - l) * 1.1::DOUBLE / {k}" for sign in "+-" for k in (12, 6, 4)]),
}
for kind, (p, lines) in _LEVELS.items():
    by_key(
        f"pivots_{kind}",
        "pivots",
        q.query(
            {"p": "p"} | dict(zip(("r1", "r2", "r3", "s1", "s2", "s3"), lines)),
            "SELECT *, b.ts // 604800000 AS w FROM b",
            "SELECT x.symbol, x.ts, y.h, y.l, y.c FROM b JOIN s0 x ON x.symbol = b.symbol AND x.ts = b.ts LEFT JOIN (SELECT symbol, w, lag(h) OVER (PARTITION BY symbol ORDER BY w) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY w) AS l, lag(c) OVER (PARTITION BY symbol ORDER BY w) AS c FROM (SELECT symbol, w, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM s0 GROUP BY symbol, w)) y ON y.symbol = x.symbol AND y.w = x.w",
            f"SELECT *, {p} AS p FROM b",
        ),
        kind=kind,
    )
by_key(
    "linreg_channel",
    "linreg_channel",
    q.query(
        {"channel_upper": "m + 2 * d", "channel_middle": "m", "channel_lower": "m - 2 * d"},
        f"SELECT *, row_number() OVER ({q.P}) AS i, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b",
        "SELECT *, CASE WHEN k <= 100 THEN regr_intercept(close, i) FILTER (WHERE k <= 100) OVER (PARTITION BY symbol) + regr_slope(close, i) FILTER (WHERE k <= 100) OVER (PARTITION BY symbol) * i END AS m FROM b",
        "SELECT *, CASE WHEN k <= 100 THEN stddev_pop(close - m) OVER (PARTITION BY symbol) END AS d FROM b",
    ),
)

# Recurrences: the oracle runs them as recursive SQL.
E = q.seeded
by_key("ma_ema", "ma", q.recurrence([E("close", 20, q.ema_a(20), "e", "bars")], {"value": "e.y"}, q.left("e")))
by_key("ma_rma", "ma", q.recurrence([E("close", 14, q.rma_a(14), "e", "bars")], {"value": "e.y"}, q.left("e")), kind="rma", length=14)
EE = [E("close", 20, q.ema_a(20), "e1", "bars"), E("y", 20, q.ema_a(20), "e2", "e1"), E("y", 20, q.ema_a(20), "e3", "e2")]
by_key("dema", "dema", q.recurrence(EE[:2], {"value": "2 * e1.y - e2.y"}, q.left("e1", "e2")))
by_key("tema", "tema", q.recurrence(EE, {"value": "3 * e1.y - 3 * e2.y + e3.y"}, q.left("e1", "e2", "e3")))
MACD = [E("close", 12, q.ema_a(12), "f", "bars"), E("close", 26, q.ema_a(26), "g", "bars"), "m AS (SELECT f.symbol, f.ts, f.y - g.y AS x FROM f JOIN g ON g.symbol = f.symbol AND g.ts = f.ts)", E("x", 9, q.ema_a(9), "nn_", "m")]
by_key("macd", "macd", q.recurrence(MACD, {"macd": "m.x", "signal": "nn_.y", "hist": "m.x - nn_.y"}, q.left("m", "nn_")))
by_key("atr", "atr", q.recurrence([q.TR, E("x", 14, q.rma_a(14), "a", "tr")], {"atr": "a.y"}, q.left("a")))
by_key("keltner", "keltner", q.recurrence([q.TR, E("x", 10, q.rma_a(10), "a", "tr"), E("close", 20, q.ema_a(20), "e", "bars")], {"upper": "e.y + 2 * a.y", "middle": "e.y", "lower": "e.y - 2 * a.y"}, q.left("a", "e")))
STEP = f"d AS (SELECT symbol, ts, close - {q.lag('close')} AS d FROM bars), gl AS (SELECT *, greatest(d, 0.0::DOUBLE) AS g, greatest(-d, 0.0::DOUBLE) AS l FROM d WHERE d IS NOT NULL)"
RSI = [STEP, E("g", 14, q.rma_a(14), "u", "gl"), E("l", 14, q.rma_a(14), "w", "gl"), "rs AS (SELECT u.symbol, u.ts, CASE WHEN w.y = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + u.y / nullif(w.y, 0.0::DOUBLE)) END AS x FROM u JOIN w ON w.symbol = u.symbol AND w.ts = u.ts)"]
by_key("rsi", "rsi", q.recurrence(RSI, {"rsi": "rs.x"}, q.left("rs")))
SRSI = f"st AS (SELECT symbol, ts, 100 * {q.ratio('x - (' + q.full('min', 'x', 14) + ')', '(' + q.full('max', 'x', 14) + ') - (' + q.full('min', 'x', 14) + ')')} AS r FROM (SELECT b.symbol, b.ts, rs.x FROM bars b {q.left('rs')})), sk AS (SELECT symbol, ts, {q.full('avg', 'r', 3)} AS k FROM st), sd AS (SELECT symbol, ts, k, {q.full('avg', 'k', 3)} AS d FROM sk)"
by_key("stochrsi", "stochrsi", q.recurrence([*RSI, SRSI], {"k": "sd.k", "d": "sd.d"}, q.left("sd")))
by_key(
    "tsi",
    "tsi",
    q.recurrence(
        [
            f"d AS (SELECT symbol, ts, close - {q.lag('close')} AS d, abs(close - {q.lag('close')}) AS a FROM bars)",
            E("d", 25, q.ema_a(25), "t1", "d"), E("y", 13, q.ema_a(13), "t2", "t1"), E("a", 25, q.ema_a(25), "t3", "d"), E("y", 13, q.ema_a(13), "t4", "t3"),
            "tt AS (SELECT t2.symbol, t2.ts, 100 * t2.y / nullif(t4.y, 0.0::DOUBLE) AS x FROM t2 JOIN t4 ON t4.symbol = t2.symbol AND t4.ts = t2.ts)",
            E("x", 13, q.ema_a(13), "t5", "tt"),
        ],
        {"tsi": "tt.x", "signal": "t5.y"},
        q.left("tt", "t5"),
    ),
)
DI = [
    E("x", 14, q.rma_a(14), "a", "tr"), E("p", 14, q.rma_a(14), "pp", "dp"), E("n", 14, q.rma_a(14), "nn", "dp"),
    "di AS (SELECT a.symbol, a.ts, 100 * pp.y / nullif(a.y, 0.0::DOUBLE) AS p, 100 * nn.y / nullif(a.y, 0.0::DOUBLE) AS n FROM a JOIN pp ON pp.symbol = a.symbol AND pp.ts = a.ts JOIN nn ON nn.symbol = a.symbol AND nn.ts = a.ts), dx AS (SELECT symbol, ts, 100 * abs(p - n) / nullif(p + n, 0.0::DOUBLE) AS x FROM di)",
]
DM = f"dm AS (SELECT symbol, ts, coalesce(high - {q.lag('high')}, 0.0::DOUBLE) AS u, coalesce({q.lag('low')} - low, 0.0::DOUBLE) AS v FROM bars), dp AS (SELECT symbol, ts, CASE WHEN u > v AND u > 0 THEN u ELSE 0.0::DOUBLE END AS p, CASE WHEN v > u AND v > 0 THEN v ELSE 0.0::DOUBLE END AS n FROM dm)"
by_key(
    "adx",
    "adx",
    q.recurrence(
        [q.TR, DM, *DI, E("x", 14, q.rma_a(14), "ax", "dx")],
        {"adx": "ax.y", "plus_di": "di.p", "minus_di": "di.n"},
        q.left("ax", "di"),
    ),
)
SQ = f"sq AS (SELECT symbol, ts, row_number() OVER ({q.P}) AS i, close, {q.full('avg', 'close', 20)} AS m, {q.full('stddev_pop', 'close', 20)} AS s, ({mid(20)}) AS dm FROM bars), sm AS (SELECT *, close - (dm + m) / 2 AS x FROM sq), sl AS (SELECT *, CASE WHEN count(x) {q.over(20)} = 20 THEN regr_intercept(x, i) {q.over(20)} + regr_slope(x, i) {q.over(20)} * i END AS fit FROM sm)"
by_key(
    "squeeze",
    "squeeze",
    q.recurrence([q.TR, SQ, E("x", 20, q.rma_a(20), "a", "tr"), E("close", 20, q.ema_a(20), "e", "bars")], {"momentum": "sl.fit", "squeeze_on": "CASE WHEN sl.s IS NOT NULL AND a.y IS NOT NULL THEN CAST((sl.m + 2 * sl.s < e.y + 1.5 * a.y AND sl.m - 2 * sl.s > e.y - 1.5 * a.y) AS DOUBLE) END"}, q.left("sl", "a", "e")),
)
LEG = f"""sw AS (SELECT *, list(high) {AROUND} AS hs, list(low) {AROUND} AS ls FROM bars),
sh AS (SELECT symbol, max(ts) AS ts, arg_max(high, ts) AS price FROM sw WHERE len(hs) = 11 AND high = list_max(hs) AND len(list_filter(hs, lambda v: v = high)) = 1 GROUP BY symbol),
sl AS (SELECT symbol, max(ts) AS ts, arg_max(low, ts) AS price FROM sw WHERE len(ls) = 11 AND low = list_min(ls) AND len(list_filter(ls, lambda v: v = low)) = 1 GROUP BY symbol),
leg AS (SELECT symbol, least(sh.ts, sl.ts) AS t, CASE WHEN sh.ts > sl.ts THEN sl.price ELSE sh.price END AS a, CASE WHEN sh.ts > sl.ts THEN sh.price ELSE sl.price END AS z FROM sh JOIN sl USING (symbol))"""
by_key(
    "fibonacci",
    "fibonacci",
    q.query(
        {"start": "a", "end": "z"} | {levels._name("r", r): f"z - {r}::DOUBLE * (z - a)" for r in levels.RETRACEMENTS} | {levels._name("e", r): f"a + {r}::DOUBLE * (z - a)" for r in levels.EXTENSIONS},
        "SELECT b.symbol, b.ts, leg.a, leg.z FROM b LEFT JOIN leg ON leg.symbol = b.symbol AND b.ts >= leg.t AND leg.a <> leg.z",
        with_=f"{q.DAILY.strip()}, {LEG}",
    ).replace('AS end', 'AS "end"').replace('AS start', 'AS "start"'),
)
for _kind in ("sma", "wma"):
    by_key(f"ma_{_kind}", "ma", q.query({"value": q.full("avg", "high", 12) if _kind == "sma" else q.wma("high", 12)}), kind=_kind, length=12, source="high")
for _key in ("volume_profile", "support_resistance"):
    by_key(_key, _key)
_low, _high = "dn >= 2 * body AND up <= body AND NOT small", "up >= 2 * body AND dn <= body AND NOT small"
#: The bullish and the bearish patterns, each in the order of their names in PATTERNS.
BULL = {
    "marubozu_bull": "close > open AND body >= 0.95::DOUBLE * span", "hammer": f"{_low} AND c1 < c5", "inverted_hammer": f"{_high} AND c1 < c5",
    "bullish_engulfing": "close > open AND c1 < o1 AND close >= o1 AND open <= c1 AND body > b1", "piercing": "close > open AND c1 < o1 AND open < c1 AND close > (o1 + c1) / 2 AND close < o1",
    "morning_star": "c2 < o2 AND b1 <= 0.5::DOUBLE * b2 AND close > open AND close > (o2 + c2) / 2", "three_white_soldiers": "close > open AND c1 > o1 AND c2 > o2 AND close > c1 AND c1 > c2 AND big AND g1 AND g2",
}
BEAR = {
    "marubozu_bear": "close < open AND body >= 0.95::DOUBLE * span", "hanging_man": f"{_low} AND c1 > c5", "shooting_star": f"{_high} AND c1 > c5",
    "bearish_engulfing": "close < open AND c1 > o1 AND close <= o1 AND open >= c1 AND body > b1", "dark_cloud": "close < open AND c1 > o1 AND open > c1 AND close < (o1 + c1) / 2 AND close > o1",
    "evening_star": "c2 > o2 AND b1 <= 0.5::DOUBLE * b2 AND close < open AND close < (o2 + c2) / 2", "three_black_crows": "close < open AND c1 < o1 AND c2 < o2 AND close < c1 AND c1 < c2 AND big AND g1 AND g2",
}
#: Steps that name what the patterns compare.
BODIES = (
    "SELECT *, abs(close - open) AS body, nullif(high - low, 0.0::DOUBLE) AS span, high - greatest(open, close) AS up, least(open, close) - low AS dn FROM b",
    "SELECT *, coalesce(body <= 0.1::DOUBLE * span, false) AS small, coalesce(body > 0.5::DOUBLE * span, false) AS big FROM b",
    f"SELECT *, {', '.join(f'{q.lag(x, n)} AS {x[0]}{n}' for x in ('open', 'close', 'body') for n in (1, 2))}, {q.lag('big')} AS g1, {q.lag('big', 2)} AS g2, {q.lag('close', 5)} AS c5 FROM b",
)
_hit = lambda found: "nullif(" + " + ".join(f"CAST(coalesce({x}, false) AS INT)" for x in found.values()) + ", 0)"
by_key("candle_patterns", "candle_patterns", q.query({"bullish": _hit(BULL), "bearish": _hit(BEAR)}, *BODIES))
FISHER = f"""f0 AS (SELECT symbol, ts, (high + low) / 2 AS v FROM bars), f1 AS (SELECT symbol, ts, {q.ratio('v - (' + q.full('min', 'v', 9) + ')', '(' + q.full('max', 'v', 9) + ') - (' + q.full('min', 'v', 9) + ')')} AS raw FROM f0),
f2 AS (SELECT symbol, ts, raw, row_number() OVER ({q.P}) AS k FROM f1 WHERE raw IS NOT NULL),
f3(symbol, k, y, f) AS (
  SELECT symbol, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM f2 WHERE k = 1
  UNION ALL
  SELECT symbol, k, y, 0.5::DOUBLE * ln((1 + y) / (1 - y)) + 0.5::DOUBLE * f FROM (SELECT v.symbol, v.k, r.f, least(0.999::DOUBLE, greatest(-0.999::DOUBLE, 0.33::DOUBLE * 2 * (v.raw - 0.5::DOUBLE) + 0.67::DOUBLE * r.y)) AS y FROM f3 r JOIN f2 v ON v.symbol = r.symbol AND v.k = r.k + 1)),
fi AS (SELECT b.symbol, b.ts, f3.f, lag(f3.f) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS g FROM bars b LEFT JOIN f2 ON f2.symbol = b.symbol AND f2.ts = b.ts LEFT JOIN f3 ON f3.symbol = f2.symbol AND f3.k = f2.k)"""
by_key("fisher", "fisher", q.recurrence([FISHER], {"fisher": "fi.f", "trigger": "fi.g"}, q.left("fi")))
# State: both bands, the side, and the close that the next bar looks back on.
TREND = f"""{q.TR}, {E('x', 10, q.rma_a(10), 'a', 'tr')},
st0 AS (SELECT b.symbol, b.ts, b.close AS c, (high + low) / 2 + 3 * a.y AS up, (high + low) / 2 - 3 * a.y AS dn, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS k FROM bars b JOIN a ON a.symbol = b.symbol AND a.ts = b.ts WHERE a.y IS NOT NULL),
st1(symbol, k, u, d, way, c) AS (
  SELECT symbol, 1::BIGINT, up, dn, 1.0::DOUBLE, c FROM st0 WHERE k = 1
  UNION ALL
  SELECT v.symbol, v.k, CASE WHEN v.up < r.u OR r.c > r.u THEN v.up ELSE r.u END, CASE WHEN v.dn > r.d OR r.c < r.d THEN v.dn ELSE r.d END, CASE WHEN v.c > r.u THEN 1.0::DOUBLE WHEN v.c < r.d THEN -1.0::DOUBLE ELSE r.way END, v.c
  FROM st1 r JOIN st0 v ON v.symbol = r.symbol AND v.k = r.k + 1),
sv AS (SELECT st0.symbol, st0.ts, CASE WHEN way = 1 THEN d ELSE u END AS v, way FROM st0 JOIN st1 ON st1.symbol = st0.symbol AND st1.k = st0.k)"""
by_key("supertrend", "supertrend", q.recurrence([TREND], {"value": "sv.v", "direction": "sv.way"}, q.left("sv")))
PSAR = f"""p0 AS (SELECT symbol, ts, high, low, {q.lag('high')} AS h1, {q.lag('low')} AS l1, {q.lag('high', 2)} AS h2, {q.lag('low', 2)} AS l2, row_number() OVER ({q.P}) AS k FROM bars),
p1(symbol, k, up, sar, far, af) AS (
  SELECT symbol, 1::BIGINT, high >= h1, CASE WHEN high >= h1 THEN l1 ELSE h1 END, CASE WHEN high >= h1 THEN high ELSE low END, 0.02::DOUBLE FROM p0 WHERE k = 2
  UNION ALL
  SELECT symbol, k, CASE WHEN broken THEN NOT up ELSE up END, CASE WHEN broken THEN far ELSE s END,
         CASE WHEN broken THEN CASE WHEN up THEN low ELSE high END WHEN up AND high > far THEN high WHEN NOT up AND low < far THEN low ELSE far END,
         CASE WHEN broken THEN 0.02::DOUBLE WHEN (up AND high > far) OR (NOT up AND low < far) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END
  FROM (SELECT *, CASE WHEN up THEN low < s ELSE high > s END AS broken
        FROM (SELECT v.symbol, v.k, v.high, v.low, r.up, r.far, r.af, CASE WHEN r.up THEN least(r.sar + r.af * (r.far - r.sar), v.l1, v.l2) ELSE greatest(r.sar + r.af * (r.far - r.sar), v.h1, v.h2) END AS s
              FROM p1 r JOIN p0 v ON v.symbol = r.symbol AND v.k = r.k + 1))),
pv AS (SELECT p0.symbol, p0.ts, p1.sar AS v FROM p0 JOIN p1 ON p1.symbol = p0.symbol AND p1.k = p0.k WHERE p0.k > 1)"""
by_key("psar", "psar", q.recurrence([PSAR], {"value": "pv.v"}, q.left("pv")))
