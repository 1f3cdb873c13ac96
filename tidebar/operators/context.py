"""Calendar axes and regimes of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import ratio
from ..sources.bars import UNITS


def calendar(bars: DataFrame) -> DataFrame:
    """Clock and calendar positions of each bar in UTC, whatever the session's time zone, their circles, and three
    overlapping session flags."""
    t = F.date_from_unix_date(F.floor(F.col("ts") / UNITS["d"]).cast("int"))
    hour = F.floor(F.pmod("ts", F.lit(UNITS["d"])) / UNITS["m"]) / 60.0
    quarter = F.trunc(t, "quarter")
    begin, after = (F.unix_date(x).cast("long") * UNITS["d"] for x in (quarter, F.add_months(quarter, 3)))
    df = bars.withColumns(
        {
            "hour": hour,
            "weekday": F.weekday(t).cast("double"),
            "month": F.month(t).cast("double"),
            "quarter": F.quarter(t).cast("double"),
            "month_progress": (F.dayofmonth(t) - 1) / (F.dayofmonth(F.last_day(t)) - 1).cast("double"),
            "quarter_progress": (F.col("ts") - begin) / (after - begin),
            "year_progress": (F.dayofyear(t) - 1) / F.lit(365.0),
            "asia": ((hour >= 0) & (hour < 8)).cast("double"),
            "europe": ((hour >= 7) & (hour < 16)).cast("double"),
            "us": ((hour >= 13) & (hour < 21)).cast("double"),
        }
    )

    def circle(x: Column, n: float) -> tuple[Column, Column]:
        return F.sin(2 * math.pi * x / n), F.cos(2 * math.pi * x / n)

    out = {}
    for name, n in (("hour", 24.0), ("weekday", 7.0), ("month", 12.0), ("quarter", 4.0)):
        out[f"{name}_sin"], out[f"{name}_cos"] = circle(F.col(name), n)
    return df.withColumns(out)


def regime(bars: DataFrame, lookback: int = 250, least: int = 30, cuts: tuple[float, float] = (0.35, 0.75)) -> DataFrame:
    """vol_percentile of ATR / close, its class 0, 1 or 2, and trend 1, 0 or -1 by ADX and the 20-bar slope; a slope of 0 is down."""
    from .recurrence import compute_all

    df = compute_all(bars, [("atr", {}), ("adx", {})], lambda key, out: f"_{out}")
    df = df.withColumn("_ratio", ratio(F.col("_atr"), F.col("close")))
    df = df.withColumns({"vol_percentile": s.rolling_rank("_ratio", lookback, least), "_slope": F.log(ratio(F.col("close"), s.lag("close", 20)))})
    level = F.when(F.col("vol_percentile") < cuts[0], 0.0).when(F.col("vol_percentile") < cuts[1], 1.0).when(F.col("vol_percentile").isNotNull(), 2.0)
    trend = F.when(F.col("_adx").isNull() | F.col("_slope").isNull(), F.lit(None).cast("double")).when(F.col("_adx") < 20, 0.0).when(F.col("_slope") > 0, 1.0).otherwise(-1.0)
    return df.withColumns({"volatility": level, "adx": F.col("_adx"), "trend": trend}).select(*bars.columns, "vol_percentile", "volatility", "adx", "trend")


def latest_regime(bars: DataFrame, lookback: int = 250) -> DataFrame:
    """(symbol, ts, volatility, trend, vol_percentile, adx) of each symbol's last bar; unknown classes count as 1 and 0."""
    r = regime(bars, lookback).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by(F.struct("volatility", "trend", "vol_percentile", "adx"), "ts").alias("x"))
    return r.select("symbol", "ts", F.coalesce("x.volatility", F.lit(1.0)).alias("volatility"), F.coalesce("x.trend", F.lit(0.0)).alias("trend"), "x.vol_percentile", "x.adx")


#: Axes of the situation vector by group, and the weight of each group. Fixed values.
GROUPS = {
    "trend": (1.4, "px_over_ema20 px_over_ema60 ema_spread ema_slope"),
    "momentum": (1.2, "rsi stoch_k macd_hist roc_20 fisher"),
    "position": (1.2, "percent_b range_position cloud_position"),
    "volatility": (1.0, "atr_pct bandwidth squeeze"),
    "volume": (0.7, "volume_ratio cmf"),
    "regime": (1.0, "vol_percentile trend_state adx"),
    "calendar": (0.4, "hour_sin hour_cos weekday_sin weekday_cos month_progress quarter_progress month_sin month_cos"),
}
AXES = [a for _, names in GROUPS.values() for a in names.split()]
SITUATION_BARS = 30


def weights(given: dict[str, float] | None = None) -> dict[str, float]:
    """The weight of each axis: its group's, given or by default, shared evenly by the group's axes."""
    return {a: (given or {}).get(g, w) / len(names.split()) for g, (w, names) in GROUPS.items() for a in names.split()}


def situation(bars: DataFrame) -> DataFrame:
    """(symbol, ts, the 28 AXES): where each bar stands, every axis without unit and within about -1 and 1.

    Null for symbols of fewer than 30 bars. One pass for what recurs, then windows on one sort."""
    from . import indicators as ind
    from .recurrence import compute_all

    keep = {("macd", "hist"): "_hist", ("rsi", "rsi"): "_rsi", ("fisher", "fisher"): "_fi", ("atr", "atr"): "_atr", ("adx", "adx"): "_adx", ("squeeze", "squeeze_on"): "_on"}
    lengths = iter(("_e20", "_e60"))
    wanted = [("ma", {"length": 20}), ("ma", {"length": 60}), *[(k, {}) for k in ("macd", "rsi", "fisher", "atr", "adx", "squeeze")]]
    df = compute_all(bars, wanted, lambda key, out: next(lengths) if key == "ma" else keep.get((key, out), f"_x_{key}_{out}"))
    for key, outs in (("ichimoku", {"span_a": "_sa", "span_b": "_sb"}), ("bbands", {"percent_b": "_pb", "bandwidth": "_bw"}), ("stoch", {"k": "_k"}), ("cmf", {"cmf": "_cmf"})):
        base = df.columns
        df = ind.compute(df, key).select(*base, *[F.col(a).alias(b) for a, b in outs.items()])
    c = F.col
    df = df.withColumns(
        {
            "_ap": ratio(c("_atr"), c("close")),
            "_slope": F.log(ratio(c("close"), s.lag("close", 20))),
            "_h20": s.rolling_max("high", 20),
            "_l20": s.rolling_min("low", 20),
            "_v20": F.when(F.count("volume").over(s.rows(20)) >= 5, F.avg("volume").over(s.rows(20))),
            "_top": F.greatest("_sa", "_sb"),
            "_bottom": F.least("_sa", "_sb"),
            "_bars": F.count("*").over(Window.partitionBy("symbol")),
        }
    )
    df = calendar(df.withColumn("_vp", s.rolling_rank("_ap", 250, 30)))
    squash = lambda x, d: F.tanh(x / d)
    clip = lambda x, lo=-1.0, hi=1.0: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    thick = c("_top") - c("_bottom")
    over = F.when(c("close") > c("_top"), ratio(c("close") - c("_top"), thick)).when(c("close") < c("_bottom"), ratio(c("close") - c("_bottom"), thick)).otherwise(0.0)
    trend = F.when(c("_adx").isNull() | c("_slope").isNull(), F.lit(None).cast("double")).when(c("_adx") < 20, 0.0).when(c("_slope") > 0, 1.0).otherwise(-1.0)
    out = {
        "px_over_ema20": squash(ratio(c("close"), c("_e20")) - 1, 0.05),
        "px_over_ema60": squash(ratio(c("close"), c("_e60")) - 1, 0.10),
        "ema_spread": squash(ratio(c("_e20"), c("_e60")) - 1, 0.05),
        "ema_slope": squash(F.log(ratio(c("_e20"), s.lag("_e20", 10))), 0.05),
        "rsi": c("_rsi") / 50 - 1,
        "stoch_k": c("_k") / 50 - 1,
        "macd_hist": squash(ratio(c("_hist"), c("close")), 0.005),
        "roc_20": squash(c("_slope"), 0.10),
        "fisher": F.tanh(c("_fi") / 2),
        "percent_b": clip(clip(c("_pb"), -0.5, 1.5) * 2 - 1),
        "range_position": clip(ratio(c("close") - c("_l20"), c("_h20") - c("_l20")) * 2 - 1),
        "cloud_position": F.tanh(over),
        "atr_pct": squash(c("_ap"), 0.02),
        "bandwidth": squash(c("_bw"), 0.08),
        "squeeze": c("_on") * 2 - 1,
        "volume_ratio": F.when((c("volume") == 0) & (c("_v20") > 0), -1.0).otherwise(squash(F.log(ratio(c("volume"), F.nullif(c("_v20"), F.lit(0.0)))), 0.7)),
        "cmf": clip(c("_cmf")),
        "vol_percentile": c("_vp") * 2 - 1,
        "trend_state": trend,
        "adx": squash(c("_adx") / 25 - 1, 1.0),
        "month_progress": c("month_progress") * 2 - 1,
        "quarter_progress": c("quarter_progress") * 2 - 1,
    }
    out = {a: out.get(a, c(a)) for a in AXES}
    return df.select("symbol", "ts", *[F.when(c("_bars") >= SITUATION_BARS, x).alias(a) for a, x in out.items()])


def describe(bars: DataFrame) -> DataFrame:
    """(symbol, ts, volatility, trend, vol_percentile, adx, axes, sessions) of each symbol's last bar: its regime, its axes
    to three places by name, and the sessions open then."""
    last = situation(bars).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by(F.create_map(*[y for a in AXES for y in (F.lit(a), F.round(a, 3))]), "ts").alias("axes"))
    open_ = calendar(last)
    names = F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in ("asia", "europe", "us")]), lambda x: x.isNotNull())
    return latest_regime(bars).join(open_.select("symbol", "axes", names.alias("sessions")), "symbol")
