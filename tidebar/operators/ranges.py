"""Volatility from the range of bars, micro-structure features and forward labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import past, ratio
from .indicators import clv


def _log(a: str, b):
    return F.log(ratio(F.col(a), F.col(b) if isinstance(b, str) else b))


def range_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """parkinson, garman_klass, rogers_satchell and yang_zhang over n bars; estimates below 0 count as 0."""
    df = bars.withColumns({"_hl": _log("high", "low"), "_co": _log("close", "open"), "_ho": _log("high", "open"), "_hc": _log("high", "close"), "_lo": _log("low", "open"), "_lc": _log("low", "close"), "_on": _log("open", s.lag("close"))})
    c = F.col
    df = df.withColumns(
        {
            "_p": c("_hl") * c("_hl") / (4 * math.log(2)),
            "_g": 0.5 * c("_hl") * c("_hl") - (2 * math.log(2) - 1) * c("_co") * c("_co"),
            "_r": c("_hc") * c("_ho") + c("_lc") * c("_lo"),
        }
    )
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = lambda x: s.full(F.var_samp(c(x)), x, n)
    yz = var("_on") + k * var("_co") + (1 - k) * s.sma("_r", n)
    out = {"parkinson": s.sma("_p", n), "garman_klass": s.sma("_g", n), "rogers_satchell": s.sma("_r", n), "yang_zhang": yz}
    return df.withColumns({name: F.when(x.isNotNull(), root(x)) for name, x in out.items()}).select(*bars.columns, *out)


RANGE = ("parkinson_ratio", "gk_ratio", "rs_ratio", "yz_ratio", "overnight_share", "har_short", "har_long", "range_pressure")
_EPS = 1e-12


def range_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """The RANGE columns: range volatilities over that of closes, the share of overnight moves, the log ratios of a day's
    variance to a week's and a week's to a month's (within 6), and the log of today's range over its mean.

    Null until their windows are full (of 5 and 22 bars, half will do) and where a divisor does not vary."""
    c = F.col
    df = range_volatility(bars, n).withColumns({"_ret": _log("close", s.lag("close")), "_on": _log("open", s.lag("close")), "_hl": _log("high", "low")})
    df = df.withColumn("_rv", F.greatest(_log("high", "close") * _log("high", "open") + _log("low", "close") * _log("low", "open"), F.lit(0.0)))
    some = lambda k, least: F.when(F.count("_rv").over(s.rows(k)) >= least, F.avg("_rv").over(s.rows(k)))
    above = lambda x: F.when(x > _EPS, x)
    df = df.withColumns({"_base": above(s.full(F.stddev_samp("_ret"), "_ret", n)), "_vo": s.full(F.var_samp("_on"), "_on", n), "_week": some(5, 3), "_month": some(22, 11), "_mean": above(s.sma("_hl", n))})
    clip = lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    logs = lambda a, b: F.log(clip(ratio(a, F.when(b > 0, b)), math.exp(-6), math.exp(6)))
    now = ratio(c("_hl"), c("_mean"))
    out = dict(zip(RANGE, (ratio(c(x), c("_base")) for x in ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang"))))
    out |= {
        "overnight_share": clip(ratio(c("_vo"), above(c("yang_zhang") * c("yang_zhang"))), 0.0, 1.0),
        "har_short": logs(c("_rv"), c("_week")),
        "har_long": logs(c("_week"), c("_month")),
        "range_pressure": F.log(F.when(now > 0, now)),
    }
    return df.withColumns(out).select(*bars.columns, *RANGE)


def micro(bars: DataFrame) -> DataFrame:
    """clv, signed_volume (against the mean of 20 bars, 5 at least), pressure (its mean over 10 bars, 3 at least) and wick_bias."""
    df = bars.withColumns({"clv": clv(), "_v20": F.when(F.count("volume").over(s.rows(20)) >= 5, F.avg("volume").over(s.rows(20)))})
    df = df.withColumn("signed_volume", F.tanh(F.col("clv") * ratio(F.col("volume"), F.col("_v20"))))
    recent = F.when(F.count("signed_volume").over(s.rows(10)) >= 3, F.avg("signed_volume").over(s.rows(10)))
    wicks = ratio((F.least("open", "close") - F.col("low")) - (F.col("high") - F.greatest("open", "close")), F.col("high") - F.col("low"))
    return df.withColumns({"pressure": F.tanh(3 * recent), "wick_bias": F.coalesce(wicks, F.lit(0.0))}).drop("_v20")


def forward_return(bars: DataFrame, h: int) -> DataFrame:
    """fwd: log return over the next h bars; a label, null for the last h."""
    return bars.withColumn("fwd", F.log(ratio(s.lead("close", h), F.col("close"))))


def triple_barrier(bars: DataFrame, scale: str, h: int = 10, take: float = 2.0, stop: float = 1.0) -> DataFrame:
    """label 1, -1 or 0, hit_bars and ret: which of close + take * scale and close - stop * scale is met first within h
    bars. A bar that meets both counts as stopped; without either, h bars pass. ret is that of the close of the bar that
    was hit. Null for the last h bars and without a positive scale."""
    ahead = past().rowsBetween(1, h)
    up, down = F.col("close") + take * F.col(scale), F.col("close") - stop * F.col(scale)
    df = bars.withColumns({"_h": F.collect_list("high").over(ahead), "_c": F.collect_list("close").over(ahead), "_l": F.collect_list("low").over(ahead), "_end": s.lead("close", h), "_up": up, "_dn": down})

    def first(values, hit):
        return F.array_min(F.filter(F.transform(values, lambda v, i: F.when(hit(v), i + 1)), lambda i: i.isNotNull()))

    df = df.withColumns({"_tu": F.coalesce(first("_h", lambda v: v >= F.col("_up")), F.lit(h + 1)), "_td": F.coalesce(first("_l", lambda v: v <= F.col("_dn")), F.lit(h + 1))})
    known = F.col("_end").isNotNull() & (F.col(scale) > 0)
    stopped, taken = (F.col("_td") <= F.col("_tu")) & (F.col("_td") <= h), (F.col("_tu") < F.col("_td")) & (F.col("_tu") <= h)
    label = F.when(stopped, -1.0).when(taken, 1.0).otherwise(0.0)
    bars_ = F.when(stopped, F.col("_td")).when(taken, F.col("_tu")).otherwise(F.lit(h))
    return df.withColumns({"label": F.when(known, label), "hit_bars": F.when(known, bars_).cast("double"), "ret": F.when(known, ratio(F.get("_c", bars_ - 1), F.col("close")) - 1)}).select(*bars.columns, "label", "hit_bars", "ret")


EVENT = ("event_recency", "event_severity", "event_chart", "event_macro", "event_scheduled")


def event_features(bars: DataFrame, events: DataFrame) -> DataFrame:
    """The EVENT columns from events (symbol, ts, severity, chart, scheduled), each at the first bar at or after it.

    Recency falls from 1 towards -1 by 20 bars since the last event, and is -1 before the first; the others are the
    largest severity at a bar (of all events, chart events, others; 1 for scheduled ones) as an exponential mean over 20."""
    from .events import asof
    from .recurrence import streamed

    at = asof(events.select("symbol", "ts", "severity", "chart", "scheduled"), bars.withColumn("_bar", F.col("ts")), "_bar", forward=True, out="bar").where("bar IS NOT NULL")
    top = lambda x: F.coalesce(F.max(x), F.lit(0.0))
    at = at.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.max("severity").alias("_a"), top(F.when(F.col("chart"), F.col("severity"))).alias("_b"), top(F.when(~F.col("chart"), F.col("severity"))).alias("_c"), top(F.when(F.col("scheduled"), 1.0)).alias("_d")
    )
    df = bars.join(at, ["symbol", "ts"], "left").withColumn("_hit", F.col("_a").isNotNull()).fillna(0.0, ["_a", "_b", "_c", "_d"])

    def make():
        last: list = []

        def f(row):
            last[:] = row if not last else [y + (x - y) * 2 / 21 for x, y in zip(row, last)]
            return tuple(last)

        return f

    df = streamed(df, [(make, EVENT[1:])], ("_a", "_b", "_c", "_d"))
    df = df.withColumn("_i", F.row_number().over(past()))
    since = F.col("_i") - F.last(F.when(F.col("_hit"), F.col("_i")), True).over(past().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(EVENT[0], F.coalesce(F.exp(-since / 20.0) * 2 - 1, F.lit(-1.0))).select(*bars.columns, *EVENT)
