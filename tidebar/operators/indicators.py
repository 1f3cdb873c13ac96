"""Indicators that are windows over bars: each takes a candle frame and adds its output columns.

The registry holds every indicator by key with its parameters' defaults and outputs; `compute` adds any number of them
with one shuffle by symbol. Indicators with a recurrence are in recurrence.py and register here too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import past, ratio


def O() -> Column:  # noqa: E743
    return F.col("open")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def C() -> Column:
    return F.col("close")


def V() -> Column:
    return F.col("volume")



@dataclass(frozen=True)
class Indicator:
    key: str
    category: str
    defaults: dict
    outputs: tuple[str, ...]
    apply: Callable[..., DataFrame]
    causal: bool = True
    choices: dict = field(default_factory=dict)


REGISTRY: dict[str, Indicator] = {}


def indicator(key: str, category: str, outputs: str, causal: bool = True, choices: dict | None = None, **defaults):
    def add(f):
        if key in REGISTRY:
            raise ValueError(f"indicator {key!r} is registered already")
        REGISTRY[key] = Indicator(key, category, defaults, tuple(outputs.split()), f, causal, choices or {})
        return f

    return add


def settings(key: str, given: dict) -> dict:
    """Defaults with what is given: unknown names, wrong types and values outside the choices are errors."""
    spec = REGISTRY.get(key)
    if spec is None:
        raise KeyError(f"no indicator {key!r}")
    if unknown := set(given) - set(spec.defaults):
        raise ValueError(f"{key}: unknown parameters {sorted(unknown)}")
    out = dict(spec.defaults)
    for name, value in given.items():
        kind = type(spec.defaults[name])
        out[name] = kind(value)
        if name in spec.choices and out[name] not in spec.choices[name]:
            raise ValueError(f"{key}: {name} must be one of {spec.choices[name]}")
        if kind is int and name not in ("lookback",) and out[name] < 1:
            raise ValueError(f"{key}: {name} must be positive")
    return out


def compute(bars: DataFrame, key: str, **given) -> DataFrame:
    """bars with the indicator's outputs; helper columns do not stay."""
    spec = REGISTRY.get(key)
    params = settings(key, given)
    return spec.apply(bars, **params).select(*bars.columns, *spec.outputs)


def source(name: str) -> Column:
    return {"open": O(), "high": H(), "low": L(), "close": C(), "hl2": (H() + L()) / 2, "hlc3": (H() + L() + C()) / 3, "ohlc4": (O() + H() + L() + C()) / 4}[name]


SOURCES = ("open", "high", "low", "close", "hl2", "hlc3", "ohlc4")


def add_wma(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return (df if "bar" in df.columns else s.numbered(df)).withColumn(out, s.wma(x, n))


def add_hma(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    df = add_wma(add_wma(df, x, max(1, n // 2), "_w1"), x, n, "_w2")
    return add_wma(df.withColumn("_w3", 2 * F.col("_w1") - F.col("_w2")), "_w3", max(1, round(math.sqrt(n))), out)


@indicator("ichimoku", "trend", "tenkan kijun span_a span_b chikou span_a_lead span_b_lead", causal=False, conversion=9, base=26, span=52, displacement=26)
def ichimoku(df, conversion, base, span, displacement):
    mid = lambda n: (s.rolling_max("high", n) + s.rolling_min("low", n)) / 2
    df = df.withColumns({"tenkan": mid(conversion), "kijun": mid(base), "span_b_lead": mid(span)})
    df = df.withColumn("span_a_lead", (F.col("tenkan") + F.col("kijun")) / 2)
    return df.withColumns({"span_a": s.lag("span_a_lead", displacement), "span_b": s.lag("span_b_lead", displacement), "chikou": s.lead("close", displacement)})


@indicator("stoch", "momentum", "k d", length=14, smooth_k=3, smooth_d=3)
def stoch(df, length, smooth_k, smooth_d):
    low, high = s.rolling_min("low", length), s.rolling_max("high", length)
    df = df.withColumn("_raw", 100 * ratio(C() - low, high - low))
    return df.withColumn("k", s.sma("_raw", smooth_k)).withColumn("d", s.sma("k", smooth_d))


@indicator("cci", "momentum", "cci", length=20)
def cci(df, length):
    df = df.withColumn("_tp", (H() + L() + C()) / 3).withColumns({"_m": s.sma("_tp", length), "_list": F.collect_list("_tp").over(s.rows(length))})
    mad = F.aggregate("_list", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m"))) / length
    return df.withColumn("cci", ratio(F.col("_tp") - F.col("_m"), 0.015 * mad))


@indicator("willr", "momentum", "willr", length=14)
def willr(df, length):
    high, low = s.rolling_max("high", length), s.rolling_min("low", length)
    return df.withColumn("willr", -100 * ratio(high - C(), high - low))


@indicator("roc", "momentum", "roc", length=12)
def roc(df, length):
    before = s.lag("close", length)
    return df.withColumn("roc", 100 * ratio(C() - before, before))


@indicator("mfi", "momentum", "mfi", length=14)
def mfi(df, length):
    df = df.withColumn("_tp", (H() + L() + C()) / 3).withColumn("_d", F.col("_tp") - s.lag("_tp"))
    flow = F.col("_tp") * V()
    df = df.withColumns({"_up": F.when(F.col("_d") > 0, flow).otherwise(0.0), "_down": F.when(F.col("_d") < 0, flow).otherwise(0.0)})
    up, down = s.rolling_sum("_up", length), s.rolling_sum("_down", length)
    return df.withColumn("mfi", F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down))))


@indicator("ao", "momentum", "ao", fast=5, slow=34)
def ao(df, fast, slow):
    mid = (H() + L()) / 2
    return df.withColumn("ao", s.sma(mid, fast) - s.sma(mid, slow))


@indicator("bbands", "volatility", "upper middle lower percent_b bandwidth", length=20, mult=2.0)
def bbands(df, length, mult):
    df = df.withColumns({"middle": s.sma("close", length), "_sd": s.stdev("close", length)})
    df = df.withColumns({"upper": F.col("middle") + mult * F.col("_sd"), "lower": F.col("middle") - mult * F.col("_sd")})
    width = F.col("upper") - F.col("lower")
    return df.withColumns({"percent_b": ratio(C() - F.col("lower"), width), "bandwidth": ratio(width, F.col("middle"))})


@indicator("donchian", "volatility", "upper middle lower", length=20)
def donchian(df, length):
    df = df.withColumns({"upper": s.rolling_max("high", length), "lower": s.rolling_min("low", length)})
    return df.withColumn("middle", (F.col("upper") + F.col("lower")) / 2)


@indicator("stdev", "volatility", "stdev", length=20)
def stdev(df, length):
    return df.withColumn("stdev", s.stdev("close", length))


@indicator("obv", "volume", "obv")
def obv(df):
    df = df.withColumn("_s", F.coalesce(F.signum(C() - s.lag("close")) * V(), F.lit(0.0)))
    return df.withColumn("obv", s.running("_s"))


@indicator("vwap", "volume", "vwap", choices={"anchor": ("day", "session", "week", "all")}, anchor="day")
def vwap(df, anchor):
    step = {"day": 86_400_000, "session": 86_400_000, "week": 604_800_000}.get(anchor)
    keys = ["symbol"] if step is None else ["symbol", F.floor(F.col("ts") / step)]
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("vwap", ratio(F.sum((H() + L() + C()) / 3 * V()).over(w), F.sum("volume").over(w)))


def clv() -> Column:
    return F.coalesce(ratio((C() - L()) - (H() - C()), H() - L()), F.lit(0.0))


@indicator("ad", "volume", "ad")
def ad(df):
    return df.withColumn("ad", s.running(clv() * V()))


@indicator("cmf", "volume", "cmf", length=20)
def cmf(df, length):
    return df.withColumn("cmf", ratio(s.rolling_sum(clv() * V(), length), s.rolling_sum("volume", length)))


@indicator("swings", "structure", "swing_high swing_low", causal=False, left=5, right=5)
def swings(df, left, right):
    """Bars whose high (low) is the only extreme of the window around them; known `right` bars later."""
    w = past().rowsBetween(-left, right)
    whole = F.count("*").over(w) == left + right + 1

    def only(c, extreme):
        same = F.size(F.filter(F.collect_list(c).over(w), lambda v: v == c))
        return F.when(whole & (extreme(c).over(w) == c) & (same == 1), c)

    return df.withColumns({"swing_high": only(H(), F.max), "swing_low": only(L(), F.min)})


@indicator("pivots", "levels", "p r1 r2 r3 s1 s2 s3", choices={"kind": ("classic", "fibonacci", "camarilla", "woodie")}, kind="classic", step=604_800_000)
def pivots(df, kind, step):
    """Levels from the high, low and close of the previous bucket that has bars; buckets are on the epoch grid."""
    df = df.withColumn("_b", F.floor(F.col("ts") / step))
    per = df.groupBy("symbol", "_b").agg(F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "ts").alias("_c"))
    w = Window.partitionBy("symbol").orderBy("_b")
    per = per.select("symbol", "_b", *[F.lag(c).over(w).alias(c) for c in ("_h", "_l", "_c")])
    df = df.join(per, ["symbol", "_b"], "left")
    h, low, c = F.col("_h"), F.col("_l"), F.col("_c")
    span, p = h - low, (h + low + 2 * c) / 4 if kind == "woodie" else (h + low + c) / 3
    if kind == "fibonacci":
        levels = [p + k * span for k in (0.382, 0.618, 1.0)] + [p - k * span for k in (0.382, 0.618, 1.0)]
    elif kind == "camarilla":
        levels = [c + span * 1.1 / k for k in (12, 6, 4)] + [c - span * 1.1 / k for k in (12, 6, 4)]
    else:
        levels = [2 * p - low, p + span, h + 2 * (p - low), 2 * p - h, p - span, low - 2 * (h - p)]
    return df.withColumns(dict(zip(("p", "r1", "r2", "r3", "s1", "s2", "s3"), [p, *levels])))


@indicator("linreg_channel", "structure", "channel_upper channel_middle channel_lower", causal=False, length=100, mult=2.0)
def linreg_channel(df, length, mult):
    """A least-squares line through the last bars of each symbol and its residuals' spread, on those bars alone."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    df = s.numbered(df).withColumn("_back", back)
    recent, whole = F.col("_back") <= length, Window.partitionBy("symbol")
    y, x = F.when(recent, C()), F.when(recent, F.col("bar"))
    df = df.withColumns({"_y": y, "_x": x})
    df = df.withColumn("channel_middle", F.when(recent, F.regr_intercept("_y", "_x").over(whole) + F.regr_slope("_y", "_x").over(whole) * F.col("_x")))
    df = df.withColumn("_sd", F.stddev_pop(F.col("_y") - F.col("channel_middle")).over(whole))
    return df.withColumns({"channel_upper": F.col("channel_middle") + mult * F.col("_sd"), "channel_lower": F.col("channel_middle") - mult * F.col("_sd")})


#: Direction of each candle pattern: 1 bullish, -1 bearish, 0 neither; rules take the first that holds, in this order.
PATTERNS = {"doji": 0, "marubozu_bull": 1, "marubozu_bear": -1, "hammer": 1, "inverted_hammer": 1, "hanging_man": -1, "shooting_star": -1, "bullish_engulfing": 1, "bearish_engulfing": -1, "piercing": 1, "dark_cloud": -1, "morning_star": 1, "evening_star": -1, "three_white_soldiers": 1, "three_black_crows": -1}


def add_patterns(df: DataFrame, doji: float = 0.1, shadow: float = 2.0) -> DataFrame:
    """df with a boolean column pat_<name> for each candle pattern; undefined comparisons are false."""
    body, span = F.abs(C() - O()), F.nullif(H() - L(), F.lit(0.0))
    df = df.withColumns({"_body": body, "_small": F.coalesce(body <= doji * span, F.lit(False)), "_big": F.coalesce(body > 0.5 * span, F.lit(False)), "_full": span})
    df = df.withColumns({"_up": H() - F.greatest(O(), C()), "_dn": F.least(O(), C()) - L()})
    df = df.withColumns({f"_{c[0]}{n}": s.lag(c, n) for c in ("open", "close") for n in (1, 2)} | {"_b1": s.lag("_body", 1), "_b2": s.lag("_body", 2), "_g1": s.lag("_big", 1), "_g2": s.lag("_big", 2), "_c5": s.lag("close", 5)})
    o1, c1, o2, c2, b1, b2 = (F.col(x) for x in ("_o1", "_c1", "_o2", "_c2", "_b1", "_b2"))
    falling, rising = c1 < F.col("_c5"), c1 > F.col("_c5")
    lower, upper, small, mid = F.col("_dn") >= shadow * body, F.col("_up") >= shadow * body, F.col("_small"), (o1 + c1) / 2
    long_low, long_up = lower & (F.col("_up") <= body) & ~small, upper & (F.col("_dn") <= body) & ~small
    big3 = F.col("_big") & F.col("_g1") & F.col("_g2")
    full = F.coalesce(body >= 0.95 * span, F.lit(False))
    found = {
        "doji": small,
        "marubozu_bull": (C() > O()) & full,
        "marubozu_bear": (C() < O()) & full,
        "hammer": long_low & falling,
        "inverted_hammer": long_up & falling,
        "hanging_man": long_low & rising,
        "shooting_star": long_up & rising,
        "bullish_engulfing": (C() > O()) & (c1 < o1) & (C() >= o1) & (O() <= c1) & (body > b1),
        "bearish_engulfing": (C() < O()) & (c1 > o1) & (C() <= o1) & (O() >= c1) & (body > b1),
        "piercing": (C() > O()) & (c1 < o1) & (O() < c1) & (C() > mid) & (C() < o1),
        "dark_cloud": (C() < O()) & (c1 > o1) & (O() > c1) & (C() < mid) & (C() > o1),
        "morning_star": (c2 < o2) & (b1 <= 0.5 * b2) & (C() > O()) & (C() > (o2 + c2) / 2),
        "evening_star": (c2 > o2) & (b1 <= 0.5 * b2) & (C() < O()) & (C() < (o2 + c2) / 2),
        "three_white_soldiers": (C() > O()) & (c1 > o1) & (c2 > o2) & (C() > c1) & (c1 > c2) & big3,
        "three_black_crows": (C() < O()) & (c1 < o1) & (c2 < o2) & (C() < c1) & (c1 < c2) & big3,
    }
    return df.withColumns({f"pat_{k}": F.coalesce(v, F.lit(False)) for k, v in found.items()})


@indicator("candle_patterns", "structure", "bullish bearish", doji=0.1, shadow=2.0)
def candle_patterns(df, doji, shadow):
    df = add_patterns(df, doji, shadow)
    count = lambda d: F.nullif(sum((F.col(f"pat_{k}").cast("double") for k, v in PATTERNS.items() if v == d), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"bullish": count(1), "bearish": count(-1)})
