"""Rules that read indicators at a bar, and their weighted vote. No rule looks past its bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import past, ratio
from . import indicators as ind
from .recurrence import compute_all

RULES: dict[str, Callable[[], list[tuple[Column, Column, Column, float]]]] = {}
#: Bars before the first decision; score from which the vote has a direction.
WARMUP, EDGE = 120, 0.15


def rule(key: str):
    """Registers cases (condition, direction, strength, weight) of a rule; the first that holds is the rule's hit."""

    def add(f):
        if key in RULES:
            raise ValueError(f"rule {key!r} is registered already")
        RULES[key] = f
        return f

    return add


def c(name: str) -> Column:
    return F.col(f"_{name}")


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(-1.0)


def one(x) -> Column:
    return F.least(F.lit(1.0), x)


def recent(x: Column, n: int) -> Column:
    return F.coalesce(F.max(x.cast("int")).over(s.rows(n)) == 1, F.lit(False))


def prepared(bars: DataFrame) -> DataFrame:
    """bars with every input of the rules, as columns that begin with _: one recurrence pass, then windows and crossings on one sort."""
    keep = {("macd", "macd"): "_macd", ("macd", "signal"): "_macds", ("macd", "hist"): "_hist", ("rsi", "rsi"): "_rsi", ("supertrend", "direction"): "_st", ("squeeze", "momentum"): "_mom", ("squeeze", "squeeze_on"): "_on", ("adx", "adx"): "_adx", ("adx", "plus_di"): "_pdi", ("adx", "minus_di"): "_mdi", ("fisher", "fisher"): "_fi", ("fisher", "trigger"): "_tr"}
    wanted = [(k, {}) for k in ("macd", "rsi", "supertrend", "squeeze", "adx", "fisher")] + [("ma", {"length": 20}), ("ma", {"length": 60})]
    lengths = iter(("_e20", "_e60"))
    df = compute_all(bars, wanted, lambda key, out: next(lengths) if key == "ma" else keep.get((key, out), f"_x_{key}_{out}"))
    for key, outs in (("ichimoku", {x: f"_{x}" for x in ("tenkan", "kijun", "span_a", "span_b")}), ("bbands", {"percent_b": "_pb"}), ("stoch", {"k": "_k", "d": "_d"}), ("cmf", {"cmf": "_cmf"}), ("swings", {"swing_high": "_sh", "swing_low": "_sl"})):
        base = df.columns
        df = ind.compute(df, key).select(*base, *[F.col(a).alias(b) for a, b in outs.items()])
    df = ind.add_patterns(df).select(*df.columns, *[f"pat_{k}" for k in ind.PATTERNS])
    cross = {"tk": ("_tenkan", "_kijun"), "ma": ("_e20", "_e60"), "mc": ("_macd", "_macds"), "fc": ("_fi", "_tr"), "kd": ("_k", "_d")}
    df = df.withColumns({f"_{n}_{d}": s.crossed_up(*(p if d == "up" else p[::-1])) for n, p in cross.items() for d in ("up", "dn")})
    df = df.withColumns({f"_{n}_{d}": recent(c(f"{n}_{d}"), 3 if n in ("tk", "ma") else 2) for n in cross for d in ("up", "dn")})
    # Swings confirmed by now: five bars old. The last two of each kind with the RSI they had.
    df = df.withColumn("_i", F.row_number().over(past()))
    for k in ("sh", "sl"):
        at = F.when(s.lag(f"_{k}", 5).isNotNull(), F.struct(s.lag(f"_{k}", 5).alias("p"), s.lag("_rsi", 5).alias("r"), (F.col("_i") - 5).alias("i")))
        df = df.withColumn(f"_{k}c", at)
        df = df.withColumn(f"_{k}b", F.last(f"_{k}c", True).over(past().rowsBetween(Window.unboundedPreceding, -1)))
        df = df.withColumns({f"_{k}1": F.last(f"_{k}c", True).over(past().rowsBetween(Window.unboundedPreceding, 0)), f"_{k}0": F.last(F.when(c(f"{k}c").isNotNull(), c(f"{k}b")), True).over(past().rowsBetween(Window.unboundedPreceding, 0))})
    return df.withColumns({"_hist1": s.lag("_hist"), "_st1": s.lag("_st"), "_on1": s.lag("_on")})


@rule("ichimoku_cloud")
def _cloud():
    x = F.col("close")
    top, bottom = F.greatest("_span_a", "_span_b"), F.least("_span_a", "_span_b")
    known = c("span_a").isNotNull() & c("span_b").isNotNull()
    return [(known & (x > top), F.lit(1.0), one(100 * ratio(x - top, top) / 3), 1.5), (known & (x < bottom), F.lit(-1.0), one(100 * ratio(bottom - x, bottom) / 3), 1.5), (known, F.lit(0.0), F.lit(0.2), 1.5)]


@rule("ichimoku_tk_cross")
def _tk():
    return [(c("tk_up"), F.lit(1.0), F.lit(0.7), 1.0), (c("tk_dn"), F.lit(-1.0), F.lit(0.7), 1.0)]


@rule("ma_cross")
def _ma():
    gap = 100 * ratio(c("e20") - c("e60"), c("e60"))
    return [(gap.isNotNull() & c("ma_up"), F.lit(1.0), F.lit(0.8), 1.0), (gap.isNotNull() & c("ma_dn"), F.lit(-1.0), F.lit(0.8), 1.0), (gap.isNotNull(), sign(gap), one(F.abs(gap) / 5), 0.6)]


@rule("macd_cross")
def _macd():
    h, b = c("hist"), c("hist1")
    return [(c("mc_up"), F.lit(1.0), F.lit(0.7), 1.0), (c("mc_dn"), F.lit(-1.0), F.lit(0.7), 1.0), ((h > 0) & (h > b), F.lit(1.0), F.lit(0.4), 0.6), ((h < 0) & (h < b), F.lit(-1.0), F.lit(0.4), 0.6)]


@rule("rsi_zone")
def _rsi():
    v = c("rsi")
    return [(v >= 70, F.lit(-1.0), one((v - 70) / 20), 1.0), (v <= 30, F.lit(1.0), one((30 - v) / 20), 1.0), (v.isNotNull(), sign(v - 50), F.abs(v - 50) / 50, 0.5)]


@rule("rsi_divergence")
def _divergence():
    h0, h1, l0, l1 = c("sh0"), c("sh1"), c("sl0"), c("sl1")
    return [((h1["p"] > h0["p"]) & (h1["r"] < h0["r"]), F.lit(-1.0), F.lit(0.8), 1.3), ((l1["p"] < l0["p"]) & (l1["r"] > l0["r"]), F.lit(1.0), F.lit(0.8), 1.3)]


@rule("supertrend")
def _supertrend():
    turned = c("st1").isNull() | (c("st") != c("st1"))
    return [(c("st").isNotNull() & turned, c("st"), F.lit(0.9), 1.0), (c("st").isNotNull(), c("st"), F.lit(0.5), 0.7)]


@rule("bollinger")
def _bollinger():
    return [(c("pb") > 1, F.lit(-1.0), one(5 * (c("pb") - 1)), 1.0), (c("pb") < 0, F.lit(1.0), one(-5 * c("pb")), 1.0)]


@rule("squeeze")
def _squeeze():
    known = c("on").isNotNull() & c("mom").isNotNull()
    return [(known & (c("on1") == 1) & (c("on") == 0), sign(c("mom")), F.lit(0.9), 1.4), (known & (c("on") == 1), F.lit(0.0), F.lit(0.3), 0.8)]


@rule("adx_strength")
def _adx():
    known = c("adx").isNotNull() & c("pdi").isNotNull() & c("mdi").isNotNull()
    return [(c("adx") < 20, F.lit(0.0), F.lit(0.3), 0.8), (known, sign(c("pdi") - c("mdi")), one(c("adx") / 50), 1.0)]


@rule("fisher")
def _fisher():
    return [(c("fc_up"), F.lit(1.0), F.lit(0.7), 1.0), (c("fc_dn"), F.lit(-1.0), F.lit(0.7), 1.0)]


@rule("stoch")
def _stoch():
    return [((c("k") < 20) & c("kd_up"), F.lit(1.0), F.lit(0.6), 1.0), ((c("k") > 80) & c("kd_dn"), F.lit(-1.0), F.lit(0.6), 1.0)]


@rule("money_flow")
def _flow():
    return [(F.abs(c("cmf")) >= 0.05, sign(c("cmf")), one(4 * F.abs(c("cmf"))), 0.7)]


@rule("candle_pattern")
def _pattern():
    return [(F.col(f"pat_{k}"), F.lit(float(v)), F.lit(0.5), 0.6) for k, v in ind.PATTERNS.items() if v]


@rule("fib_level")
def _fib():
    h, low, x = c("sh1"), c("sl1"), F.col("close")
    rising = h["i"] > low["i"]
    start, end = F.when(rising, low["p"]).otherwise(h["p"]), F.when(rising, h["p"]).otherwise(low["p"])
    near = lambda r: ratio(F.abs(x - (end - r * (end - start))), x) < 0.005
    hit = near(0.382) | near(0.5) | near(0.618)
    return [(hit & (end != start), F.when(end > start, 1.0).otherwise(-1.0), F.lit(0.6), 0.9)]


def hits(bars: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """bars with hits: array<struct(rule, direction, strength, weight)> of the rules that fire at the bar."""
    df = prepared(bars)

    def hit(key):
        out = F.lit(None)
        for cond, direction, strength, weight in reversed(RULES[key]()):
            out = F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(key).alias("rule"), direction.alias("direction"), strength.alias("strength"), F.lit(weight).alias("weight"))).otherwise(out)
        return out

    return df.withColumn("hits", F.filter(F.array(*[hit(k) for k in rules or RULES]), lambda x: x.isNotNull())).select(*bars.columns, "hits")


def evaluate(hit_rows: DataFrame) -> DataFrame:
    """hits() with score (weighted mean of direction * strength), direction beyond EDGE, and confidence; the weightiest hits first."""
    top = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["direction"] * x["strength"] * x["weight"])
    score = F.coalesce(ratio(top, F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["weight"])), F.lit(0.0))
    says = lambda x: x["strength"] * x["weight"]
    first = F.array_sort("hits", lambda a, b: F.when(says(a) > says(b), -1).when(says(a) < says(b), 1).otherwise(0))
    df = hit_rows.withColumn("score", score).withColumn("hits", first)
    return df.withColumns({"direction": F.when(F.col("score") > EDGE, 1).when(F.col("score") < -EDGE, -1).otherwise(0), "confidence": one(1.6 * F.abs("score"))})


def decisions(bars: DataFrame) -> DataFrame:
    """bars with decision: the vote's direction at each bar, 0 in the warm-up; feed it to backtest.positions."""
    n = F.row_number().over(past())
    return evaluate(hits(bars)).withColumn("decision", F.when(n > WARMUP, F.col("direction")).otherwise(0)).select(*bars.columns, "decision")
