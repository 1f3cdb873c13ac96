"""Events: chart detectors, as-of lookups, event studies, spikes as islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.places import quantiles
from ..functions.series import ratio


#: Bars a symbol must have beyond `least` before anything is detected in it.
SPARE = 5


def detect(bars: DataFrame, lookback: int = 250, least: int = 60) -> DataFrame:
    """(symbol, ts, kind, severity) of return spikes, volume bursts, volatility jumps, gaps and breaks of the range of the
    last `lookback` bars (of `least` at any rate); severities lie within 0.1 and 1.

    A break counts only where the bar before was none, and rests for max(5, lookback // 10) bars after one that counted.
    """
    from .recurrence import compute_all

    df = compute_all(bars, [("atr", {})], lambda key, out: "_atr")
    df = df.withColumns({"_chg": ratio(F.col("close"), s.lag("close")) - 1, "_gap": ratio(F.col("open"), s.lag("close")) - 1, "_v20": F.when(F.count("volume").over(s.rows(20)) >= 5, F.avg("volume").over(s.rows(20)))})
    df = df.withColumns({"_ar": F.abs(F.log(1 + F.col("_chg"))), "_ag": F.abs("_gap"), "_ap": ratio(F.col("_atr"), F.col("close"))})
    before = s.past().rowsBetween(-lookback, -1)
    known = lambda c, f: F.when(F.count(c).over(before) >= least, f(c).over(before))
    df = df.withColumns(
        {
            "_rank_r": s.rolling_rank("_ar", lookback, least),
            "_rank_v": s.rolling_rank("volume", lookback, least),
            "_rank_g": s.rolling_rank("_ag", lookback, least),
            "_rank_a": s.rolling_rank("_ap", lookback, least),
            "_top": known("high", F.max),
            "_low": known("low", F.min),
            "_bar": F.row_number().over(s.past()),
        }
    )
    df = df.withColumns(
        {
            "_up": (F.col("high") > F.col("_top")) & (s.lag("high") <= s.lag("_top")),
            "_dn": (F.col("low") < F.col("_low")) & (s.lag("low") >= s.lag("_low")),
            "_calm": s.lag("_rank_a") < 0.9,
            "_bars": F.count("*").over(Window.partitionBy("symbol")),
        }
    )
    sev = lambda x, d: F.greatest(F.lit(0.1), F.least(F.lit(1.0), x / d))
    bursts = ratio(F.col("volume"), F.col("_v20"))
    rest = max(5, lookback // 10) + 1
    hits: dict[str, tuple[Column, Column, int]] = {
        "spike": (F.col("_rank_r") >= 0.99, sev(F.abs("_chg"), 0.15), 1),
        "volume": ((F.col("_rank_v") >= 0.99) & (F.col("_v20") > 0), sev(bursts, 6.0), 1),
        "volatility": ((F.col("_rank_a") >= 0.99) & F.col("_calm"), sev(F.col("_ap"), 0.05), 1),
        "gap": ((F.col("_rank_g") >= 0.99) & (F.col("_ag") >= 0.002), sev(F.col("_ag"), 0.05), 1),
        "new_high": (F.col("_up"), F.lit(0.5), rest),
        "new_low": (F.col("_dn"), F.lit(0.5), rest),
    }
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("kind"), x.alias("severity"), F.lit(n).alias("gap"))) for k, (hit, x, n) in hits.items()])
    rows = df.where(F.col("_bars") >= least + SPARE).select("symbol", "ts", "_bar", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e"))
    return cooled(rows.select("symbol", "ts", "_bar", "e.*"), "_bar", F.first("gap")).select("symbol", "ts", "kind", "severity")


def cooled(hits: DataFrame, index: str, gap: Column | int) -> DataFrame:
    """hits at least `gap` bars after the last one kept, for each symbol and kind: a fold over the ordered indices.

    gap is a number or an aggregate over a symbol's hits of one kind. Other columns stay."""
    others = [c for c in hits.columns if c not in ("symbol", "kind", index)]
    row = F.struct(F.col(index).cast("long").alias("i"), *others)
    g = hits.groupBy("symbol", "kind").agg(F.array_sort(F.collect_list(row)).alias("o"), (F.lit(gap) if isinstance(gap, int) else gap).cast("long").alias("g"))
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (x["i"] - F.element_at(acc, -1)["i"] >= F.col("g")), F.array_append(acc, x)).otherwise(acc)
    kept = g.select("symbol", "kind", F.explode(F.aggregate("o", F.slice("o", 1, 0), keep)).alias("x"))
    return kept.select("symbol", "kind", F.col("x.i").alias(index), *[f"x.{c}" for c in others])


def merge(found: DataFrame) -> DataFrame:
    """One row per symbol and bar: kinds by falling severity, the largest severity plus 0.1 for each further kind, within 0.1 and 1."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), "kind")))
    g = found.groupBy("symbol", "ts").agg(order.alias("o"), F.max("severity").alias("m"), F.count("*").alias("n"))
    sev = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("m") + 0.1 * (F.col("n") - 1)))
    return g.select("symbol", "ts", F.array_join(F.transform("o", lambda x: x["kind"]), "+").alias("kinds"), sev.alias("severity"))


def asof(left: DataFrame, right: DataFrame, value: str, forward: bool = False, out: str = "value") -> DataFrame:
    """left (symbol, ts, ...) with the last right value at or before ts, or the first at or after it: one shuffle, no range join."""
    a = left.withColumns({"_side": F.lit(1 if not forward else 0), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select("symbol", "ts", F.col(value).alias("_v"), F.lit(0 if not forward else 1).alias("_side"), F.lit(True).alias("_right"))
    both = a.withColumn("_right", F.lit(False)).unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts", "_side")
    x = F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(out, x).where("NOT _right").select(*left.columns, out)


#: Events that an average needs.
LEAST_EVENTS = 3


def event_windows(bars: DataFrame, events: DataFrame, before: int = 5, after: int = 20, estimation: int = 120, gap: int = 5) -> DataFrame:
    """events (symbol, ts, ...) with bar, place, sigma, ar and car: abnormal log returns from `before` bars before to `after`
    bars past the first bar at or after ts, and their running sums.

    Normal is the mean of the `estimation` returns that end `gap` bars before the window, half of them known at least.
    Events without those bars or a whole window are left out. The windows are arrays over rows, so events join once."""
    df = bars.withColumn("ret", F.log(ratio(F.col("close"), s.lag("close"))))
    est, win = s.past().rowsBetween(-(before + gap + estimation), -(before + gap + 1)), s.past().rowsBetween(-before, after)
    df = df.withColumns({"_k": F.count("ret").over(est), "_mu": F.avg("ret").over(est), "sigma": F.stddev_samp("ret").over(est), "_w": F.collect_list("ret").over(win), "place": F.row_number().over(s.past())})
    df = df.where((F.col("_k") >= estimation // 2) & (F.col("place") > before + gap + estimation + 1) & (F.size("_w") == before + after + 1))
    ar = F.transform("_w", lambda r: r - F.col("_mu"))
    sums = F.transform("ar", lambda x, i: F.aggregate(F.slice("ar", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y))
    df = df.withColumn("ar", ar).withColumn("car", sums).select("symbol", F.col("ts").alias("bar"), "place", "sigma", "ar", "car")
    located = asof(events, bars.withColumn("_bar", F.col("ts")), "_bar", forward=True, out="bar")
    return located.join(df, ["symbol", "bar"])


def event_study(windows: DataFrame, by: str, before: int = 5) -> DataFrame:
    """(by, offset, events, mean_ar, mean_car, median_car, car_low, car_high in percent, t) of event_windows, for groups of
    three events or more; t is 0 where the sums do not vary."""
    pct = lambda x: F.expm1(x) * 100
    long = windows.select(F.col(by).alias("_g"), F.posexplode(F.arrays_zip("ar", "car")).alias("k", "x")).select("_g", "k", "x.ar", "x.car")
    g = long.groupBy("_g", "k").agg(F.count("*").alias("events"), F.avg("ar").alias("ar"), F.avg("car").alias("car"), F.coalesce(ratio(F.avg("car") * F.sqrt(F.count("*").cast("double")), F.stddev_samp("car")), F.lit(0.0)).alias("t"))
    at = quantiles(long, ["_g", "k"], "car", [0.25, 0.5, 0.75]).groupBy("_g", "k").agg(*[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for n, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))])
    g = g.join(at, ["_g", "k"]).where(F.col("events") >= LEAST_EVENTS)
    return g.select(F.col("_g").alias(by), (F.col("k") - before).alias("offset"), "events", pct("ar").alias("mean_ar"), pct("car").alias("mean_car"), pct("mid").alias("median_car"), pct("lo").alias("car_low"), pct("hi").alias("car_high"), "t")


def study_groups(windows: DataFrame, by: str) -> DataFrame:
    """(by, events, available, final_car in percent, final_t, hit_rate, significant, overlapping) a group: whether it has
    three events, where their mean ends, how many end above 0, |t| of 1.96, and whether two windows of a symbol overlap."""
    last = F.element_at("car", -1)
    before = F.lag("place").over(Window.partitionBy(by, "symbol").orderBy("place"))
    w = windows.withColumns({"_last": last, "_near": F.coalesce(F.col("place") - before < F.size("car") - 1, F.lit(False))})
    g = w.groupBy(by).agg(
        F.count("*").alias("events"), F.avg("_last").alias("_m"), F.coalesce(ratio(F.avg("_last") * F.sqrt(F.count("*").cast("double")), F.stddev_samp("_last")), F.lit(0.0)).alias("_t"),
        F.avg((F.col("_last") > 0).cast("double")).alias("_up"), F.max("_near").alias("_near"),
    )
    ok = F.col("events") >= LEAST_EVENTS
    out = {"final_car": F.expm1("_m") * 100, "final_t": F.col("_t"), "hit_rate": F.col("_up"), "significant": F.abs("_t") >= 1.96, "overlapping": F.col("_near")}
    return g.select(by, "events", ok.alias("available"), *[F.when(ok, x).alias(k) for k, x in out.items()])


def spike_islands(series: DataFrame, quantile: float = 0.97) -> DataFrame:
    """(symbol, ts, value) of the highest bar of each run at or above the symbol's whole-series quantile."""
    w = Window.partitionBy("symbol").orderBy("ts")
    cut = quantiles(series, ["symbol"], "value", [quantile]).select("symbol", F.col("quantile").alias("cut"))
    n = series.withColumn("_n", F.row_number().over(w)).join(cut, "symbol").where("value >= cut")
    runs = n.withColumn("_run", F.col("_n") - F.row_number().over(w))
    return runs.groupBy("symbol", "_run").agg(F.max_by("ts", F.struct("value", -F.col("ts"))).alias("ts"), F.max("value").alias("value")).drop("_run")
