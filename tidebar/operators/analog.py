"""Analog retrieval: past windows shaped like the present one, and what followed them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s


def znorm(values: Column) -> Column:
    """An array less its mean over its population deviation; a flat one becomes zeros."""
    n = F.size(values)
    stats = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).alias("m")))
    sd = lambda t: F.sqrt(F.aggregate(t["v"], F.lit(0.0), lambda a, x: a + (x - t["m"]) * (x - t["m"])) / n)
    with_sd = F.transform(stats, lambda t: F.struct(t["v"].alias("v"), t["m"].alias("m"), sd(t).alias("d")))
    return F.element_at(F.transform(with_sd, lambda t: F.transform(t["v"], lambda x: F.when(t["d"] > 0, (x - t["m"]) / t["d"]).otherwise(0.0))), 1)


def windows(bars: DataFrame, length: int, horizon: int) -> DataFrame:
    """(symbol, ts, bar, bars, shape, path): z-normed closes of the `length` bars up to each bar, and the log path after it."""
    w = s.past().rowsBetween(-(length - 1), 0)
    ahead = s.past().rowsBetween(0, horizon)
    df = bars.withColumns({"bar": F.row_number().over(s.past()), "bars": F.count("*").over(Window.partitionBy("symbol")), "_c": F.collect_list("close").over(w), "_n": F.collect_list("close").over(ahead)})
    df = df.where(F.size("_c") == length)
    path = F.when(F.size("_n") == horizon + 1, F.transform("_n", lambda x: F.log(x / F.col("close"))))
    return df.select("symbol", "ts", "bar", "bars", znorm(F.col("_c")).alias("shape"), path.alias("path"))


def _dtw(a: np.ndarray, b: np.ndarray, band: float) -> np.ndarray:
    """Of each row of a and b, the root of the least squared cost of a warping path within the band, over the longer length.

    The cells of the band are gone through once; each step works on all rows."""
    n, m = a.shape[1], b.shape[1]
    width = max(1, round(band * max(n, m)), abs(n - m))
    prev = np.full((m + 1, len(a)), np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        cur = np.full_like(prev, np.inf)
        for j in range(max(1, i - width), min(m, i + width) + 1):
            cur[j] = (a[:, i - 1] - b[:, j - 1]) ** 2 + np.minimum(np.minimum(prev[j], cur[j - 1]), prev[j - 1])
        prev = cur
    return np.sqrt(prev[m] / max(n, m))


#: Share of the axes that both sides must have; coverage that the outer quantiles promise; the most they are widened.
LEAST_AXES, NOMINAL, MAX_WIDEN = 0.6, 0.8, 3.0


def _apart(a: Column, b: Column, weights: list[float]) -> Column:
    """Root mean square, by weight, of the weighted differences of two situation vectors over the axes that both have."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y)
    d = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), w, lambda x, y: F.struct((x * y).alias("d"), F.when(x.isNotNull(), y).otherwise(0.0).alias("w")))
    known = F.size(F.filter(d, lambda x: x["d"].isNotNull()))
    out = F.sqrt(total(F.transform(d, lambda x: F.coalesce(x["d"] * x["d"], F.lit(0.0)))) / total(F.transform(d, lambda x: x["w"])))
    return F.when(known >= len(weights) * LEAST_AXES, out)


def search(
    bars: DataFrame, length: int = 48, horizon: int = 24, preselect: int = 400, top: int = 20, band: float = 0.15, exclude_recent: int = 0,
    context_weight: float = 0.5, group_weights: dict[str, float] | None = None, peers: DataFrame | None = None, mask: str | None = None,
) -> DataFrame:
    """(query, symbol, source, ts, bar, rms, shape, context, distance, path): for each symbol's last window, its nearest past windows.

    Of each source the `preselect` nearest by root mean square go on; their distance is dynamic time warping and that of
    the situation vectors, mixed by context_weight; windows whose situation is mostly unknown are none at any weight. Of the rest, by
    rising distance, those less than half a window from a better one of the same source go. Candidates end `horizon` bars
    before the last one at least, and where the boolean column `mask` says so. Sources are the symbol itself, or those of
    peers (symbol, source). Symbols of fewer than length + 5 bars are not asked for."""
    from .context import AXES, situation, weights

    w = windows(bars, length, horizon)
    query = w.where((F.col("bar") == F.col("bars")) & (F.col("bars") >= length + 5)).select("symbol", F.col("shape").alias("q"), F.col("ts").alias("query"))
    axes = situation(bars.drop(*([mask] if mask else []))).select("symbol", "ts", F.array(*AXES).alias("axes"))
    if mask:
        w = w.join(bars.where(mask).select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    cand = w.where((F.col("bar") <= F.col("bars") - horizon - exclude_recent) & F.col("path").isNotNull()).withColumnRenamed("symbol", "source")
    cand = cand.withColumn("symbol", F.col("source")) if peers is None else cand.join(peers.select("symbol", "source").distinct(), "source")
    cand = cand.join(query, "symbol")
    rms = F.sqrt(F.aggregate(F.zip_with("shape", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / length)
    cand = cand.withColumn("rms", rms)
    near = cand.withColumn("_r", F.row_number().over(Window.partitionBy("symbol", "source").orderBy("rms", "bar"))).where(F.col("_r") <= preselect)
    keep = ["query", "symbol", "source", "ts", "bar", "rms", "path"]

    def warp(batches):
        for b in batches:
            shape, q = (b.column(c).flatten().to_numpy().reshape(-1, length) for c in ("shape", "q"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(_dtw(shape, q, band), pa.float64())], [*keep, "warp"])

    scored = near.select(*keep, "shape", "q").mapInArrow(warp, "query long, symbol string, source string, ts long, bar int, rms double, path array<double>, warp double")
    mine = axes.select("symbol", F.col("ts").alias("query"), F.col("axes").alias("a"))
    theirs = axes.select(F.col("symbol").alias("source"), "ts", F.col("axes").alias("b"))
    scored = scored.join(mine, ["symbol", "query"]).join(theirs, ["source", "ts"]).withColumn("context", _apart(F.col("b"), F.col("a"), list(weights(group_weights).values()))).where("context IS NOT NULL")
    scored = scored.withColumn("distance", (1 - context_weight) * F.col("warp") + context_weight * F.col("context"))
    # At most `preselect` rows a symbol and source come together here.
    row = F.struct("distance", "source", "bar", "ts", "rms", "warp", "context", "path")
    rows = scored.groupBy("query", "symbol").agg(F.array_sort(F.collect_list(row)).alias("o"))
    near_one = lambda acc, x: F.exists(acc, lambda k: (k["source"] == x["source"]) & (F.abs(k["bar"] - x["bar"]) < max(1, length // 2)))
    pick = lambda acc, x: F.when((F.size(acc) < top) & ~near_one(acc, x), F.array_append(acc, x)).otherwise(acc)
    x = rows.select("query", "symbol", F.explode(F.aggregate("o", F.slice("o", 1, 0), pick)).alias("x"))
    return x.select("query", "symbol", "x.source", "x.ts", "x.bar", "x.rms", F.col("x.warp").alias("shape"), "x.context", "x.distance", "x.path")


def _weighted(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    return float(np.interp(q, (np.cumsum(w) - 0.5 * w) / w.sum(), v))


def coverage(matches: DataFrame) -> DataFrame:
    """(symbol, coverage, widen): the share of a symbol's matches whose end lies within the 80 % band of the others, null
    below five, and the factor that makes up for less, at most MAX_WIDEN. A group is the matches of one search."""

    def one(t: pa.Table) -> pa.Table:
        d = t.column("distance").to_numpy()
        end = np.array([p[-1] for p in t.column("path").to_pylist()])
        scale = np.median(d)
        w = np.exp(-d / scale) if np.isfinite(scale) and scale > 0 else np.ones(len(d))
        share = None
        if len(d) >= 5:
            inside = 0
            for i in range(len(d)):
                v, k = np.delete(end, i), np.delete(w, i)
                inside += _weighted(v, k, (1 - NOMINAL) / 2) <= end[i] <= _weighted(v, k, 1 - (1 - NOMINAL) / 2)
            share = inside / len(d)
        widen = min(MAX_WIDEN, NOMINAL / share) if share and share < NOMINAL else 1.0
        return pa.table({"symbol": [t.column("symbol")[0].as_py()], "coverage": pa.array([share], pa.float64()), "widen": [widen]})

    return matches.select("symbol", "distance", "path").groupBy("symbol").applyInArrow(one, "symbol string, coverage double, widen double")


def project(matches: DataFrame, quantiles=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(symbol, step, q10 ... q90, prob_up, coverage): quantiles of the matches' paths, weighted by exp(-distance / median
    distance), and widened about the median where the matches cover each other less than they promise."""
    from .forecast import weighted_quantile

    w = Window.partitionBy("symbol")
    m = matches.withColumn("_w", F.exp(-F.coalesce(F.try_divide("distance", F.percentile("distance", F.lit(0.5)).over(w)), F.lit(0.0))))
    steps = m.select("symbol", "_w", F.posexplode("path").alias("step", "v"))
    out = steps.groupBy("symbol", "step").agg(F.try_divide(F.sum(F.when(F.col("v") > 0, F.col("_w")).otherwise(0.0)), F.sum("_w")).alias("prob_up"))
    names = {q: f"q{int(100 * q)}" for q in {*quantiles, 0.5}}
    for q, name in names.items():
        out = out.join(weighted_quantile(steps, ["symbol", "step"], "v", "_w", q).withColumnRenamed("quantile", name), ["symbol", "step"])
    out = out.join(coverage(matches), "symbol")
    wide = {names[q]: F.col("q50") + (F.col(names[q]) - F.col("q50")) * F.col("widen") for q in quantiles if q != 0.5}
    return out.withColumns(wide).drop("widen")
