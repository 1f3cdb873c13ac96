"""Statistical forecasts, quantile baselines, weighted quantiles, conformal margins and overfitting measures."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.places import places, quantiles
from ..functions.series import ratio

#: Normal quantiles of the bands.
Z = {0.5: 0.674, 0.68: 0.994, 0.8: 1.282, 0.9: 1.645, 0.95: 1.96}


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("_b", back).where(F.col("_b") <= n).drop("_b")


def project(bars: DataFrame, horizon: int, drift: float = 0.3, last: int = 200, least: int = 30) -> DataFrame:
    """(symbol, step, mid, and low/high for each band) from the last log returns; none for short or still series."""
    r = tail(bars.withColumn("ret", F.log(ratio(F.col("close"), s.lag("close")))).where("ret IS NOT NULL"), last)
    g = r.groupBy("symbol").agg(F.max_by("close", "ts").alias("c"), F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("sd") > 0))
    g = g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    center, spread = F.col("mu") * drift * F.col("step"), F.col("sd") * F.sqrt(F.col("step").cast("double"))
    bands = {f"{side}_{int(100 * p)}": F.col("c") * F.exp(center + k * z * spread) for p, z in Z.items() for side, k in (("low", -1), ("high", 1))}
    return g.withColumns({"mid": F.col("c") * F.exp(center), **bands}).select("symbol", "step", "mid", *bands)


def monte_carlo(bars: DataFrame, horizon: int, paths: int = 2000, last: int = 500, seed: int = 7) -> DataFrame:
    """(symbol, step, p5, p25, p50, p75, p95, prob_up, mean) of bootstrap paths; draws are hashes of seed, symbol, path and step."""
    r = tail(bars.withColumn("ret", F.log(ratio(F.col("close"), s.lag("close")))).where("ret IS NOT NULL"), last)
    g = r.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ret"))), lambda x: x["ret"]).alias("r"), F.max_by("close", "ts").alias("c"))
    g = g.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    draw = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.get(F.col("r"), F.pmod(F.xxhash64(F.lit(seed), "symbol", "path", k), F.size("r").cast("bigint")).cast("int")))
    g = g.select("symbol", "c", "path", F.posexplode(draw).alias("k", "r"))
    w = Window.partitionBy("symbol", "path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("p", F.col("c") * F.exp(F.sum("r").over(w)))
    q = {f"p{int(100 * x)}": F.percentile("p", F.lit(x)) for x in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return g.groupBy("symbol", (F.col("k") + 1).alias("step")).agg(*[v.alias(k) for k, v in q.items()], F.avg((F.col("p") > F.col("c")).cast("double")).alias("prob_up"), F.avg("p").alias("mean"))


def pinball(y, quantile, q: float):
    return F.avg(F.greatest(q * (y - quantile), (q - 1) * (y - quantile)))


#: Fewest training and test rows of a fold.
LEAST_TRAIN, LEAST_TEST = 200, 60


def time_folds(panel: DataFrame, folds: int, horizon_ms: int) -> DataFrame:
    """panel rows once for each fold they serve: fold, part (train up to an edge, test from the edge plus the horizon to the next).

    Folds with fewer than LEAST_TRAIN training or LEAST_TEST test rows are left out."""
    span = panel.agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    p = panel.join(F.broadcast(span)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    edge = lambda k: F.col("_from") + (F.col("_to") - F.col("_from")) * k / (folds + 1.0)
    part = F.when(F.col("ts") <= edge(F.col("fold")), "train").when((F.col("ts") > edge(F.col("fold")) + horizon_ms) & (F.col("ts") <= edge(F.col("fold") + 1)), "test")
    p = p.withColumn("part", part).where("part IS NOT NULL").drop("_from", "_to")
    enough = p.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b")).where((F.col("a") >= LEAST_TRAIN) & (F.col("b") >= LEAST_TEST))
    return p.join(F.broadcast(enough.select("fold")), "fold", "left_semi")  # a row a fold


def baselines(panel: DataFrame, y: str, folds: int, horizon_ms: int, levels=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(fold, q, n, loss): pinball loss on each fold's test part of the unconditional quantile of its training part."""
    f = time_folds(panel.where(F.col(y).isNotNull()), folds, horizon_ms)
    cut = quantiles(f.where("part = 'train'"), ["fold"], y, list(levels))  # a row a fold and level
    test = f.where("part = 'test'").select("fold", F.col(y).alias("y")).join(F.broadcast(cut.withColumnRenamed("quantile", "cut")), "fold")
    d = F.col("y") - F.col("cut")
    return test.groupBy("fold", "q").agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("q") * d, (F.col("q") - 1) * d)).alias("loss"))


def conformal_margin(rows: DataFrame, y: str, low: str, high: str, target: float = 0.8) -> DataFrame:
    """(margin): how far the band must widen to hold `target` of y; never below 0."""
    miss = F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))
    misses = rows.select(miss.alias("m")).where("m IS NOT NULL")
    size = misses.count()
    level = min(0.999, target * (1 + 1 / size)) if size else target
    return quantiles(misses, [], "m", [level]).agg(F.max(F.greatest(F.lit(0.0), F.col("quantile"))).alias("margin"))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """by and quantile: values in order at (cumulative weight - weight / 2) / total, interpolated and clamped at the ends."""
    w = Window.partitionBy(*by).orderBy(value, weight)  # ties by weight, so that any order of rows gives the same
    total = F.sum(weight).over(Window.partitionBy(*by))
    place = ratio(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 0.5 * F.col(weight), total)
    p = rows.withColumn("_p", place)
    p = p.withColumns({"_np": F.lead("_p").over(w), "_nv": F.lead(value).over(w), "_first": F.lag("_p").over(w).isNull()})
    inside = (F.col("_p") <= q) & (F.col("_np") > q)
    picked = F.when(inside, F.col(value) + (q - F.col("_p")) * ratio(F.col("_nv") - F.col(value), F.col("_np") - F.col("_p"))).when(F.col("_first") & (F.col("_p") > q), F.col(value)).when(F.col("_np").isNull() & (F.col("_p") <= q), F.col(value))
    return p.withColumn("_x", picked).where("_x IS NOT NULL").groupBy(*by).agg(F.max("_x").alias("quantile"))


def normal_quantile(p: float) -> float:
    """Standard normal quantile by Newton steps."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    x = 0.0
    for _ in range(60):
        step = (0.5 * (1 + math.erf(x / math.sqrt(2))) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
    return x


def expected_max(trials: int, null_std: float = 1.0) -> float:
    """Expected best of `trials` results without skill."""
    if trials <= 1:
        return 0.0
    g = 0.5772156649015329
    return null_std * ((1 - g) * normal_quantile(1 - 1 / trials) + g * normal_quantile(1 - 1 / (trials * math.e)))


def p_value(null: DataFrame, column: str, observed: float) -> DataFrame:
    """(p): share of finite null results at or above the observed one, that one counted among them."""
    ok = F.col(column).isNotNull() & ~F.isnan(column)
    return null.where(ok).agg(((F.count_if(F.col(column) >= observed) + 1) / (F.count("*") + 1).cast("double")).alias("p"))


def pbo(results: DataFrame, splits: int = 10) -> DataFrame:
    """(pbo): of all ways to take half the time blocks, the share in which the best candidate there ranks in the lower half of the rest.

    results: (t, candidate, value). Sums by block leave blocks x candidates rows, whatever the number of times. Null below
    four candidates, whose places tell nothing, and below one time a block."""
    if splits < 4 or splits % 2:
        raise ValueError("splits must be even, 4 at least")
    order = places(results.select("t").distinct(), [], ["t"]).withColumnRenamed("place", "_i")
    n = order.count()
    size, more = divmod(n, splits)
    cut = more * (size + 1)
    block = F.when(F.col("_i") < cut, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - cut) / max(size, 1)))
    sums = results.join(order.select("t", block.cast("int").alias("block")), "t").groupBy("block", "candidate").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    halves = [list(x) for x in combinations(range(splits), splits // 2)]
    split = F.posexplode(F.array(*[F.array(*[F.lit(b) for b in h]) for h in halves])).alias("split", "half")
    rows = sums.select("block", "candidate", "s", "n", split).withColumn("front", F.array_contains("half", F.col("block")))
    part = lambda yes: ratio(F.sum(F.when(F.col("front") == yes, F.col("s"))), F.sum(F.when(F.col("front") == yes, F.col("n"))).cast("double"))
    m = rows.groupBy("split", "candidate").agg(part(True).alias("front"), part(False).alias("back"))
    w = Window.partitionBy("split")
    m = m.withColumns({"k": F.count("*").over(w), "best": F.row_number().over(w.orderBy(F.desc("front"), "candidate")), "low": F.count("*").over(w.orderBy("back").rangeBetween(Window.unboundedPreceding, 0))})
    share = F.col("low") / (F.col("k") + 1)
    enough = (F.max("k") >= 4) & F.lit(n >= splits)
    return m.where("best = 1").agg(F.when(enough, F.avg((share < 0.5).cast("double"))).alias("pbo"))


def survives(observed: float, trials: int, null_std: float, cushion: float = 1.0) -> bool:
    """Whether a result stands out from the best of as many trials without skill, that times the cushion."""
    return observed > cushion * expected_max(trials, null_std)


def effective_n(rows: int, horizon: int) -> int:
    """Independent rows among overlapping labels of `horizon` bars."""
    return max(1, rows // max(1, horizon)) if rows > 0 else 0


def block_shuffle(frame: DataFrame, columns: list[str], block: int, seed: int) -> DataFrame:
    """frame with the listed columns moved together by one seeded order of contiguous blocks; the others stay."""
    base = places(frame, [], ["ts"]).withColumnRenamed("place", "_i")
    moved = base.select("_i", *columns).withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_h", F.xxhash64(F.lit(seed), "_b"))
    moved = places(moved, [], ["_h", "_b", "_i"]).withColumnRenamed("place", "_j")
    return base.drop(*columns).join(moved.select(F.col("_j").alias("_i"), *columns), "_i").drop("_i").select(*frame.columns)
