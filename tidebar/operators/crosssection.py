"""Across symbols at one time: market series, rank information coefficients, scores and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import ratio


def log_return(bars: DataFrame, n: int = 1, out: str = "ret") -> DataFrame:
    return bars.withColumn(out, F.log(ratio(F.col("close"), s.lag("close", n))))


def market_series(bars: DataFrame) -> DataFrame:
    """(ts, market_ret, breadth): median log return of the symbols at ts, and how many have one."""
    r = log_return(bars).where("ret IS NOT NULL")
    return r.groupBy("ts").agg(F.percentile("ret", F.lit(0.5)).alias("market_ret"), F.count("*").alias("breadth"))


BETA, SPANS = 120, (5, 20)


def market_features(bars: DataFrame) -> DataFrame:
    """market_ret_5, market_ret_20, rel_strength_5, rel_strength_20, beta (120 bars, 60 at least) and market_vol (place of
    the market's deviation over 120 bars among 240) against the market series.

    All null for a symbol of fewer than 145 bars or with fewer than 120 bars that the market has a return for."""
    m = market_series(bars)
    df = log_return(bars).join(m, "ts", "left")
    for n in SPANS:
        df = df.withColumn(f"_m{n}", s.rolling_sum("market_ret", n)).withColumn(f"_r{n}", s.rolling_sum("ret", n))
    w, whole = s.rows(BETA), Window.partitionBy("symbol")
    both = F.when(F.col("ret").isNotNull() & F.col("market_ret").isNotNull(), 1)
    beta = F.when(F.count(both).over(w) >= BETA // 2, ratio(F.covar_samp("ret", "market_ret").over(w), F.var_samp("market_ret").over(w)))
    df = df.withColumn("_mv", F.when(F.count("market_ret").over(w) >= BETA // 2, F.stddev_pop("market_ret").over(w)))
    enough = (F.count("*").over(whole) >= BETA + max(SPANS) + 5) & (F.count("market_ret").over(whole) >= BETA)
    out = {f"market_ret_{n}": F.tanh(F.col(f"_m{n}") / 0.05) for n in SPANS} | {f"rel_strength_{n}": F.tanh((F.col(f"_r{n}") - F.col(f"_m{n}")) / 0.03) for n in SPANS} | {"beta": F.tanh(beta - 1), "market_vol": s.rolling_rank("_mv", 2 * BETA, BETA) * 2 - 1}
    return df.withColumns({k: F.when(enough, x) for k, x in out.items()}).select(*bars.columns, *out)


def spearman(panel: DataFrame, factor: str, label: str, least: int = 5) -> DataFrame:
    """(ts, n, ic): rank correlation across symbols with ties averaged; null below `least` symbols or without variation."""
    p = panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    p = p.withColumns({"_x": s.avg_rank(factor, "ts"), "_y": s.avg_rank(label, "ts")})
    mean = lambda x: F.avg(x)
    cov = mean(F.col("_x") * F.col("_y")) - mean("_x") * mean("_y")
    out = p.groupBy("ts").agg(F.count("*").alias("n"), ratio(cov, F.stddev_pop("_x") * F.stddev_pop("_y")).alias("ic"))
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


#: Least mean rank correlation of a usable factor, times it must be known at in all and in a fold, and folds.
LEAST_IC, LEAST_TIMES, LEAST_IN_FOLD, LEAST_FOLDS = 0.01, 40, 10, 3


def measure_all(panel: DataFrame, factors: list[str], labels: dict[str, str], horizon_ms: int, folds: int = 4) -> DataFrame:
    """(kind, factor, ic, t, folds, coverage, usable) of every factor against the label of every kind: rank correlations at
    each time, over purged folds of time, all in one long table.

    ic is the mean of the fold means, t that of ic over the spread of all times. Usable: |ic| of 0.01 and one sign in all
    of three folds or more. Below 40 times all is 0; below three folds ic is the mean over all times."""
    long = panel.select("ts", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])).alias("f"), F.array(*[F.struct(F.lit(k).alias("kind"), F.col(y).cast("double").alias("y")) for k, y in labels.items()]).alias("l"))
    long = long.select("ts", "f.factor", "f.x", F.explode("l").alias("l")).select("ts", "factor", "x", "l.kind", "l.y").where("x IS NOT NULL AND y IS NOT NULL")
    at, own = ["kind", "factor", "ts"], ["kind", "factor"]
    r = long.withColumns({"_x": s.avg_rank("x", *at), "_y": s.avg_rank("y", *at)})
    cov = F.avg(F.col("_x") * F.col("_y")) - F.avg("_x") * F.avg("_y")
    ic = r.groupBy(*at).agg(F.count("*").alias("n"), ratio(cov, F.stddev_pop("_x") * F.stddev_pop("_y")).alias("ic")).where("n >= 5 AND ic IS NOT NULL")
    whole = ic.groupBy(*own).agg(F.count("*").alias("n"), F.avg("ic").alias("_all"), F.stddev_samp("ic").alias("_sd"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    f = ic.select(*own, "ts", "ic").join(whole, own).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / (folds + 1.0)
    test = (F.col("ts") > edge(F.col("fold")) + horizon_ms) & (F.col("ts") <= edge(F.col("fold") + 1))
    per = f.groupBy(*own, "fold").agg(F.count_if(F.col("ts") <= edge(F.col("fold"))).alias("_a"), F.count_if(test).alias("_b"), F.avg(F.when(test, F.col("ic"))).alias("m"))
    per = per.where(f"_a >= 200 AND _b >= 60 AND _b >= {LEAST_IN_FOLD}")
    per = per.groupBy(*own).agg(F.avg("m").alias("m"), F.count("*").alias("folds"), (F.abs(F.sum(F.signum("m"))) == F.count("*")).alias("_same"))
    every = panel.sparkSession.createDataFrame([(k, x) for k in labels for x in factors], "kind string, factor string")
    out = every.join(whole, own, "left").join(per, own, "left").fillna(0, ["n", "folds"])
    few, fold = F.col("n") < LEAST_TIMES, F.col("folds") >= LEAST_FOLDS
    t = F.coalesce(ratio(F.col("m") * F.sqrt(F.col("n").cast("double")), F.col("_sd")), F.lit(0.0))
    mean = F.when(few, 0.0).when(fold, F.col("m")).otherwise(F.col("_all"))
    usable = F.coalesce(~few & fold & (F.abs("m") >= LEAST_IC) & F.col("_same"), F.lit(False))
    return out.select("kind", "factor", mean.alias("ic"), F.when(~few & fold, t).otherwise(0.0).alias("t"), F.when(few, F.lit(0)).otherwise(F.col("folds")).cast("long").alias("folds"), F.col("n").alias("coverage"), usable.alias("usable"))


def measure(panel: DataFrame, factor: str, label: str, horizon_ms: int, folds: int = 4) -> DataFrame:
    """One row: ic, t, folds, coverage, usable of one factor against one label, as measure_all has them."""
    return measure_all(panel, [factor], {"label": label}, horizon_ms, folds).drop("kind", "factor")


REL = "__rel"


def with_relative(panel: DataFrame, factors: list[str], n: int = 120) -> DataFrame:
    """panel with a twin of each factor: its standard score within the symbol's own last n bars, half of them at least."""
    return panel.withColumns({f + REL: s.relative_z(f, n, n // 2) for f in factors})


def market_forward(bars: DataFrame, horizon: int) -> DataFrame:
    """bars with market_fwd, the market's log return over the next `horizon` bars of the symbol; a label, null at the end."""
    ahead = s.past().rowsBetween(1, horizon)
    df = bars.join(market_series(bars).select("ts", "market_ret"), "ts", "left")
    return df.withColumn("market_fwd", F.when(F.count("market_ret").over(ahead) == horizon, F.sum("market_ret").over(ahead))).select(*bars.columns, "market_fwd")


def score(panel: DataFrame, factors: dict[str, float], least: int = 5, reasons: int = 3) -> DataFrame:
    """panel with score, the mean over factors of sign * cross-sectional z (population; blanks take the median, no variation
    0), and why, the factors of the largest parts. Factors that fewer than `least` symbols have at ts are left out."""
    at = Window.partitionBy("ts")
    filled = {f: F.coalesce(F.col(f), F.percentile(f, F.lit(0.5)).over(at)) for f in factors}
    df = panel.withColumns({f"_f_{f}": x for f, x in filled.items()})
    z = {f: F.when(F.count(f).over(at) >= least, F.coalesce(ratio(F.col(f"_f_{f}") - F.avg(f"_f_{f}").over(at), F.stddev_pop(f"_f_{f}").over(at)), F.lit(0.0)) * sign) for f, sign in factors.items()}
    df = df.withColumns({f"_z_{f}": x for f, x in z.items()})
    parts = F.filter(F.array(*[F.struct((-F.abs(F.col(f"_z_{f}"))).alias("k"), F.lit(f).alias("factor"), F.col(f"_z_{f}").alias("z")) for f in factors]), lambda x: x["z"].isNotNull())
    mean = ratio(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["z"]), F.size(parts))
    why = F.transform(F.slice(F.array_sort(parts), 1, reasons), lambda x: F.struct(x["factor"].alias("factor"), F.round(x["z"], 3).alias("z")))
    return df.withColumns({"score": mean, "why": why}).select(*panel.columns, "score", "why")


def rank(panel: DataFrame, usable: DataFrame, factors: list[str], least: int = 5) -> DataFrame:
    """(symbol, ts, place, move, direction, why): the last row of each symbol, scored at once by the relative factors (REL)
    that measure_all found usable for either kind; plain ones move with the market and tell symbols apart by nothing else; best first by move (by direction where no factor serves move).

    Empty below `least` symbols or without a usable factor. The cross-section has a row a symbol."""
    last = panel.groupBy("symbol").agg(F.max_by(F.struct("ts", *factors), "ts").alias("x")).select("symbol", F.col("x.ts").alias("last"), *[f"x.`{f}`" for f in factors], F.lit(0).alias("ts"))
    signs = {(r.kind, r.factor): 1.0 if r.ic > 0 else -1.0 for r in usable.where(F.col("usable") & F.col("factor").endswith(REL)).select("kind", "factor", "ic").collect()}  # two rows a factor at most
    out, kinds = last.withColumn("_n", F.count("*").over(Window.partitionBy("ts"))), []
    for kind in ("move", "direction"):
        own = {f: v for (k, f), v in signs.items() if k == kind}
        if own:
            out = score(out, own, least).withColumnsRenamed({"score": kind, "why": f"_why_{kind}"})
            kinds.append(kind)
    if not kinds:
        return last.where("false").select("symbol", F.col("last").alias("ts"), F.lit(0).alias("place"), *[F.lit(None).cast("double").alias(k) for k in ("move", "direction")], F.array().cast("array<struct<factor:string,z:double>>").alias("why"))
    out = out.withColumns({k: F.lit(None).cast("double") for k in ("move", "direction") if k not in kinds}).where(F.col("_n") >= least)
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.col(kinds[0]).desc_nulls_last(), "symbol"))
    return out.select("symbol", F.col("last").alias("ts"), place.alias("place"), "move", "direction", F.col(f"_why_{kinds[0]}").alias("why"))



def composite(panel: DataFrame, factors: dict[str, float]) -> DataFrame:
    """panel with score: the mean of sign * cross-sectional z (sample deviation) over the factors that have one at ts."""
    at = Window.partitionBy("ts")
    z = {f"_z_{f}": ratio(F.col(f) - F.avg(f).over(at), F.stddev_samp(f).over(at)) * sign for f, sign in factors.items()}
    df = panel.withColumns(z)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in z), F.lit(0.0))
    used = sum((F.col(c).isNotNull().cast("int") for c in z), F.lit(0))
    return df.withColumn("score", ratio(total, used)).select(*panel.columns, "score")


def spread(panel: DataFrame, factors: dict[str, float], label: str, buckets: int = 3) -> DataFrame:
    """(bucket, n, mean): label means by bucket of the composite score's place at each ts, the first to come first on ties by symbol."""
    p = composite(panel.where(F.col(label).isNotNull()), factors).where("score IS NOT NULL")
    order, at = Window.partitionBy("ts").orderBy("score", "symbol"), Window.partitionBy("ts")
    place = F.row_number().over(order) / F.count("*").over(at)
    p = p.withColumn("bucket", F.least(F.floor(place * buckets), F.lit(buckets - 1)))
    return p.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(label).alias("mean"))
