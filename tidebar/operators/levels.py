"""Price levels of a symbol's whole history: volume profile, retracements of the last leg, support and resistance.

They look at all bars, so none of them is causal. Each reduces a symbol to a few numbers by grouped sums, and joins those
back to its bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import compute, indicator

# The ratios of the levels.
RETRACEMENTS, EXTENSIONS = (0.236, 0.382, 0.5, 0.618, 0.786), (1.272, 1.618, 2.618)
SLOTS = 6


@indicator("volume_profile", "volume", "poc vah val", causal=False, bins=60, lookback=0, area=0.7)
def volume_profile(df, bins, lookback, area):
    """Centre of the price bin of most volume and the edges of the bins around it that hold `area` of the volume.

    A bar's volume lies evenly on its range; bars without range or volume add nothing. Ties go to the lower bin, and
    the area grows upwards on a tie. Null below two bars."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    used = df.withColumn("_k", back).where(F.col("_k") <= lookback) if lookback else df
    span = used.groupBy("symbol").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("k")).where("b > a AND k > 1")
    width = (F.col("b") - F.col("a")) / bins
    at = lambda x: F.least(F.greatest(F.floor((x - F.col("a")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    part = used.where("high > low AND volume > 0").join(span, "symbol").withColumn("bin", F.explode(F.sequence(at(F.col("low")), at(F.col("high")))))
    lower = F.col("a") + F.col("bin") * width
    overlap = F.greatest(F.least(lower + width, F.col("high")) - F.greatest(lower, F.col("low")), F.lit(0.0))
    w = part.groupBy("symbol", "bin").agg(F.sum(F.col("volume") * overlap / (F.col("high") - F.col("low"))).alias("w"))
    per = w.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("m"), F.sum("w").alias("all")).join(span, "symbol")
    per = per.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))))
    per = per.withColumn("p", (F.array_position("v", F.array_max("v")) - 1).cast("int"))
    start = F.struct(F.col("p").alias("lo"), F.col("p").alias("hi"), F.get("v", F.col("p")).alias("got"))

    def grow(st, _):
        below = F.when(st["lo"] > 0, F.get("v", st["lo"] - 1)).otherwise(-1.0)
        above = F.when(st["hi"] < bins - 1, F.get("v", st["hi"] + 1)).otherwise(-1.0)
        up, open_ = above >= below, (st["got"] < area * F.col("all")) & ((st["lo"] > 0) | (st["hi"] < bins - 1))
        return F.when(~open_, st).when(up, F.struct(st["lo"].alias("lo"), (st["hi"] + 1).alias("hi"), (st["got"] + above).alias("got"))).otherwise(F.struct((st["lo"] - 1).alias("lo"), st["hi"].alias("hi"), (st["got"] + below).alias("got")))

    per = per.withColumn("x", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow))
    per = per.select("symbol", (F.col("a") + (F.col("p") + 0.5) * width).alias("poc"), (F.col("a") + (F.col("x.hi") + 1) * width).alias("vah"), (F.col("a") + F.col("x.lo") * width).alias("val"))
    return df.join(per, "symbol", "left")


def _swings(df: DataFrame, left: int, right: int) -> DataFrame:
    """(symbol, ts, price, high) of every swing."""
    w = compute(df, "swings", left=left, right=right)
    both = F.array(F.struct(F.col("swing_high").alias("price"), F.lit(True).alias("high")), F.struct(F.col("swing_low").alias("price"), F.lit(False).alias("high")))
    return w.select("symbol", "ts", F.explode(both).alias("x")).where("x.price IS NOT NULL").select("symbol", "ts", "x.price", "x.high")


def _name(prefix: str, r: float) -> str:
    return f"{prefix}{int(r * 1000):04d}"


@indicator("fibonacci", "levels", " ".join(["start", "end", *(_name("r", r) for r in RETRACEMENTS), *(_name("e", r) for r in EXTENSIONS)]), causal=False, left=5, right=5)
def fibonacci(df, left, right):
    """Levels of the leg from the last swing of the other kind to the last swing, on the bars from the leg's start on."""
    sw = _swings(df, left, right)
    last = sw.groupBy("symbol").agg(F.max(F.when(F.col("high"), F.struct("ts", "price"))).alias("h"), F.max(F.when(~F.col("high"), F.struct("ts", "price"))).alias("l")).where("h IS NOT NULL AND l IS NOT NULL")
    rising = F.col("h.ts") > F.col("l.ts")
    leg = last.select("symbol", F.when(rising, F.col("l")).otherwise(F.col("h")).alias("a"), F.when(rising, F.col("h")).otherwise(F.col("l")).alias("b")).where("a.price <> b.price")
    a, b = F.col("a.price"), F.col("b.price")
    out = {"start": a, "end": b} | {_name("r", r): b - r * (b - a) for r in RETRACEMENTS} | {_name("e", r): a + r * (b - a) for r in EXTENSIONS}
    df = df.join(leg, "symbol", "left")
    return df.withColumns({k: F.when(F.col("ts") >= F.col("a.ts"), v) for k, v in out.items()})


@indicator("support_resistance", "levels", " ".join(f"level{i + 1}" for i in range(SLOTS)), causal=False, left=5, right=5, tolerance=0.5)
def support_resistance(df, left, right, tolerance):
    """Means of clusters of swing prices, most hit first, then nearest to the last close. A price joins a cluster within
    `tolerance` percent of the cluster's lowest price."""
    prices = _swings(df, left, right).groupBy("symbol").agg(F.array_sort(F.collect_list("price")).alias("p"))
    close = df.groupBy("symbol").agg(F.max_by("close", "ts").alias("c"))
    kind = "array<struct<anchor:double,total:double,n:bigint>>"

    def add(acc, x):
        top = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (top["anchor"] > 0) & (F.abs(x - top["anchor"]) / top["anchor"] <= tolerance / 100)
        one = F.struct(x.alias("anchor"), x.alias("total"), F.lit(1).cast("bigint").alias("n"))
        more = F.struct(top["anchor"].alias("anchor"), (top["total"] + x).alias("total"), (top["n"] + 1).alias("n"))
        return F.when(F.size(acc) == 0, F.array(one)).when(joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), more)).otherwise(F.array_append(acc, one))

    per = prices.join(close, "symbol").withColumn("k", F.aggregate("p", F.array().cast(kind), add))
    mean = F.transform("k", lambda x: F.struct((-x["n"]).alias("n"), F.abs(x["total"] / x["n"] - F.col("c")).alias("far"), (x["total"] / x["n"]).alias("m")))
    per = per.select("symbol", F.array_sort(mean).alias("k"))
    return df.join(per.select("symbol", *[F.get("k", F.lit(i))["m"].alias(f"level{i + 1}") for i in range(SLOTS)]), "symbol", "left")
