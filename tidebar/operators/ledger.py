"""Recommendations, alerts and positions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.places import places
from ..functions.series import ratio


def pick(forecasts: DataFrame, k: int = 3) -> DataFrame:
    """forecasts (ts, symbol, expected) with side: buy for the k best, avoid for the k worst at each ts."""
    best = Window.partitionBy("ts").orderBy(F.desc("expected"), "symbol")
    worst = Window.partitionBy("ts").orderBy("expected", "symbol")
    df = forecasts.where("expected IS NOT NULL").withColumns({"_b": F.row_number().over(best), "_w": F.row_number().over(worst)})
    return df.withColumn("side", F.when(F.col("_b") <= k, "buy").when(F.col("_w") <= k, "avoid")).where("side IS NOT NULL").drop("_b", "_w")


def confidence(moves: DataFrame, move: str = "move") -> DataFrame:
    """moves with confidence: low (below the first third of |move| at ts), high (above the second) or mid; mid below three values."""
    at = Window.partitionBy("ts")
    x = F.abs(move)
    df = moves.withColumns({"_lo": F.percentile(x, F.lit(1 / 3)).over(at), "_hi": F.percentile(x, F.lit(2 / 3)).over(at), "_n": F.count(move).over(at)})
    label = F.when((F.col("_n") < 3) | F.col(move).isNull(), "mid").when(x < F.col("_lo"), "low").when(x > F.col("_hi"), "high").otherwise("mid")
    return df.withColumn("confidence", label).drop("_lo", "_hi", "_n")


def settle(picks: DataFrame, bars: DataFrame, days: int, done: DataFrame | None = None) -> DataFrame:
    """(ts, buy, avoid, universe, edge): mean return over `days` bars of what was picked at ts; days already in done are left out."""
    fut = bars.select("symbol", "ts", (ratio(s.lead("close", days), F.col("close")) - 1).alias("ret"))
    every = fut.groupBy("ts").agg(F.avg("ret").alias("universe"))
    got = picks.select("ts", "symbol", "side").join(fut, ["ts", "symbol"]).where("ret IS NOT NULL")
    by = got.groupBy("ts").agg(F.avg(F.when(F.col("side") == "buy", F.col("ret"))).alias("buy"), F.avg(F.when(F.col("side") == "avoid", F.col("ret"))).alias("avoid"))
    out = by.join(every, "ts").withColumn("edge", F.col("buy") - F.col("universe"))
    return out if done is None else out.join(done.select("ts").distinct(), "ts", "left_anti")


def followup(fired: DataFrame, bars: DataFrame, steps=(1, 3, 7)) -> DataFrame:
    """fired (symbol, ts, price) with the change from price at the 1st, 3rd and 7th bar after the one that holds ts."""
    from .events import asof

    cols = F.struct(*[s.lead("close", n).alias(f"c{n}") for n in steps])
    ahead = bars.withColumn("x", cols)
    got = asof(fired, ahead, "x", out="_x")
    return got.withColumns({f"change_{n}": ratio(F.col(f"_x.c{n}"), F.col("price")) - 1 for n in steps}).drop("_x")


#: Share sold at a first target; multiples of ATR for the stop and both targets; least edge of a target over the entry.
FIRST_PORTION, ATR_STOP, ATR_FIRST, ATR_SECOND, MIN_EDGE = 0.5, 1.5, 1.5, 3.0, 0.002


def _plan(entries: DataFrame, stop: Column, first: Column, second: Column, given: Column) -> DataFrame:
    """entries with stop, targets (price, portion) and risk_pct; null where no stop below the entry or no target is given."""
    e = F.col("entry")
    far = lambda x, part: F.when(x > e * (1 + MIN_EDGE), F.struct(F.round(x, 8).alias("price"), F.lit(part).alias("portion")))
    some = F.filter(F.array(far(first, FIRST_PORTION), far(second, 1 - FIRST_PORTION)), lambda x: x.isNotNull())
    alone = F.transform("_t", lambda x: F.struct(x["price"].alias("price"), F.lit(1.0).alias("portion")))
    df = entries.withColumns({"_t": some, "_s": F.when(given, stop)})
    ok = (F.col("_s") < e) & (F.size("_t") > 0)
    out = {"stop": F.round("_s", 8), "targets": F.when(F.size("_t") == 1, alone).otherwise(F.col("_t")), "risk_pct": F.round((1 - F.col("_s") / e) * 100, 2)}
    return df.withColumns({k: F.when(ok, x) for k, x in out.items()}).drop("_t", "_s")


def plan_from_band(entries: DataFrame) -> DataFrame:
    """entries (entry, low, high, expected in percent) with a plan: stop at the lower end of the band, half out at the expected
    price, half at the upper end. No plan without a lower end below the entry or a target; targets of one price both stay."""
    at = lambda c: F.col("entry") * (1 + F.coalesce(F.col(c), F.lit(0.0)) / 100)
    return _plan(entries, at("low"), at("expected"), at("high"), F.col("low") < 0)


def plan_from_atr(entries: DataFrame) -> DataFrame:
    """entries (entry, atr_pct, ATR over price) with a plan of 1.5 ATR down, 1.5 and 3 up; none without a positive ATR."""
    at = lambda n: F.col("entry") * (1 + n * F.col("atr_pct"))
    return _plan(entries, at(-ATR_STOP), at(ATR_FIRST), at(ATR_SECOND), F.col("atr_pct") > 0)


def trail_to(entry: Column, targets: Column, hit: Column) -> Column:
    """Where the stop goes when a target at price `hit` is met unsold: the entry, or the highest target met below it."""
    met = F.filter(targets, lambda t: t["hit_at"].isNotNull() & (t["price"] < hit))
    return F.greatest(entry, F.array_max(F.transform(met, lambda t: t["price"])))


def record(positions: DataFrame) -> DataFrame:
    """(currency, n, realized, avg_pct, wins) of closed positions; currencies are never added together."""
    c = positions.where("status = 'closed'")
    pct = 100 * ratio(F.col("realized"), F.col("entry") * F.col("shares"))
    return c.groupBy("currency").agg(F.count("*").alias("n"), F.sum("realized").alias("realized"), F.avg(pct).alias("avg_pct"), F.count_if(F.col("realized") > 0).alias("wins"))


def splits(verdicts: DataFrame, condition: str, hit: str, least: int = 30) -> DataFrame:
    """(bucket, n, rate, delta): hit rate by thirds of a condition (first to come first on ties), against the whole."""
    v = places(verdicts.where(F.col(condition).isNotNull()).select("symbol", "ts", F.col(condition).alias("_c"), F.col(hit).alias("_hit")), [], ["_c", "symbol", "ts"])
    cut = lambda k: k * (F.col("total") - 1) / 3
    bucket = F.when(F.col("place") <= cut(1), 0).when(F.col("place") <= cut(2), 1).otherwise(2)
    per = v.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("_hit").alias("rate")).where(F.col("n") >= least)
    return per.join(F.broadcast(v.agg(F.avg("_hit").alias("_all")))).select("bucket", "n", "rate", (F.col("rate") - F.col("_all")).alias("delta"))
