"""Where a scenario's conditions held: masks over bars for analog search, loosened step by step where too few are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from .context import regime
from .events import asof

#: Bars after an event that still count as its time; candidates that a condition must leave.
LAG, LEAST = 2, 60


def mask(bars: DataFrame, events: DataFrame | None = None, volatility: int | None = None, trend: int | None = None, lag: int = LAG, least: int = LEAST) -> DataFrame:
    """(symbol, ts, event, regime, mask, applied): whether each bar lies within `lag` bars of an event (symbol, ts) and in the
    wanted regime, and what is asked for in the end.

    applied, for each symbol: both, where that leaves `least` bars; else event alone; else regime alone; else none, where
    every bar will do. Without events or a regime that condition always holds; events without any in a symbol's past are
    no condition there. Bars whose regime is unknown are in none."""
    df = bars
    if volatility is not None or trend is not None:
        wanted = [F.col(c) == float(v) for c, v in (("volatility", volatility), ("trend", trend)) if v is not None]
        held = wanted[0] if len(wanted) == 1 else wanted[0] & wanted[1]
        df = regime(bars).withColumn("regime", F.coalesce(held, F.lit(False)))
    else:
        df = df.withColumn("regime", F.lit(True))
    if events is not None:
        at = asof(events.select("symbol", "ts").distinct(), bars.withColumn("_bar", F.col("ts")), "_bar", forward=True, out="bar")
        at = at.where("bar IS NOT NULL").select("symbol", F.col("bar").alias("ts"), F.lit(1).alias("_hit")).distinct()
        df = df.join(at, ["symbol", "ts"], "left").withColumn("_near", F.coalesce(F.max("_hit").over(s.rows(lag + 1)), F.lit(0)) == 1)
        any_ = F.max("_hit").over(Window.partitionBy("symbol")).isNotNull()
        df = df.withColumn("event", F.col("_near") | ~any_)
    else:
        df = df.withColumn("event", F.lit(True))
    n = lambda c: F.count_if(c).over(Window.partitionBy("symbol"))
    both, event, held = n(F.col("event") & F.col("regime")), n(F.col("event")), n(F.col("regime"))
    step = F.when(both >= least, "both").when(F.lit(events is not None) & (event >= least), "event").when(F.lit(volatility is not None or trend is not None) & (held >= least), "regime").otherwise("none")
    df = df.withColumn("applied", step)
    chosen = F.when(F.col("applied") == "both", F.col("event") & F.col("regime")).when(F.col("applied") == "event", F.col("event")).when(F.col("applied") == "regime", F.col("regime")).otherwise(True)
    return df.select("symbol", "ts", "event", "regime", chosen.alias("mask"), "applied")
