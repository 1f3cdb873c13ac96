"""Candle frames: typed rows, duplicates, checks of the contract, coarser bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import floor_ts


def to_frame(rows: DataFrame, arrival: str = "seq") -> DataFrame:
    """Rows with the candle types (what cannot be read is null) and, of a symbol's rows at one ts, the last to arrive."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    last = Window.partitionBy("symbol", "ts").orderBy(F.desc(arrival))
    typed = rows.select("symbol", F.col("ts").try_cast("long").alias("ts"), *[number(c) for c in ("open", "high", "low", "close", "volume")], "closed", arrival)
    return typed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", arrival)


def upsert(bars: DataFrame, new: DataFrame) -> DataFrame:
    """bars with new rows added, those of the same symbol and ts replaced."""
    return to_frame(bars.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1))))


def closed_only(bars: DataFrame) -> DataFrame:
    return bars.where("closed")


def resample(bars: DataFrame, step: int) -> DataFrame:
    """Bars on a coarser grid from the epoch; buckets without bars stay missing."""
    at = "ts"
    return (
        bars.groupBy("symbol", floor_ts(at, step).alias("bucket"))
        .agg(
            F.expr("min_by(open, ts) FILTER (WHERE open IS NOT NULL)").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.expr("max_by(close, ts) FILTER (WHERE close IS NOT NULL)").alias("close"),
            F.sum("volume").alias("volume"),
            F.max_by("closed", at).alias("closed"),
        )
        .withColumnRenamed("bucket", "ts")
    )


def validate(bars: DataFrame, step: int) -> DataFrame:
    """(symbol, rule, violations) for each rule of the contract that a symbol breaks."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumns({"_next": F.lead("ts").over(w)})
    rules = {
        "duplicate_ts": F.col("_next") == F.col("ts"),
        "high_below_low": F.col("high") < F.col("low"),
        "open_outside": (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")),
        "close_outside": (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")),
        "negative_volume": F.col("volume") < 0,
        "open_bar_before_last": ~F.col("closed") & F.col("_next").isNotNull(),
        "off_grid": F.pmod("ts", F.lit(step)) != 0,
    }
    counts = b.groupBy("symbol").agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in rules.items()])
    return counts.unpivot("symbol", list(rules), "rule", "violations").where("violations > 0")


def overlay(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Bars of both, one a symbol and ts: the local one where both have it."""
    both = local.select(*remote.columns, F.lit(1).alias("_place")).unionByName(remote.withColumn("_place", F.lit(0)))
    row = F.max_by(F.struct(*[c for c in remote.columns if c not in ("symbol", "ts")]), "_place")
    return both.groupBy("symbol", "ts").agg(row.alias("_x")).select("symbol", "ts", "_x.*").select(*remote.columns)
