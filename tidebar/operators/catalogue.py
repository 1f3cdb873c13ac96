"""Symbol search, recurring calendar events, macro changes and as-of cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def match(symbols: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """symbols (symbol, place) that match text, best first: equal to it whole or after a dash or slash, then beginning
    with it, then holding it; ties by place in the catalogue. The limit is the feature: a top list."""
    q = text.strip().upper()
    name = F.upper("symbol")
    grade = F.when((name == q) | F.array_contains(F.split(name, "[-/]"), q), 0).when(name.startswith(q), 1).when(name.contains(q), 2)
    return symbols.withColumn("grade", grade).where("grade IS NOT NULL").orderBy("grade", "place").limit(limit)


def recurring(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(ts, kind, title) of month starts and ends, third Fridays, quarter ends and their last Fridays, within two dates."""
    days = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("first"))
    third = F.date_add(F.next_day(F.date_sub("first", 1), "FRI"), 14)
    last = F.last_day("first")
    last_friday = F.date_sub(F.next_day(last, "FRI"), 7)
    quarter = F.month("first") % 3 == 0
    events = F.array(
        F.struct(F.col("first").alias("d"), F.lit("month-start").alias("title")),
        F.struct(last.alias("d"), F.lit("month-end").alias("title")),
        F.struct(third.alias("d"), F.lit("third-friday").alias("title")),
        F.when(quarter, F.struct(last.alias("d"), F.lit("quarter-end").alias("title"))),
        F.when(quarter, F.struct(last_friday.alias("d"), F.lit("quarter-expiry").alias("title"))),
    )
    rows = days.select(F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e"))
    return rows.where(F.col("e.d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select((F.unix_date("e.d").cast("long") * DAY).alias("ts"), F.lit("calendar").alias("kind"), "e.title")


def changes(series: DataFrame, threshold: float) -> DataFrame:
    """(symbol, ts, change, severity) where a series (symbol, ts, value) moves by the threshold or more from its last value."""
    d = series.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("symbol").orderBy("ts")))
    return d.where(F.abs("change") >= threshold).select("symbol", "ts", "change", F.least(F.lit(1.0), F.abs("change") / (4 * threshold)).alias("severity"))


def cut(bars: DataFrame, origins: DataFrame) -> DataFrame:
    """bars once for each origin of their symbol that they precede or meet: what was known then.

    origins (symbol, origin) is small for each symbol; its rows travel as an array beside the bars, not as a range join."""
    o = origins.groupBy("symbol").agg(F.collect_set("origin").alias("_o"))
    return bars.join(o, "symbol").withColumn("origin", F.explode(F.filter("_o", lambda x: x >= F.col("ts")))).drop("_o")
