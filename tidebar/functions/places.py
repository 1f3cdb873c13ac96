"""Places and exact quantiles of rows in a total order that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def places(rows: DataFrame, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """rows with place, the rows (or their weight) before each in its group by `by`, and total, those of the whole group.

    Rows are dealt to ranges of (by, order); each range sorts its own, and the sums of the ranges before it are one row a
    range and group. Rows alike in order may take any order; `by` must not be null."""
    w = F.col(weight) if weight else F.lit(1)
    d = kept(rows.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_places_part", F.spark_partition_id()))
    sums = d.groupBy(*by, "_places_part").agg(F.sum(w).alias("_places_sum"))
    group = Window.partitionBy(*by)
    ahead = F.sum("_places_sum").over(group.orderBy("_places_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumns({"_places_ahead": F.coalesce(ahead, F.lit(0)), "total": F.sum("_places_sum").over(group)}).drop("_places_sum")
    inside = F.sum(w).over(Window.partitionBy(*by, "_places_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return d.join(sums, [*by, "_places_part"]).withColumn("place", F.col("_places_ahead") + F.coalesce(inside, F.lit(0))).drop("_places_ahead", "_places_part")


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """(by, q, quantile) for each of probs: linear between the two nearest values. Equal values are counted before they
    are ordered, so a frequent one is a row; null values are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    p = places(counts, by, ["_v"], "_n")
    at = lambda x: x * (F.col("total") - 1)
    holds = lambda k: (k >= F.col("place")) & (k < F.col("place") + F.col("_n"))
    wanted = F.filter(F.array(*[F.lit(float(x)) for x in probs]), lambda x: holds(F.floor(at(x))) | holds(F.ceil(at(x))))
    e = p.select(*by, "_v", "place", "_n", "total", F.explode(wanted).alias("q"))
    low, high = F.floor(at(F.col("q"))), F.ceil(at(F.col("q")))
    g = e.groupBy(*by, "q").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_lo"), F.max(F.when(holds(high), F.col("_v"))).alias("_hi"), F.first(at(F.col("q")) - low).alias("_d"))
    return g.select(*by, "q", (F.col("_lo") + F.col("_d") * (F.col("_hi") - F.col("_lo"))).alias("quantile"))
