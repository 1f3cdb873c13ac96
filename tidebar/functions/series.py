"""Column builders over one symbol's bars in time order: rolling, lagged and cumulative values.

All take a column of a frame keyed (symbol, ts). A window of n bars has a value only when it holds n values; undefined
is null, never NaN. Every builder uses the same partitioning and order, so a plan of any number of them shuffles and
sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def past():
    """A symbol's bars in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(n: int):
    return past().rowsBetween(-(n - 1), 0)


def full(agg: Column, x: Column | str, n: int) -> Column:
    return F.when(F.count(col(x)).over(rows(n)) == n, agg.over(rows(n)))


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(past())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(col(x), n).over(past())


def running(x: Column | str) -> Column:
    return F.sum(col(x)).over(past().rowsBetween(Window.unboundedPreceding, 0))


def sma(x: Column | str, n: int) -> Column:
    return full(F.avg(col(x)), x, n)


def stdev(x: Column | str, n: int) -> Column:
    return full(F.stddev_pop(col(x)), x, n)


def rolling_max(x: Column | str, n: int) -> Column:
    return full(F.max(col(x)), x, n)


def rolling_min(x: Column | str, n: int) -> Column:
    return full(F.min(col(x)), x, n)


def rolling_sum(x: Column | str, n: int) -> Column:
    return full(F.sum(col(x)), x, n)


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("bar", F.row_number().over(past()).cast("double"))


def wma(x: Column | str, n: int) -> Column:
    """Weights 1 to n, newest heaviest; needs the column `bar` of numbered()."""
    x = col(x)
    weighted = F.sum(x * F.col("bar")).over(rows(n)) - (F.col("bar") - n) * F.sum(x).over(rows(n))
    return F.when(F.count(x).over(rows(n)) == n, weighted / (n * (n + 1) / 2))


def linreg_end(x: Column | str, n: int) -> Column:
    """Fitted value at the last bar of a least-squares line through n bars; needs `bar`."""
    x = col(x)
    line = F.regr_intercept(x, F.col("bar")).over(rows(n)) + F.regr_slope(x, F.col("bar")).over(rows(n)) * F.col("bar")
    return F.when(F.count(x).over(rows(n)) == n, line)


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rolling_rank(x: Column | str, n: int, least: int) -> Column:
    """Share of the n - 1 bars before that lie strictly below this one, once the window holds `least` values; 0 if this one is null."""
    x, window = col(x), rows(n)
    below = F.size(F.filter(F.collect_list(x).over(past().rowsBetween(-(n - 1), -1)), lambda v: v < x))
    return F.when(F.count(x).over(window) >= least, F.coalesce(F.try_divide(F.greatest(below, F.lit(0)).cast("double"), (F.count("*").over(window) - 1).cast("double")), F.lit(0.0)))


def relative_z(x: Column | str, n: int = 120, least: int = 60) -> Column:
    """Standard score within the last n bars, from `least` values on; null where they do not vary."""
    x = col(x)
    z = F.try_divide(x - F.avg(x).over(rows(n)), F.nullif(F.stddev_pop(x).over(rows(n)), F.lit(0.0)))
    return F.when(F.count(x).over(rows(n)) >= least, z)


def crossed_up(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.coalesce((a > b) & (lag(a) <= lag(b)), F.lit(False))


def avg_rank(x: Column | str, *by: str) -> Column:
    """Rank with ties averaged within a group."""
    x = col(x)
    w, same = Window.partitionBy(*by), Window.partitionBy(*by, x)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(same) - 1) / 2.0


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, b)
