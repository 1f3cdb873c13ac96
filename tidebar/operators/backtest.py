"""Backtests of a decision column: filled at the next bar's open, as windows without a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import past, ratio

FEE, SLIPPAGE = 0.0005, 0.0005


def positions(bars: DataFrame, decision: str, allow_short: bool = True, warmup: int = 120) -> DataFrame:
    """bars with pos, what the decision of the bar before holds (0 in the warm-up), and trade, the number of its holding."""
    d = F.coalesce(F.col(decision).cast("int"), F.lit(0))
    d = d if allow_short else F.greatest(d, F.lit(0))
    df = bars.withColumn("_n", F.row_number().over(past()) - 1).withColumn("_d", F.when(F.col("_n") >= warmup, d).otherwise(0))
    df = df.withColumn("pos", F.coalesce(s.lag("_d"), F.lit(0)))
    turn = (F.col("pos") != F.coalesce(s.lag("pos"), F.lit(0))).cast("int")
    return df.withColumn("_t", turn).withColumn("trade", s.running("_t")).drop("_n", "_d", "_t")


def trades(held: DataFrame, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """(symbol, trade, direction, entry_ts, exit_ts, entry, exit, ret, bars held) of positions(): in at the open of its first bar, out
    at the open of the bar after its last, or at the last close; ret is net of fee and slippage at both ends."""
    df = held.withColumns({"_next_open": s.lead("open"), "_next_ts": s.lead("ts"), "_i": F.row_number().over(past())})
    t = (
        df.where("pos <> 0")
        .groupBy("symbol", "trade")
        .agg(
            F.first("pos").alias("direction"),
            F.min("ts").alias("entry_ts"),
            F.min_by("open", "ts").alias("entry"),
            F.min("_i").alias("_from"),
            F.max_by(F.struct(F.coalesce("_next_open", "close").alias("p"), F.coalesce("_next_ts", "ts").alias("t"), (F.col("_i") + F.col("_next_open").isNotNull().cast("int")).alias("i")), "ts").alias("x"),
        )
    )
    ret = F.col("direction") * (ratio(F.col("x.p"), F.col("entry")) - 1) - 2 * (fee + slippage)
    return t.select("symbol", "trade", "direction", "entry_ts", F.col("x.t").alias("exit_ts"), "entry", F.col("x.p").alias("exit"), ret.alias("ret"), (F.col("x.i") - F.col("_from")).cast("long").alias("bars"))


def equity(held: DataFrame) -> DataFrame:
    """held with step, the bar's return at its position, and equity, the running product of 1 + step. Costs are in trades alone."""
    df = held.withColumn("step", F.coalesce(F.col("pos") * (ratio(F.col("close"), s.lag("close")) - 1), F.lit(0.0)))
    return df.withColumn("equity", F.product(1 + F.col("step")).over(past().rowsBetween(Window.unboundedPreceding, 0)))


def metrics(held: DataFrame, fee: float = FEE, slippage: float = SLIPPAGE, warmup: int = 120) -> DataFrame:
    """A row per symbol: trades, win_rate, avg_win, avg_loss (0 without any), payoff, profit_factor (null without a loss),
    total_return, max_drawdown, sharpe of the steps between bars, and buy_hold from the end of the warm-up. A loss is ret <= 0.

    A symbol of warmup + 2 bars or fewer has no result: no trades, 0 and null."""
    e = equity(held).withColumn("_i", F.row_number().over(past()))
    e = e.withColumn("_peak", F.max("equity").over(past().rowsBetween(Window.unboundedPreceding, 0)))
    by_bar = e.groupBy("symbol").agg(
        (F.max_by("equity", "ts") - 1).alias("total_return"),
        F.min(F.col("equity") / F.col("_peak") - 1).alias("max_drawdown"),
        (ratio(F.avg(F.when(F.col("_i") > 1, F.col("step"))), F.stddev_samp(F.when(F.col("_i") > 1, F.col("step")))) * F.sqrt(F.lit(365.0))).alias("sharpe"),
        (ratio(F.max_by("close", "ts"), F.max(F.when(F.col("_i") == warmup + 1, F.col("close")))) - 1).alias("buy_hold"),
        (F.count("*") > warmup + 2).alias("_long"),
    )
    by_bar = by_bar.select("symbol", "_long", *[F.when(F.col("_long"), F.col(c)).otherwise(0.0).alias(c) for c in ("total_return", "max_drawdown", "buy_hold")], F.when(F.col("_long"), F.col("sharpe")).alias("sharpe"))
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") <= 0, F.col("ret"))
    by_trade = trades(held, fee, slippage).groupBy("symbol").agg(
        F.count("*").alias("trades"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), ratio(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"), ratio(F.avg(win), F.abs(F.avg(loss))).alias("payoff")
    )
    out = by_bar.join(by_trade, "symbol", "left")
    none = {c: F.when(F.col("_long"), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("win_rate", "avg_win", "avg_loss")}
    gone = {c: F.when(F.col("_long"), F.col(c)) for c in ("payoff", "profit_factor")}
    return out.withColumns(none | gone | {"trades": F.when(F.col("_long"), F.coalesce("trades", F.lit(0))).otherwise(0).cast("long")}).drop("_long")
