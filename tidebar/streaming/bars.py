"""Streams: bars of ticks by watermark, exact bars by arrival, and alerts that fire once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TICK = "symbol string, ts long, price double, volume double, seq long"
BAR = "symbol string, ts long, open double, high double, low double, close double, volume double, closed boolean"


def tumbling(ticks: DataFrame, step_ms: int, late: str = "1 hour") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, price, volume, seq) by event time; ticks later than `late` are dropped."""
    t = ticks.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    order = F.struct("ts", "seq")
    g = t.groupBy("symbol", F.window("at", f"{step_ms} milliseconds").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )
    return g.select("symbol", F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume", F.lit(True).alias("closed"))


def fold_ticks(bar: tuple | None, ticks: pd.DataFrame, step: int) -> tuple[tuple | None, pd.DataFrame]:
    """(forming bar, bars to emit) after ticks (ts, price, volume) in order of arrival: each updates the forming bar, or
    closes it and opens the next; ticks of an older bar are dropped."""
    names = ["ts", "open", "high", "low", "close", "volume"]
    at = ticks["ts"] - ticks["ts"] % step
    newest = at.cummax() if bar is None else at.cummax().clip(lower=bar[0])
    t = ticks.assign(at=at)[at == newest]
    if t.empty:
        return bar, pd.DataFrame(columns=[*names, "closed"])
    rows = pd.DataFrame({"ts": t["at"], "open": t["price"], "high": t["price"], "low": t["price"], "close": t["price"], "volume": t["volume"]})
    if bar is not None:  # the forming bar goes ahead of its own ticks
        rows = pd.concat([pd.DataFrame([bar], columns=names), rows], ignore_index=True)
    g = rows.groupby("ts", sort=False)
    rows = rows.assign(open=g["open"].transform("first"), high=g["high"].cummax(), low=g["low"].cummin(), volume=g["volume"].cumsum()).reset_index(drop=True)
    last = (rows["ts"] != rows["ts"].shift(-1)) & (rows.index < len(rows) - 1)
    out = rows.assign(closed=False, _o=rows.index)
    out = pd.concat([out[1 if bar is not None else 0 :], rows[last].assign(closed=True, _o=rows.index[last] + 0.5)]).sort_values("_o")
    return tuple(rows.iloc[-1][names].tolist()), out[[*names, "closed"]]


def exact(ticks: DataFrame, step_ms: int) -> DataFrame:
    """Every update of every symbol's forming bar, in order of arrival (`seq`, within a batch of the stream); the only state
    is the forming bar. A symbol's ticks of one batch come together, so the source's batch size bounds them."""

    def step(key, batches, state):
        t = pd.concat(list(batches)).sort_values("seq", kind="stable")
        bar, out = fold_ticks(state.get if state.exists else None, t, step_ms)
        if bar is not None:
            state.update((int(bar[0]), *(float(x) for x in bar[1:])))
        out.insert(0, "symbol", key[0])
        yield out.astype({"ts": "int64", "closed": bool})

    kept = "ts long, open double, high double, low double, close double, volume double"
    return ticks.groupBy("symbol").applyInPandasWithState(step, BAR, kept, "append", "NoTimeout")


def touched(kind, price, low, high):
    """Whether a rule's price is met: below kinds by the low, above kinds by the high."""
    return F.when(kind.isin("buy_below", "stop_below"), low <= price).otherwise(high >= price)


def alerts(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, symbol, ts, price) when a stream of bars first meets an active rule; each rule fires once."""
    hit = bars.join(rules.where("active").select(F.col("id").alias("rule_id"), "symbol", "kind", F.col("price").alias("level")), "symbol")
    hit = hit.where(touched(F.col("kind"), F.col("level"), F.col("low"), F.col("high")))

    def once(key, batches, state):
        rows = pd.concat(list(batches))
        if state.exists or rows.empty:
            return
        state.update((True,))
        first = rows.sort_values("ts").iloc[0]
        yield pd.DataFrame({"rule_id": [key[0]], "symbol": [first["symbol"]], "ts": [int(first["ts"])], "price": [float(first["level"])]})

    return hit.select("rule_id", "symbol", "ts", "level").groupBy("rule_id").applyInPandasWithState(once, "rule_id string, symbol string, ts long, price double", "fired boolean", "append", "NoTimeout")
