"""What the most similar earlier windows were followed by, at every bar: a causal top-k similarity join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analog import windows

#: Windows of one side of a block pair.
BLOCK = 512


def neighbours(bars: DataFrame, length: int = 48, horizon: int = 24, k: int = 20) -> DataFrame:
    """(symbol, bar, ts, found): of every window, its k most correlated earlier windows of the symbol as (corr, outcome).

    A candidate ends max(horizon, length / 2) bars before the query at least and its outcome, the log return over `horizon`
    bars, is known. Windows of a symbol are numbered and dealt to blocks; each block meets the blocks up to its own, a pair
    is one matrix product that keeps k a query, and the k of all pairs of a query are merged. No task holds more than two
    blocks, and the work of a symbol is the square of its windows over two, in products of matrices. Ties go to the
    earlier window. Queries with fewer than k candidates have none."""
    gap = max(horizon, length // 2)
    w = windows(bars, length, horizon).select("symbol", "ts", (F.col("bar") - length).cast("long").alias("at"), "shape", F.element_at("path", -1).alias("outcome"), "bars")
    w = w.where(F.col("bars") >= length + horizon + k + 10).withColumn("block", F.floor(F.col("at") / BLOCK))
    last = F.floor((F.col("bars") - length) / BLOCK)
    query = w.where(F.col("at") >= gap).withColumns({"own": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("at") - gap) / BLOCK))), "query": F.lit(True)})
    cand = w.where("outcome IS NOT NULL").withColumns({"own": F.col("block"), "query": F.lit(False)})
    cand = cand.withColumn("block", F.explode(F.sequence(F.col("own"), last)))
    cols = ["symbol", "block", "own", "query", "ts", "at", "shape", "outcome"]
    schema = "symbol string, at long, ts long, found array<struct<corr:double,at:long,outcome:double>>"
    kind = pa.schema([("symbol", pa.string()), ("at", pa.int64()), ("ts", pa.int64()), ("found", pa.list_(pa.struct([("corr", pa.float64()), ("at", pa.int64()), ("outcome", pa.float64())])))])

    def pair(t: pa.Table) -> pa.Table:
        ask = t.column("query").to_numpy(zero_copy_only=False)
        q, c = t.filter(pa.array(ask)), t.filter(pa.array(~ask))
        rows = []
        if len(q) and len(c):
            shape = lambda x: x.column("shape").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            at, end, out = q.column("at").to_numpy(), c.column("at").to_numpy(), c.column("outcome").to_numpy()
            corr = shape(q) @ shape(c).T / length
            corr[end[None, :] > at[:, None] - gap] = -np.inf
            rank = np.argsort(end, kind="stable")
            for i, ts in enumerate(q.column("ts").to_numpy()):
                own = corr[i][rank]
                best = np.argsort(-own, kind="stable")[:k]
                best = best[own[best] > -np.inf]
                rows.append((int(at[i]), int(ts), [{"corr": float(own[j]), "at": int(end[rank[j]]), "outcome": float(out[rank[j]])} for j in best]))
        name = t.column("symbol")[0].as_py()
        return pa.table({"symbol": [name] * len(rows), "at": [r[0] for r in rows], "ts": [r[1] for r in rows], "found": [r[2] for r in rows]}, schema=kind)

    pairs = query.select(cols).unionByName(cand.select(cols)).groupBy("symbol", "block", "own").applyInArrow(pair, schema)
    # At most k a pair of blocks come together here.
    merged = pairs.groupBy("symbol", "at", "ts").agg(F.flatten(F.collect_list("found")).alias("found"))
    order = F.array_sort(F.transform("found", lambda x: F.struct((-x["corr"]).alias("less"), x["at"].alias("at"), x["outcome"].alias("outcome"))))
    top = F.transform(F.slice(order, 1, k), lambda x: F.struct((-x["less"]).alias("corr"), x["outcome"].alias("outcome")))
    return merged.where(F.size("found") >= k).select("symbol", (F.col("at") + length).alias("bar"), "ts", top.alias("found"))


#: Columns of `analog_features`.
COLUMNS = ("analog_median", "analog_mean", "analog_prob_up", "analog_spread", "analog_corr_max", "analog_corr_mean")


def analog_features(bars: DataFrame, length: int = 48, horizon: int = 24, k: int = 20) -> DataFrame:
    """(symbol, ts, COLUMNS) of every bar: median, mean, share of rises and spread of what followed its k nearest earlier
    windows, and their best and mean correlation; null where there are not k. Returns are squashed over 0.05."""
    n = neighbours(bars, length, horizon, k)
    out = F.transform("found", lambda x: x["outcome"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = n.withColumns({"o": F.array_sort(out), "c": F.transform("found", lambda x: x["corr"])}).withColumn("m", total(F.col("o")) / k)
    middle = (F.get("o", F.lit((k - 1) // 2)) + F.get("o", F.lit(k // 2))) / 2
    spread = F.sqrt(total(F.transform("o", lambda x: (x - F.col("m")) * (x - F.col("m")))) / max(k - 1, 1))
    figures = {
        "analog_median": F.tanh(middle / 0.05),
        "analog_mean": F.tanh(F.col("m") / 0.05),
        "analog_prob_up": F.size(F.filter("o", lambda x: x > 0)) / k * 2.0 - 1.0,
        "analog_spread": F.tanh(spread / 0.05),
        "analog_corr_max": F.array_max("c"),
        "analog_corr_mean": total(F.col("c")) / k,
    }
    n = n.select("symbol", "ts", *[x.alias(c) for c, x in figures.items()])
    return bars.select("symbol", "ts").join(n, ["symbol", "ts"], "left")
