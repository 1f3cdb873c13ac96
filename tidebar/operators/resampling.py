"""Resampling of dependent series: block lengths, block bootstraps and searches repeated under the null."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import places, quantiles
from ..functions.series import ratio
from ..sources.shared import kept

#: Rows of a part of a series at least; shorter series get a quarter of their length as block.
PART, SHORT = 8192, 50


def _numbered(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, place, total, x) of the rows whose value is finite."""
    x = F.col(value).cast("double")
    some = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*by, *order, x.alias("x"))
    return places(some, by, order).select(*by, "place", "total", "x")


def _lags(n: int) -> tuple[int, int]:
    """Lags whose autocovariance may count, and how many small ones in a row end the search."""
    run = max(5, int(math.log10(n)))
    return int(math.ceil(math.sqrt(n))) + run, run


def optimal_block(n: int, cov: np.ndarray, cor: np.ndarray) -> float:
    """Politis and White's length (2004, corrected 2009) for circular blocks, from autocovariances and correlations by lag.

    The first run of lags whose correlations are all within 2 sqrt(log10 n / n) ends the search; twice the lag before it
    is the width of the flat-top window, which weighs its first half fully and the rest linearly down to 0."""
    most, run = _lags(n)
    cut, last = 2 * math.sqrt(math.log10(n) / n), None
    for i in range(run, most + 1):
        if (cor[i - run : i] < cut).all():
            last = i - run
            break
    width = most if last is None else min(2 * max(last, 1), most)
    k = np.arange(1, width + 1)
    flat = np.minimum(1.0, 2 * (1 - k / width))
    slope, spectrum = 2 * float(flat @ (k * cov[1 : width + 1])), cov[0] + 2 * float(flat @ cov[1 : width + 1])
    if not spectrum:
        return 1.0
    best = (1.5 * slope * slope / spectrum**2) ** (1 / 3) * n ** (1 / 3)
    return min(best, math.ceil(min(3 * math.sqrt(n), n / 3)))


def pick_block(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, n, block) of every series: `optimal_block`, rounded, 1 to a quarter of the series; that quarter below SHORT
    values, and 1 where all are alike. Null and infinite values are left out; keys must not be null.

    A series goes on in parts of PART rows or more, each with the rows that follow it as far as the lags reach; the sums of
    all lags come from one pass over a part, and only they, a row a part, meet by series."""
    if not by:
        return pick_block(rows.withColumn("_all", F.lit(0)), ["_all"], order, value).drop("_all")
    p = _numbered(rows, by, order, value)
    stats = p.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("top"), F.min("x").alias("low"))
    far = F.ceil(F.sqrt(F.col("n").cast("double"))) + F.greatest(F.lit(5), F.floor(F.log10(F.col("n").cast("double"))))
    stats = kept(stats.withColumn("far", far.cast("long")).withColumn("part", F.greatest(F.lit(PART), F.col("far") + 1)))
    long = p.join(stats.where((F.col("n") >= SHORT) & (F.col("top") > F.col("low"))), by)
    own = F.floor(F.col("place") / F.col("part"))
    again = F.when((F.col("place") % F.col("part") <= F.col("far")) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    long = long.select(*by, "n", "far", "part", "place", (F.col("x") - F.col("mean")).alias("x"), F.explode(again).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}

    def sums(t: pa.Table) -> pa.Table:
        n, far, size, at = (t.column(c)[0].as_py() for c in ("n", "far", "part", "at"))
        place = t.column("place").to_numpy()
        rank = np.argsort(place)
        x, place = t.column("x").to_numpy()[rank], place[rank]
        mine = int(np.searchsorted(place, (at + 1) * size))
        width = 1 << (mine + far + 1 - 1).bit_length()
        a = np.fft.rfft(x[:mine], width)
        cross = np.fft.irfft(np.conj(a) * np.fft.rfft(x[: mine + far], width), width)[: far + 1]
        # What lags leave out at either end of the series, by lag.
        head, tail = np.zeros(far + 2), np.zeros(far + 2)
        first, last = place[:mine] <= far, place[:mine] >= n - 1 - far
        np.add.at(head, place[:mine][first] + 1, x[:mine][first] ** 2)
        np.add.at(tail, n - place[:mine][last], x[:mine][last] ** 2)
        out = {c: [t.column(c)[0].as_py()] for c in by}
        return pa.table(out | {"n": [n], "cross": [cross.tolist()], "head": [head.tolist()], "tail": [tail.tolist()]}, schema=part_schema)

    named = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    lists = [(c, pa.list_(pa.float64())) for c in ("cross", "head", "tail")]
    part_schema = pa.schema([*((c, named[kinds[c]]) for c in by), ("n", pa.int64()), *lists])
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    parts = long.groupBy(*by, "at").applyInArrow(sums, f"{keys}, n long, cross array<double>, head array<double>, tail array<double>")
    # Sums by lag: a row a part and lag at most, summed before they meet.
    flat = parts.select(*by, "n", F.posexplode(F.arrays_zip("cross", F.slice("head", 2, 1 << 30).alias("head"), F.slice("tail", 2, 1 << 30).alias("tail"))).alias("lag", "s"))
    flat = flat.groupBy(*by, "n", "lag").agg(F.sum("s.cross").alias("cross"), F.sum("s.head").alias("head"), F.sum("s.tail").alias("tail"))

    def choose(t: pa.Table) -> pa.Table:
        n = t.column("n")[0].as_py()
        rank = np.argsort(t.column("lag").to_numpy())
        cross, head, tail = (t.column(c).to_numpy()[rank] for c in ("cross", "head", "tail"))
        all_ = cross[0]
        without = np.sqrt(np.maximum(all_ - np.cumsum(head), 0) * np.maximum(all_ - np.cumsum(tail), 0))
        cor = np.divide(np.abs(cross), without, out=np.zeros(len(cross)), where=without > 0)
        block = int(max(1, min(round(optimal_block(n, cross / n, cor)), n // 4)))
        return pa.table({c: [t.column(c)[0].as_py()] for c in by} | {"block": [block]}, schema=pa.schema([*((c, named[kinds[c]]) for c in by), ("block", pa.int64())]))

    chosen = flat.groupBy(*by).applyInArrow(choose, f"{keys}, block long")
    short = F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("long")
    return stats.join(chosen, by, "left").select(*by, "n", F.when(F.col("n") < SHORT, short).otherwise(F.coalesce("block", F.lit(1))).alias("block"))


def drawn(seed: int, n: Column, *parts: Column) -> Column:
    """A place from 0 to n - 1 by the digest of seed and parts, the same in any engine that has MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long"), n)


def bootstrap_means(series: DataFrame, blocks: DataFrame, rounds: int = 2000, seed: int = 0, alike: bool = False) -> DataFrame:
    """(key, n, replicate, mean) of every series (key, t, x): means of `rounds` samples made of circular blocks.

    blocks (key, block): a sample of n values is ceil(n / block) blocks from seeded places, the last one cut to what is
    left. The sum of every block that a place can begin is one window, so a replicate is a join by place and a grouped sum.
    alike: series of one length and block draw the same places, so that their differences are resampled too."""
    p = _numbered(series, ["key"], ["t"], "x").join(blocks.select("key", "block"), "key")
    size = F.least(F.greatest(F.col("block"), F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("total") / 4))).cast("long")
    p = p.withColumn("size", size).withColumn("cut", F.col("total") - (F.ceil(F.col("total") / F.col("size")) - 1) * F.col("size"))
    head = kept(p)
    # The first rows come again after the last, so that a block may begin anywhere.
    wrapped = head.unionByName(head.where(F.col("place") < F.col("size")).withColumn("place", F.col("place") + F.col("total")))
    upto = F.sum("x").over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    run = kept(wrapped.select("key", "place", F.coalesce(upto, F.lit(0.0)).alias("s"), "x"))
    ends = run.select("key", F.col("place").alias("end"), (F.col("s") + F.col("x")).alias("e"))
    b = head.select("key", "place", "total", "size", "cut").join(run.select("key", "place", "s"), ["key", "place"])
    for name, length in (("whole", F.col("size")), ("part", F.col("cut"))):
        b = b.withColumn("end", F.col("place") + length - 1).join(ends, ["key", "end"]).withColumn(name, F.col("e") - F.col("s")).drop("e", "end")
    sums = b.select("key", "place", "whole", "part")
    tries = head.groupBy("key").agg(F.first("total").alias("n"), F.first("size").alias("size")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    tries = tries.withColumn("last", F.ceil(F.col("n") / F.col("size"))).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    tries = tries.withColumn("place", drawn(seed, F.col("n"), F.lit("all") if alike else F.col("key"), F.col("replicate"), F.col("draw")))
    # Places drawn twice by a replicate count as often: its multiplicities meet the sums, not its draws.
    often = tries.groupBy("key", "n", "replicate", "place").agg(F.count_if(F.col("draw") < F.col("last")).alias("wholes"), F.count_if(F.col("draw") == F.col("last")).alias("parts"))
    each = often.join(sums, ["key", "place"])
    return each.groupBy("key", "n", "replicate").agg((F.sum(F.col("wholes") * F.col("whole") + F.col("parts") * F.col("part")) / F.first("n")).alias("mean"))


def bootstrap_verdict(series: DataFrame, blocks: DataFrame | None = None, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """(key, n, block, mean, p, lo, hi) of every series (key, t, x): its mean, how often one as high comes up where the mean
    is 0 (itself counted among them), and its 95 % interval, by `bootstrap_means`.

    blocks (key, block) default to `pick_block`. Series of fewer than 4 finite values have a null mean and no figures."""
    known = kept(series.select("key", "t", "x"))
    blocks = kept(pick_block(known, ["key"], ["t"], "x").select("key", "block") if blocks is None else blocks)
    x = F.col("x").cast("double")
    own = known.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy("key").agg(F.count("*").alias("n"), F.avg(x).alias("mean"))
    own = kept(own.join(blocks, "key", "left").withColumn("block", F.least(F.greatest(F.col("block"), F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("n") / 4))).cast("long")))
    enough = known.join(own.where("n >= 4").select("key"), "key", "left_semi")
    null = bootstrap_means(enough, blocks, rounds, seed).join(own.select("key", F.col("mean").alias("seen")), "key")
    p = null.groupBy("key").agg(((F.count_if(F.col("mean") - F.col("seen") >= F.col("seen")) + 1) / F.lit(rounds + 1.0)).alias("p"))
    spread = quantiles(bootstrap_means(enough, blocks, rounds, seed + 1), ["key"], "mean", [0.025, 0.975])
    ends = spread.groupBy("key").agg(F.max(F.when(F.col("q") < 0.5, F.col("quantile"))).alias("lo"), F.max(F.when(F.col("q") > 0.5, F.col("quantile"))).alias("hi"))
    return own.withColumn("mean", F.when(F.col("n") >= 4, F.col("mean"))).join(p, "key", "left").join(ends, "key", "left").select("key", "n", "block", "mean", "p", "lo", "hi")


def null_best(rows: DataFrame, order: list[str], hit: str, conditions: list[str], block: int, rounds: int = 200, least: int = 30, seed: int = 0) -> DataFrame:
    """(round, best): the best score of all conditions in each of `rounds` worlds whose hits have been moved in blocks.

    Round 0 is the world as it is. Of m whole blocks, round s moves block b to (a b + c) mod m with a prime to m, a
    bijection by arithmetic, so every world is a key of one aggregate over one table; rows after the last whole block stay.
    A condition's score is (share of hits where it holds - 0.5) * sqrt(rows where it holds), from `least` rows on."""
    p = places(rows.select(*order, F.col(hit).cast("double").alias("_hit"), *[F.col(c).cast("boolean").alias(c) for c in conditions]), [], order)
    n = p.count()
    m = n // block
    steps = [_step(m, seed, s) for s in range(rounds + 1)]
    worlds = F.array(*[F.struct(F.lit(s).alias("round"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for s, (a, c) in enumerate(steps)])
    b = kept(p.withColumn("_b", F.floor(F.col("place") / block).cast("long")).withColumn("_i", F.col("place") % block))
    hits = b.groupBy("_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_hit"))), lambda x: x["_hit"]).alias("hits"))
    flags = b.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_i", F.array(*conditions).alias("f")))).alias("flags"))
    moved = hits.select("hits", F.col("_b").alias("_from"), F.explode(worlds).alias("w")).select("hits", "w.round", F.when(F.col("_from") < m, F.pmod(F.col("w.a") * F.col("_from") + F.col("w.c"), F.lit(max(m, 1)))).otherwise(F.col("_from")).alias("_b"))
    met = moved.join(flags, "_b")
    # Of each block and condition: the rows where it holds, and their hits.
    per = lambda k: F.aggregate(F.zip_with("hits", "flags", lambda h, f: F.when(f["f"][k] & h.isNotNull(), F.struct(F.lit(1.0).alias("n"), h.alias("h"))).otherwise(F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("h")))), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("h")), lambda a, x: F.struct((a["n"] + F.coalesce(x["n"], F.lit(0.0))).alias("n"), (a["h"] + F.coalesce(x["h"], F.lit(0.0))).alias("h")))
    met = met.select("round", *[per(k).alias(f"_s{k}") for k in range(len(conditions))])
    sums = met.groupBy("round").agg(*[F.sum(f"_s{k}.{x}").alias(f"_{x}{k}") for k in range(len(conditions)) for x in ("n", "h")])
    score = lambda k: F.when(F.col(f"_n{k}") >= least, (ratio(F.col(f"_h{k}"), F.col(f"_n{k}")) - 0.5) * F.sqrt(F.col(f"_n{k}")))
    scores = [score(k) for k in range(len(conditions))]
    return sums.select("round", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("best"))


def _step(m: int, seed: int, s: int) -> tuple[int, int]:
    """Factor and shift of round s over m blocks: none in round 0, else from a seeded stream, the factor prime to m."""
    if s == 0 or m < 2:
        return 1, 0
    rng = np.random.default_rng([seed, s])
    while True:
        a = int(rng.integers(1, m))
        if math.gcd(a, m) == 1:
            return a, int(rng.integers(0, m))


def eliminate(names: list[str], loss: np.ndarray, sample: np.ndarray) -> dict[str, float]:
    """The p of every model in the set of the best (Hansen, Lunde and Nason 2011, the largest excess of a model over the mean of
    those left): models go worst first, and none has a smaller p than one that went before. Models that go alike do not vary."""
    left, out, p = list(range(len(names))), {}, 0.0
    err = sample - loss
    while len(left) > 1:
        e = err[:, left] - err[:, left].mean(axis=1, keepdims=True)
        excess, sd = loss[left] - loss[left].mean(), np.sqrt((e * e).mean(axis=0))
        z = np.divide(excess, sd, out=np.where(excess > 0, np.inf, 0.0), where=sd > 0)
        drawn_z = np.divide(e, sd, out=np.zeros_like(e), where=sd > 0).max(axis=1)
        worst = int(np.argmax(z))
        p = max(p, float((z[worst] < drawn_z).mean())) if z[worst] > 0 else 1.0
        out[names[left.pop(worst)]] = p
    return out | {names[i]: 1.0 for i in left}


def superior(loss: np.ndarray, sample: np.ndarray, base: int, n: int) -> float:
    """The p of `no model beats the base` (Hansen 2005, the consistent one): models far worse than the base do not weigh in."""
    rest = [k for k in range(len(loss)) if k != base]
    gain, drawn_gain = loss[base] - loss[rest], sample[:, [base]] - sample[:, rest]
    sd = np.sqrt(((drawn_gain - gain) ** 2).mean(axis=0))
    if not rest or not (sd > 0).any():
        return 1.0
    gain, drawn_gain, sd = gain[sd > 0], drawn_gain[:, sd > 0], sd[sd > 0]
    near = np.where(gain >= -sd * math.sqrt(2 * math.log(math.log(max(n, 16)))), gain, 0.0)
    stat = max(0.0, float((gain / sd).max()))
    return float((np.maximum(0.0, ((drawn_gain - near) / sd).max(axis=1)) >= stat).mean())


def model_confidence(losses: DataFrame, base: str, block: int | None = None, rounds: int = 1000, size: float = 0.1, seed: int = 0) -> DataFrame:
    """(model, n, loss, p, included, beaten_p) of losses (model, symbol, ts, loss): mean loss on the rows that all models have, p in
    the set of the best and whether it is above `size`, and for all the p of `no model beats the base`.

    A row that a model lacks, or where its loss is null or not finite, counts for none; repeated rows are averaged. All models draw
    the same circular blocks, their length by `pick_block` of the base unless given. Only the means of the replicates, rounds x
    models numbers whatever the rows, meet in the task that eliminates. The work is rounds x models x rows / block, so short blocks
    are dear. Fewer than 4 common rows give no result."""
    x = F.col("loss").cast("double")
    some = losses.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy("ts", "symbol", "model").agg(F.avg(x).alias("loss"))
    models = sorted(r.model for r in losses.select("model").distinct().collect())  # a handful by what they are
    met = some.groupBy("ts", "symbol").agg(F.collect_list(F.struct("model", "loss")).alias("m")).where(F.size("m") == len(models))
    series = kept(met.select(F.struct("ts", "symbol").alias("t"), F.explode("m").alias("m")).select(F.col("m.model").alias("key"), "t", F.col("m.loss").alias("x")))
    own = kept(series.groupBy("key").agg(F.count("*").alias("n"), F.avg("x").alias("loss")).where("n >= 4"))
    if block is None:
        blocks = pick_block(series.where(F.col("key") == base), ["key"], ["t"], "x").select("block")
        blocks = own.select("key").join(F.broadcast(blocks), how="cross")  # one row
    else:
        blocks = own.select("key", F.lit(block).cast("long").alias("block"))
    means = bootstrap_means(series.join(own.select("key"), "key", "left_semi"), kept(blocks), rounds, seed, alike=True)
    per = means.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("replicate", "mean"))).alias("s")).join(own, "key").select("key", "n", "loss", F.transform("s", lambda v: v["mean"]).alias("sample"))

    def judge(t: pa.Table) -> pa.Table:
        rank = np.argsort(np.array(t.column("key").to_pylist()))
        names, loss = [t.column("key")[int(i)].as_py() for i in rank], t.column("loss").to_numpy()[rank]
        sample = np.array([t.column("sample")[int(i)].as_py() for i in rank]).T
        n, p = t.column("n")[0].as_py(), eliminate(names, loss, sample)
        beaten = superior(loss, sample, names.index(base), n)
        return pa.table({"model": names, "n": [n] * len(names), "loss": loss, "p": [p[k] for k in names], "included": [p[k] > size for k in names], "beaten_p": [beaten] * len(names)})

    return per.groupBy(F.lit(1).alias("_all")).applyInArrow(judge, "model string, n long, loss double, p double, included boolean, beaten_p double")
