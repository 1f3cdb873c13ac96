"""Mixing sources to target weights by capped water-filling (operator 2). DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, staged, table, word_count

#: Weights of the sources in code-point order, repeated; the most epochs a source may give; hash buckets of a fractional
#: epoch; parts that a source's rows are dealt to when they meet its figures; how near a fractional epoch need come, as a share of
#: it; a row above 1 / LONG of it is long.
WEIGHTS, MAX_EPOCHS, BUCKETS, SALT, NEAR, LONG = (5, 2, 1), 3, 1 << 14, 32, 0.005, 8


def checkpointed(df: DataFrame) -> DataFrame:
    """df written and read back. A checkpoint would hand on what is known of the plan that made it (order, equal columns), which
    joins by source and renamed columns multiply turn by turn, until planning takes the driver's time and memory."""
    return staged(df, "mix")


def water_fill(sources: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with its target.

    Clamping the sources above their cap and resharing the excess by weight until none is above ends at the level L
    with sum(min(cap * size, L * weight)) = all sizes. Sources fill up in order of cap * size / weight, so L follows
    from running sums in that order. The table has one row per source; its windows run over that alone.
    """
    n, by_name = len(weights), Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("full_at", F.col("limit") / F.col("weight"))
    upto = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns(
        {
            "all": F.sum("source_size").over(every),
            "clamped": F.coalesce(F.sum("limit").over(upto), F.lit(0.0)),
            "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        }
    )
    # The first source in filling order that stays below its limit gives the level of it and all after it.
    s = s.withColumn("here", (F.col("all") - F.col("clamped")) / F.col("left"))
    level = F.coalesce(F.min(F.when(F.col("here") <= F.col("full_at"), F.struct("full_at", "source", "here"))).over(every)["here"], F.lit(float("inf")))
    s = s.withColumn("level", level)
    return s.select("source", "source_size", F.when(F.col("limit") <= F.col("level") * F.col("weight"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _with_source(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """rows with the figures of their source, null included; a hot source is spread over SALT parts."""
    f = figures.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnRenamed("source", "_source")
    r = rows.withColumn("_r", F.pmod(F.shiftright("h", 20), F.lit(SALT)).cast("int"))
    return r.join(f, (F.col("_r") == F.col("_s")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_r", "_s", "_source")


def _prefix(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """rows (source, h, b, key, size, n) with take: of the seeded order of each source's copies (n of a row) the longest
    prefix of at most `room` words, as copies of each row; 0 <= take <= n.

    The bucket where a prefix ends is the first whose running sum passes the room, whatever buckets are empty; running
    sums go over BUCKETS numbers a source and, row by row, over that one bucket alone."""
    words = F.col("n") * F.col("size")
    sums = rows.groupBy("source", "b").agg(F.sum(words).alias("w"))
    sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("source").orderBy("b")))
    ends = sums.join(rooms.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).where("upto > room")
    ends = ends.groupBy("source").agg(F.min("b").alias("edge"), F.min_by(F.col("upto") - F.col("w"), "b").alias("have"))
    ends = rooms.join(ends.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "room", F.coalesce("edge", F.lit(BUCKETS)).alias("edge"), F.coalesce("have", F.lit(0)).alias("have"))
    d = _with_source(rows, checkpointed(ends))
    inside = Window.partitionBy("source").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.col("have") - F.coalesce(F.sum(words).over(inside), F.lit(0))
    some = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(left / F.col("size")))).cast("long")
    within = d.where("b = edge").withColumn("take", some)
    rest = d.where("b <> edge").withColumn("take", F.when(F.col("b") < F.col("edge"), F.col("n")).otherwise(F.lit(0)).cast("long"))
    return within.unionByName(rest).select(*rows.columns, "take")


def _left(rooms: DataFrame, taken: DataFrame) -> DataFrame:
    """rooms less the words of taken (source, size, take)."""
    spent = taken.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("take") * F.col("size")).alias("spent"))
    return checkpointed(rooms.join(spent, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", (F.col("room") - F.coalesce("spent", F.lit(0))).alias("room")))


def _seeded(rows: DataFrame, rooms: DataFrame, first: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(source, h, key, take) and (source, gap) of filling each room in the seeded order, after what `first` took: its
    prefix; of what is left the prefix of the rows that still fit, until none does or the room left is within NEAR of the
    room; then the one row that comes nearest, if nearer than none. gap is how many words the source is off then."""
    left, taken = rows, list(first)
    full = rooms.select(F.col("source").alias("_whole"), (F.col("room") * NEAR).alias("_near"))
    for got in first:
        rooms = _left(rooms, got)
    if first:
        gone = reduce(DataFrame.unionByName, first).groupBy("key").agg(F.sum("take").alias("_gone"))
        left = checkpointed(rows.join(gone, "key", "left").withColumn("n", F.col("n") - F.coalesce("_gone", F.lit(0))).drop("_gone").where("n > 0"))
    turn = 0
    while turn == 0 or not left.isEmpty():
        got = checkpointed(_prefix(left, rooms))
        taken.append(got.select("source", "h", "key", "size", "take").where("take > 0"))
        rooms = _left(rooms, taken[-1])
        left = got.where("take < n").withColumn("n", F.col("n") - F.col("take")).drop("take")
        wide = rooms.join(full, F.col("source").eqNullSafe(F.col("_whole"))).where("room > _near").select("source", "room")
        left = checkpointed(_with_source(left, wide).where("size <= room").drop("room"))
        turn += 1
    every = reduce(DataFrame.unionByName, taken).groupBy("source", "h", "key").agg(F.sum("take").alias("take"))
    free = rows.join(every.select("key", "take"), "key", "left").where("n > coalesce(take, 0)").drop("take")
    away = F.abs(F.col("size") - F.col("room"))
    last = _with_source(free, rooms).where(away < F.col("room")).groupBy("source").agg(F.min_by(F.struct("h", "key", away.alias("gap")), F.struct(away, "h", "key")).alias("_"))
    last = checkpointed(last.select("source", "_.*", F.lit(1).cast("long").alias("take")))
    gaps = rooms.join(last.select(F.col("source").alias("_source"), "gap"), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", F.coalesce("gap", "room").alias("gap"))
    return checkpointed(every.unionByName(last.drop("gap")).groupBy("source", "h", "key").agg(F.sum("take").alias("take"))), checkpointed(gaps)


def _longest(rows: DataFrame, rooms: DataFrame) -> list[DataFrame]:
    """What filling each room longest row first takes of the rows above 1 / LONG of it: at most LONG rows a source, so at
    most LONG turns, each one grouped sum."""
    long = checkpointed(_with_source(rows, rooms).where((F.col("size") <= F.col("room")) & (F.col("size") * LONG > F.col("room"))).drop("room"))
    taken = []
    while not long.isEmpty():
        fits = _with_source(long, rooms).where("size <= room")
        best = fits.groupBy("source").agg(F.max_by(F.struct("h", "key", "size", F.least(F.col("n"), F.floor(F.col("room") / F.col("size"))).cast("long").alias("take")), F.struct("size", "h", "key")).alias("_"))
        taken.append(checkpointed(best.select("source", "_.*")))
        rooms = _left(rooms, taken[-1])
        long = checkpointed(_with_source(long.join(taken[-1].select("key"), "key", "left_anti"), rooms).where("size <= room").drop("room"))
    return taken


def _filled(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """(key, more): how many copies of which rows fill each source's room: in the seeded order; where that ends further
    than NEAR of the room from it, as a long row may have been passed over, the longest rows first and the seeded order
    for what is left, if that ends nearer."""
    rows = rows.where("size > 0")
    picks, gaps = _seeded(rows, rooms, [])
    far = gaps.join(rooms.select(F.col("source").alias("_source"), "room"), F.col("source").eqNullSafe(F.col("_source"))).where(F.col("gap") > F.col("room") * NEAR).select("source", "room", "gap")
    far = checkpointed(far)
    if not far.isEmpty():
        some = checkpointed(_with_source(rows, far).drop("room", "gap"))
        again, ends = _seeded(some, far.select("source", "room"), _longest(some, far.select("source", "room")))
        ends = ends.select(F.col("source").alias("_source"), F.col("gap").alias("_gap"))
        better = checkpointed(far.join(ends, F.col("source").eqNullSafe(F.col("_source"))).where("_gap < gap").select("_source"))
        same = F.col("source").eqNullSafe(F.col("_source"))
        picks = picks.join(better, same, "left_anti").unionByName(_with_source(again, better.select(F.col("_source").alias("source"))))
    return picks.groupBy("key").agg(F.sum("take").alias("more"))


def mix_counts(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """Per distinct row of docs (key, doc_id, source, size): n, how many rows it stands for; source_size; target; whole, how
    often the mix takes each of them; more, how many of them it takes once more.

    A source with target / source_size = whole + part gives every row `whole` times, and part * source_size words once
    more: see `_filled`; a source of one row takes it or not, whichever is nearer. No task sees a source.
    Rows without words are taken `whole` times; no row beyond the cap.
    """
    h = F.xxhash64("key", F.lit(seed))
    rows = docs.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = checkpointed(rows.withColumns({"h": h, "b": F.pmod(h, F.lit(BUCKETS)).cast("int")}))
    sources = water_fill(rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    epochs = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    sources = sources.withColumn("whole", F.least(F.floor(epochs + 1e-12), F.lit(int(cap))))
    room = F.when(F.col("whole") < cap, F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(F.lit(0.0))
    sources = checkpointed(sources.withColumn("room", room))
    more = _filled(rows, sources.select("source", "room"))
    return _with_source(rows, sources.drop("room", "weight")).join(more, "key", "left").select("key", "doc_id", "source", "size", "n", "source_size", "target", "whole", F.coalesce("more", F.lit(0)).alias("more"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """Per row of docs (key, doc_id, source, size): source_size, target and times, how often the mix takes the row.

    key tells rows apart (equal keys are repeated rows, each counted). Null sources are a source of their own, last. An
    empty table gives none.
    """
    c = mix_counts(docs, weights, cap, seed).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return c.select("key", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("i") <= F.col("more")).cast("long")).alias("times"))


def _key():
    return F.xxhash64("doc_id", "text", "source")


def sized(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size) of every row of docs, the words of its whole text counted (null: 0)."""
    return docs.select(_key().alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times) of every document; odd rows as in `mix_counts` and `mix_plan`."""
    plan = mix_plan(sized(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows taken 0 times go.

    Columns of docs may have any names. Rows that repeat doc_id, text and source share what is left of an epoch: if it
    takes only some of them once more, one of them stands for those copies."""
    plan = mix_counts(sized(docs)).select("key", "n", F.col("whole").cast("int").alias("whole"), F.col("more").cast("int").alias("more")).where("whole > 0 OR more > 0")
    d = packed(docs, key=_key()).join(plan, "key")
    even = d.where("more = 0 OR more = n").withColumn("times", F.col("whole") + (F.col("more") > 0).cast("int"))
    some = d.where("more > 0 AND more < n")
    extra = some.groupBy("key").agg(F.first("row").alias("row"), F.first("more").alias("times"))
    every = even.select("row", "times").unionByName(some.select("row", F.col("whole").alias("times"))).unionByName(extra.select("row", "times"))
    return every.where("times > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
