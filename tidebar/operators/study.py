"""Rules that abstain: where forecasts fail by a condition, what is gained by silence there, and whether later times agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import places
from ..sources.shared import kept

#: Least rows of a bucket or of what a rule leaves, least different values of a condition, margin of a score, rules
#: that go on from the first span, and what the last span must show: gain of the hit rate, rows left.
LEAST, VALUES, MARGIN, WIDTH, GAIN, ROWS = 30, 6, 0.01, 20, 0.07, 300
#: Where the second and the third span of time begin, as shares of the rows.
SPANS = (0.6, 0.8)
PARTS = ("discover", "confirm", "holdout")


def long_form(verdicts: DataFrame, conditions: list[str]) -> DataFrame:
    """(symbol, ts, hit, predicted, error, part if there, condition, value): a row for every called forecast and condition.

    A forecast is called where hit, 1 or 0, is not null; a null condition stays a row with a null value."""
    keys = [c for c in ("symbol", "ts", "hit", "predicted", "error", "part") if c in verdicts.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("double").alias("value")) for c in conditions])
    return verdicts.where("hit IS NOT NULL").select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def splits(rows: DataFrame) -> DataFrame:
    """(condition, bucket 0 to 2, n, hit, vs_all, error, low, high) by thirds of every condition at once, rows of long_form().

    Ties go by time. A condition with fewer than 3 * LEAST values or VALUES different ones says nothing; a bucket below LEAST
    is left out. The order of a condition is spread over ranges, never sorted by one task."""
    known = rows.where("value IS NOT NULL")
    worth = known.groupBy("condition").agg(F.count("*").alias("_n"), F.countDistinct("value").alias("_d")).where((F.col("_n") >= 3 * LEAST) & (F.col("_d") >= VALUES))
    p = places(known.join(F.broadcast(worth.select("condition")), "condition", "left_semi"), ["condition"], ["value", "ts", "symbol"])
    cut = lambda k: k * (F.col("total") - 1) / 3
    bucket = F.when(F.col("place") <= cut(1), 0).when(F.col("place") <= cut(2), 1).otherwise(2)
    per = p.groupBy("condition", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.avg("error").alias("error"), F.min("value").alias("low"), F.max("value").alias("high"))
    # Every condition has the same called rows, so the mean over all of them is that of any.
    every = rows.groupBy("condition").agg(F.avg("hit").alias("_all"))
    return per.where(F.col("n") >= LEAST).join(every, "condition").withColumn("vs_all", F.round(F.col("hit") - F.col("_all"), 4)).drop("_all")


def hypotheses(found: DataFrame) -> DataFrame:
    """(condition, op, threshold) of the outer thirds that hit less than all: abstain below the low one's end, or above the
    high one's start. Two a condition at most, whatever the number of rows."""
    op = F.when(F.col("bucket") == 0, "<").when(F.col("bucket") == 2, ">")
    return found.where((F.col("vs_all") < 0) & op.isNotNull()).select("condition", op.alias("op"), F.round(F.when(F.col("bucket") == 0, F.col("high")).otherwise(F.col("low")), 6).alias("threshold"))


def silent(value: Column, op: Column, threshold: Column) -> Column:
    """Whether a rule abstains at a value; never at an unknown one."""
    return F.coalesce(F.when(op == "<", value < threshold).otherwise(value > threshold), F.lit(False))


def _measures() -> list[Column]:
    n, hit = F.count("*"), F.avg("hit")
    score = F.when(n >= LEAST, F.round((hit - 0.5) * F.sqrt(n), 4))
    return [n.alias("n"), hit.alias("hit"), F.avg((F.col("predicted") > 0).cast("double")).alias("up"), F.avg("error").alias("error"), score.alias("score")]


def spans(verdicts: DataFrame) -> DataFrame:
    """Called verdicts with part: the first 60 % in time, the next 20 %, the last 20 %. Below 6 * LEAST rows none is told."""
    p = places(verdicts.where("hit IS NOT NULL"), [], ["ts", "symbol"])
    cuts = [F.floor(F.col("total") * x) for x in SPANS]
    part = F.when(F.col("place") < cuts[0], PARTS[0]).when(F.col("place") < cuts[1], PARTS[1]).otherwise(PARTS[2])
    return p.where(F.col("total") >= 6 * LEAST).withColumn("part", part).drop("place", "total")


def search(verdicts: DataFrame, conditions: list[str]) -> DataFrame:
    """A row per candidate rule of verdicts (symbol, ts, hit, predicted, error, conditions): condition, op, threshold, and for each
    part n, hit, up, error and score of what it leaves, beside base_hit and base_score of the part without a rule.

    Candidates come from the first span alone. place orders them by their score there; won: it beats no rule by MARGIN; survived:
    it is among the best WIDTH of those and beats no rule in the second span too; chosen: the best that survived. The third span
    is measured for the chosen rule only. Score is (hit - 1/2) * sqrt(n), so a rule that leaves few rows has to hit more."""
    v = kept(spans(verdicts))
    rows = long_form(v, conditions)
    rules = kept(hypotheses(splits(rows.where(F.col("part") == PARTS[0]))))
    left = rows.join(F.broadcast(rules), "condition").where(~silent(F.col("value"), F.col("op"), F.col("threshold")))
    base = v.groupBy("part").agg(*_measures()).select("part", F.col("hit").alias("base_hit"), F.col("score").alias("base_score"))
    per = left.groupBy("condition", "op", "threshold", "part").agg(*_measures()).join(F.broadcast(base), "part")
    names = ["n", "hit", "up", "error", "score", "base_hit", "base_score"]
    wide = per.groupBy("condition", "op", "threshold").agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in PARTS for c in names])
    beats = lambda p: F.coalesce(F.col(f"{p}_score") > F.col(f"{p}_base_score") + MARGIN, F.lit(False))
    # All that follows is at most two rows a condition.
    best = Window.orderBy(F.desc_nulls_last("discover_score"), "condition", "op")
    wide = wide.withColumn("place", F.row_number().over(best)).withColumn("won", beats("discover"))
    wide = wide.withColumn("survived", F.col("won") & (F.col("place") <= WIDTH) & beats("confirm"))
    wide = wide.withColumn("chosen", F.col("survived") & (F.col("place") == F.min(F.when(F.col("survived"), F.col("place"))).over(Window.partitionBy())))
    return wide.withColumns({f"holdout_{c}": F.when(F.col("chosen"), F.col(f"holdout_{c}")) for c in names})


def gate(searched: DataFrame) -> DataFrame:
    """(condition, op, threshold, n, without, with_rule, trials): the chosen rule where the last span leaves ROWS rows and gains GAIN,
    else no row. trials is the number of candidates, so that a reader can weigh the find."""
    trials = searched.withColumn("trials", F.count("*").over(Window.partitionBy()))
    open_ = F.col("chosen") & (F.col("holdout_n") >= ROWS) & (F.col("holdout_hit") - F.col("holdout_base_hit") >= GAIN)
    return trials.where(open_).select("condition", "op", "threshold", F.col("holdout_n").alias("n"), F.col("holdout_base_hit").alias("without"), F.col("holdout_hit").alias("with_rule"), "trials")


def abstains(rows: DataFrame, rule: DataFrame, conditions: list[str]) -> DataFrame:
    """rows with abstain: whether the gate's rule (one row or none) keeps silent there. No rule, an unknown value or a condition
    that rows do not have: false."""
    value = F.coalesce(*[F.when(F.col("_rule.condition") == c, F.col(c).cast("double")) for c in conditions if c in rows.columns], F.lit(None).cast("double"))
    one = rule.select(F.lit(1).alias("_on"), F.struct("condition", "op", "threshold").alias("_rule"))
    out = rows.withColumn("_on", F.lit(1)).join(F.broadcast(one), "_on", "left")
    return out.withColumn("abstain", silent(value, F.col("_rule.op"), F.col("_rule.threshold"))).drop("_on", "_rule")
