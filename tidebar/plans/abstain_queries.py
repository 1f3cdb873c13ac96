"""Queries of the search for rules that abstain, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import ratio
from ..operators import study
from ..operators.indicators import clv
from ..sources.bars import bars_daily
from . import oracle as q
from .study_queries import flat, r6, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, f, sql):
    QUERIES[name], ORACLE[name] = f, sql


CONDITIONS = ["px_over_sma20", "percent_b", "range_position", "volume_ratio", "clv", "move", "clv_abs", "move_abs"]


def _verdicts(spark, d):
    """The last five days' move as a forecast of the next five, with what was known at the time, rounded so that a threshold is one number."""
    n = 20
    low, high, mean, sd = s.rolling_min("low", n), s.rolling_max("high", n), s.sma("close", n), s.stdev("close", n)
    close, move = F.col("close"), F.col("close") / s.lag("close", 5) - 1
    raw = {"px_over_sma20": ratio(close, mean) - 1, "percent_b": ratio(close - (mean - 2 * sd), 4 * sd), "range_position": ratio(close - low, high - low), "volume_ratio": ratio(F.col("volume"), s.sma("volume", n)), "clv": clv(), "move": move}
    df = bars_daily(spark, d).select("symbol", "ts", (s.lead("close", 5) / close - 1).alias("fwd"), *[(F.round(x + 1.23456789e-8, 6) + F.lit(0.0)).alias(k) for k, x in raw.items()])
    hit = F.when((F.col("move") != 0) & F.col("fwd").isNotNull(), (F.signum("fwd") == F.signum("move")).cast("double"))
    return df.select("symbol", "ts", hit.alias("hit"), F.col("move").alias("predicted"), F.abs(F.col("fwd") - F.col("move")).alias("error"), *CONDITIONS[:6], F.abs("clv").alias("clv_abs"), F.abs("move").alias("move_abs"))


_raw = {"px_over_sma20": "close / m - 1", "percent_b": q.ratio("close - (m - 2 * sd)", "4 * sd"), "range_position": q.ratio("close - lo", "hi - lo"), "volume_ratio": q.ratio("volume", "vm"), "clv": q.CLV, "move": f"close / {q.lag('close', 5)} - 1"}
VERDICTS = f"""vb AS (SELECT *, {q.full('avg', 'close', 20)} AS m, {q.full('stddev_pop', 'close', 20)} AS sd, {q.full('min', 'low', 20)} AS lo, {q.full('max', 'high', 20)} AS hi, {q.full('avg', 'volume', 20)} AS vm FROM bars),
vc AS (SELECT symbol, ts, {q.lead('close', 5)} / close - 1 AS fwd, {', '.join(f'{r6(x)} AS {k}' for k, x in _raw.items())} FROM vb),
verdicts AS (SELECT *, move AS predicted, abs(clv) AS clv_abs, abs(move) AS move_abs, abs(fwd - move) AS error, CASE WHEN move <> 0 AND fwd IS NOT NULL THEN CAST(sign(fwd) = sign(move) AS DOUBLE) END AS hit FROM vc)"""
_names, _values = str(CONDITIONS), "[" + ", ".join(CONDITIONS) + "]"


def _long(out: str, source: str) -> str:
    return f"{out} AS (SELECT * EXCLUDE ({', '.join(CONDITIONS)}), unnest({_names}) AS condition, unnest({_values}) AS value FROM {source} WHERE hit IS NOT NULL)"


def _splits(out: str, source: str) -> str:
    return f"""{out}_k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY value, ts, symbol) - 1 AS place, count(*) OVER (PARTITION BY condition) - 1 AS top FROM {source} WHERE value IS NOT NULL),
{out} AS (SELECT condition, CASE WHEN place <= top / 3.0::DOUBLE THEN 0 WHEN place <= 2 * top / 3.0::DOUBLE THEN 1 ELSE 2 END AS bucket, count(*) AS n, avg(hit) AS hit, round(avg(hit) - (SELECT avg(hit) FROM {source}), 4) AS vs_all, avg(error) AS error, min(value) AS low, max(value) AS high
  FROM {out}_k WHERE condition IN (SELECT condition FROM {source} GROUP BY 1 HAVING count(value) >= 90 AND count(DISTINCT value) >= 6) GROUP BY 1, 2 HAVING count(*) >= 30)"""


_n = "count(*) AS n, avg(hit) AS hit, avg(CAST(predicted > 0 AS DOUBLE)) AS up, avg(error) AS error, CASE WHEN count(*) >= 30 THEN round((avg(hit) - 0.5::DOUBLE) * sqrt(count(*)), 4) END AS score"
_per = ["n", "hit", "up", "error", "score", "base_hit", "base_score"]
_beats = lambda p: f"coalesce({p}_score > {p}_base_score + 0.01::DOUBLE, false)"
SEARCH = f"""{VERDICTS}, vo AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS r, count(*) OVER () AS total FROM verdicts WHERE hit IS NOT NULL),
vp AS (SELECT * EXCLUDE (r, total), CASE WHEN r < floor(total * 0.6::DOUBLE) THEN 'discover' WHEN r < floor(total * 0.8::DOUBLE) THEN 'confirm' ELSE 'holdout' END AS part FROM vo WHERE total >= 180),
{_long('vl', 'vp')}, vd AS (SELECT * FROM vl WHERE part = 'discover'), {_splits('vs', 'vd')},
ru AS (SELECT condition, CASE bucket WHEN 0 THEN '<' ELSE '>' END AS op, round(CASE bucket WHEN 0 THEN high ELSE low END, 6) AS threshold FROM vs WHERE vs_all < 0 AND bucket <> 1),
ba AS (SELECT part, {_n} FROM vp GROUP BY part),
le AS (SELECT condition, op, threshold, part, {_n} FROM vl JOIN ru USING (condition) WHERE NOT coalesce(CASE op WHEN '<' THEN value < threshold ELSE value > threshold END, false) GROUP BY ALL),
pe AS (SELECT le.*, ba.hit AS base_hit, ba.score AS base_score FROM le JOIN ba USING (part)),
wi AS (SELECT condition, op, threshold, {', '.join(f"max({c}) FILTER (WHERE part = '{p}') AS {p}_{c}" for p in study.PARTS for c in _per)} FROM pe GROUP BY ALL),
wp AS (SELECT *, row_number() OVER (ORDER BY discover_score DESC NULLS LAST, condition, op) AS place FROM wi),
wv AS (SELECT *, {_beats('discover')} AS won, {_beats('discover')} AND place <= 20 AND {_beats('confirm')} AS survived FROM wp),
found AS (SELECT * REPLACE ({', '.join(f'CASE WHEN chosen THEN holdout_{c} END AS holdout_{c}' for c in _per)}) FROM (SELECT *, survived AND place = min(place) FILTER (WHERE survived) OVER () AS chosen FROM wv)),
opened AS (SELECT condition, op, threshold, holdout_n AS n, holdout_base_hit AS without, holdout_hit AS with_rule, trials FROM (SELECT *, count(*) OVER () AS trials FROM found) WHERE chosen AND holdout_n >= 300 AND holdout_hit - holdout_base_hit >= 0.07::DOUBLE)"""
_split = ["bucket", "n", "hit", "vs_all", "error", "low", "high"]
_found = ["threshold", *(f"{p}_{c}" for p in study.PARTS for c in _per), "place"]
_flags = ["won", "survived", "chosen"]
add(
    "study_splits",
    lambda spark, d: flat(study.splits(study.long_form(_verdicts(spark, d), CONDITIONS)), ["condition"], _split),
    rows(["condition"], {c: c for c in _split}, f"{VERDICTS}, {_long('vl', 'verdicts')}, {_splits('vs', 'vl')}||vs"),
)
add(
    "rule_search",
    lambda spark, d: flat(study.search(_verdicts(spark, d), CONDITIONS).withColumns({c: F.col(c).cast("double") for c in _flags}), ["condition", "op"], _found + _flags),
    rows(["condition", "op"], {c: c for c in _found} | {c: f"CAST({c} AS DOUBLE)" for c in _flags}, f"{SEARCH}||found"),
)


def _gated(spark, d):
    """Rows that a rule would keep silent at; the rule is the best of the search, whether or not the gate lets it through."""
    v = _verdicts(spark, d)
    found = study.search(v, CONDITIONS)
    out = study.abstains(v, found.where("place = 1").select("condition", "op", "threshold"), CONDITIONS)
    gated = study.abstains(out.withColumnRenamed("abstain", "best_abstains"), study.gate(found), CONDITIONS)
    return gated.select("symbol", "ts", F.col("best_abstains").cast("double").alias("best_abstains"), F.col("abstain").cast("double").alias("abstain"))


_says = lambda t: f"coalesce(CASE {t}.op WHEN '<' THEN v < {t}.threshold ELSE v > {t}.threshold END, false)"
_value = lambda t: f"CASE {t}.condition " + " ".join(f"WHEN '{c}' THEN verdicts.{c}" for c in CONDITIONS) + " END"
add(
    "abstain_gate",
    lambda spark, d: flat(_gated(spark, d), ["symbol", "ts"], ["best_abstains", "abstain"]),
    rows(
        ["symbol", "ts"],
        {"best_abstains": "CAST(x AS DOUBLE)", "abstain": "CAST(y AS DOUBLE)"},
        f"{SEARCH}, one AS (SELECT * FROM found WHERE place = 1), ab AS (SELECT verdicts.symbol, verdicts.ts, {_says('one').replace(' v ', ' ' + _value('one') + ' ')} AS x, {_says('opened').replace(' v ', ' ' + _value('opened') + ' ')} AS y FROM verdicts LEFT JOIN one ON true LEFT JOIN opened ON true)||ab",
    ),
)
