"""Queries of the learning layer: scales, blends against baselines, margins, the learning table and learned curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..functions.series import ratio
from ..operators import boosting, events, learning
from ..operators.recurrence import compute_all
from ..sources.bars import UNITS, bars_daily, bars_hourly
from ..sources.shared import kept
from . import oracle as q
from .study_queries import flat, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql is not None:
        ORACLE[name] = sql


def _scale(base: str) -> str:
    return f"{q.TR.replace('FROM bars', f'FROM {base}')}, {q.seeded('x', 14, q.rma_a(14), 'a', 'tr')}, sc AS (SELECT b.*, nullif(a.y / nullif(close, 0.0::DOUBLE), 0.0::DOUBLE) AS scale FROM {base} b {q.left('a')})"


_before = "ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_mean = lambda by: f"CASE WHEN count(scale) OVER (PARTITION BY {by} {_before}) >= 20 THEN avg(scale) OVER (PARTITION BY {by} {_before}) END"
add(
    "volatility_scale",
    lambda spark, d: flat(learning.volatility_scale(bars_hourly(spark, d), True), ["symbol", "ts"], ["scale"]),
    rows(
        ["symbol", "ts"],
        {"scale": "CASE WHEN n < 200 THEN scale ELSE scale / least(greatest(coalesce(nullif(h / nullif(g, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 0.4::DOUBLE), 2.5::DOUBLE) END"},
        f"{_scale('hours')}, sd AS (SELECT *, ts % 86400000 // 3600000 AS hr FROM sc), sh AS (SELECT *, {_mean('symbol, hr')} AS h, {_mean('symbol')} AS g, count(*) OVER (PARTITION BY symbol) AS n FROM sd)||sh",
        q.HOURLY,
    ),
)

# A model that SQL can state: the mean and deviation of the last 20 returns, in units of scale, spread by normal quantiles.
STEPS, FOLDS, NORMAL = [2, 5], 4, (-1.2816, -0.6745, 0.0, 0.6745, 1.2816)


def _scored(spark, d):
    t = compute_all(bars_daily(spark, d), [("atr", {})], lambda *_: "_atr").withColumn("scale", F.nullif(ratio(F.col("_atr"), F.col("close")), F.lit(0.0)))
    t = t.withColumn("z", ratio(F.log(ratio(F.col("close"), s.lag("close"))), F.col("scale")))
    t = t.withColumns({"m": s.sma("z", 20), "sd": s.full(F.stddev_samp("z"), "z", 20), **{f"y{h}": ratio(F.log(ratio(s.lead("close", h), F.col("close"))), F.col("scale")) for h in STEPS}})
    t = t.where("m IS NOT NULL AND sd IS NOT NULL AND y2 IS NOT NULL AND y5 IS NOT NULL").select("ts", "scale", "m", "sd", "y2", "y5")
    model = lambda fold, step: F.array(*[F.col("m") * step + z * F.col("sd") * F.sqrt(step.cast("double")) for z in NORMAL])
    return kept(learning.against_baselines(t, STEPS, FOLDS, 5 * UNITS["d"], model))


def _margins(spark, d):
    scored = _scored(spark, d)
    return flat(learning.margins(scored, learning.carried(scored)), ["step"], ["low", "high", "margin", "coverage"])


_list = lambda xs: f"[{', '.join(f'{x}::DOUBLE' for x in xs)}]"
_pin = lambda truth, guess: f"greatest(q * ({truth} - {guess}), (q - 1) * ({truth} - {guess}))"
SCORED = f"""{_scale('bars')}, za AS (SELECT *, ln(close / {q.lag('close')}) / scale AS z, ln({q.lead('close', 2)} / close) / scale AS y2, ln({q.lead('close', 5)} / close) / scale AS y5 FROM sc),
zb AS (SELECT *, {q.full('avg', 'z', 20)} AS m, {q.full('stddev_samp', 'z', 20)} AS sd FROM za),
zc AS (SELECT * FROM zb WHERE m IS NOT NULL AND sd IS NOT NULL AND y2 IS NOT NULL AND y5 IS NOT NULL),
zs AS (SELECT min(ts) AS a, max(ts) AS e FROM zc),
zf AS (SELECT zc.*, fold, CASE WHEN ts <= a + (e - a) * fold / 5.0::DOUBLE THEN 'train' WHEN ts > a + (e - a) * fold / 5.0::DOUBLE + {5 * UNITS['d']} AND ts <= a + (e - a) * (fold + 1) / 5.0::DOUBLE THEN 'test' END AS part FROM zc, zs, (SELECT unnest([1, 2, 3, 4]) AS fold)),
zg AS (SELECT * FROM zf WHERE fold IN (SELECT fold FROM zf GROUP BY fold HAVING count(*) FILTER (WHERE part = 'train') >= 200 AND count(*) FILTER (WHERE part = 'test') >= 60)),
zl AS (SELECT *, 2 AS step, y2 AS y FROM zg UNION ALL SELECT *, 5 AS step, y5 AS y FROM zg),
qa AS (SELECT fold, step, quantile_cont(y, {list(learning.LEVELS)}) AS bs, quantile_cont(y * scale, {list(learning.LEVELS)}) AS ps FROM zl WHERE part = 'train' GROUP BY fold, step),
qb AS (SELECT fold, step, unnest({_list(learning.LEVELS)}) AS q, unnest({_list(NORMAL)}) AS k, unnest(bs) AS base, unnest(ps) AS plain FROM qa),
te AS (SELECT fold, step, q, symbol, ts, y, scale, m * step + k * sd * sqrt(step) AS model, base, plain FROM zl JOIN qb USING (fold, step) WHERE part = 'test'),
gl AS (SELECT fold, step, w, avg({_pin('y * scale', '((w * model + (1 - w) * base) * scale)')}) AS loss, avg({_pin('y * scale', 'plain')}) AS plain FROM te, (SELECT unnest({_list(learning.GRID)}) AS w) GROUP BY fold, step, w),
gb AS (SELECT fold, step, arg_min(w, (loss, w)) AS best FROM gl GROUP BY fold, step),
gc AS (SELECT *, coalesce(lag(best) OVER (PARTITION BY step ORDER BY fold), 0.0::DOUBLE) AS weight FROM gb)"""
add(
    "blend_report",
    lambda spark, d: flat(learning.report(learning.carried(_scored(spark, d))), ["step"], ["folds", "skill", "blend_skill", "vol_skill", "weight"]),
    rows(
        ["step"],
        {"folds": "n", "skill": "1 - lm / lv", "blend_skill": "1 - lb / lv", "vol_skill": "1 - lv / lp", "weight": "wt"},
        f"""{SCORED}, gr AS (SELECT step, count(DISTINCT fold) AS n, avg(loss) FILTER (WHERE w = 1) AS lm, avg(loss) FILTER (WHERE w = 0) AS lv, avg(loss) FILTER (WHERE w = weight) AS lb, avg(gl.plain) FILTER (WHERE w = 0) AS lp, arg_max(best, fold) AS wt FROM gl JOIN gc USING (fold, step) GROUP BY step)||gr""",
    ),
)
add(
    "blend_margins",
    _margins,
    rows(
        ["step"],
        {"low": "low", "high": "high", "margin": "margin", "coverage": "coverage"},
        f"""{SCORED}, mx AS (SELECT step, fold, symbol, ts, any_value(y) AS y, {', '.join(f"max(weight * model + (1 - weight) * base) FILTER (WHERE q = {x}::DOUBLE) AS b{int(100 * x)}" for x in learning.LEVELS)} FROM te JOIN gc USING (fold, step) GROUP BY step, fold, symbol, ts),
mb AS ({' UNION ALL '.join(f"SELECT step, {a}::DOUBLE AS low, {b}::DOUBLE AS high, {t}::DOUBLE AS target, greatest(b{int(100 * a)} - y, y - b{int(100 * b)}) AS miss FROM mx" for a, b, t in learning.BANDS)}),
mv AS (SELECT step, low, high, list(miss ORDER BY miss) AS v, (count(*) - 1) * least(0.999::DOUBLE, any_value(target) * (1 + 1.0::DOUBLE / count(*))) AS p FROM mb GROUP BY step, low, high),
mm AS (SELECT *, greatest(0.0::DOUBLE, v[CAST(floor(p) AS INT) + 1] + (p - floor(p)) * (v[CAST(ceil(p) AS INT) + 1] - v[CAST(floor(p) AS INT) + 1])) AS margin FROM mv),
mo AS (SELECT *, CAST(len(list_filter(v, lambda x: x <= margin)) AS DOUBLE) / len(v) AS coverage FROM mm)||mo""",
    ),
)


def _events(bars):
    return events.detect(bars).select("symbol", "ts", "severity", F.lit(True).alias("chart"), F.lit(False).alias("scheduled"))


def _table(spark, d):
    bars = bars_daily(spark, d)
    return learning.learning_table(bars, learning.horizon_steps(24), events=_events(bars))


#: Rounds of `quantile_forecast`; the operator's default is 80. Each round is at least four passes over the table.
ROUNDS = 20


def _forecast(spark, d):
    bars, steps = bars_daily(spark, d), learning.horizon_steps(10, 2)
    table, features = learning.learning_table(bars, steps, analogs=False)
    table = kept(table)
    learned = learning.train(table, features, steps, 10 * UNITS["d"], 3, boosting.Settings(rounds=ROUNDS))
    return flat(learning.curves(table, learned), ["symbol", "ts"], ["step", "p10", "p25", "p50", "p75", "p90", "prob_up", "weight"], 4)


add("learning_table", lambda spark, d: _table(spark, d)[0])
add("quantile_forecast", _forecast)
