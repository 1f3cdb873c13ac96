"""The search for rules that abstain, on planted panels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import study

SCHEMA = "symbol string, ts long, hit double, predicted double, error double, a double, b double, flat double, rare double"


def panel(spark, planted: bool, n: int = 6000, seed: int = 5):
    """a tells failures where planted: above 2 every forecast fails, below half of them hit plus a little."""
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 30, n) / 10, r.normal(size=n).round(3)
    hit = (r.random(n) < np.where(planted & (a > 2), 0.05, 0.65)).astype(float)
    df = pd.DataFrame({"symbol": [f"s{i % 7}" for i in range(n)], "ts": np.arange(n) // 7, "hit": hit, "predicted": r.normal(size=n), "error": r.random(n), "a": a, "b": b, "flat": 1.0, "rare": np.where(np.arange(n) % 200 == 0, b, np.nan)})
    df.loc[df.index % 11 == 0, "b"] = np.nan
    df.loc[df.index % 13 == 0, "hit"] = np.nan
    return df, spark.createDataFrame(df.astype(object).where(df.notna(), None), SCHEMA)


def thirds(d: pd.DataFrame, condition: str):
    """Brute force: buckets by first-come ranks."""
    d = d[d[condition].notna()].sort_values([condition, "ts", "symbol"], kind="stable").reset_index(drop=True)
    at = np.searchsorted([(len(d) - 1) / 3, 2 * (len(d) - 1) / 3], np.arange(len(d)), side="left")
    return d.groupby(at)


def test_splits_against_pandas(spark):
    df, v = panel(spark, True)
    called = df[df.hit.notna()]
    got = {(r.condition, r.bucket): r for r in study.splits(study.long_form(v, ["a", "b", "flat", "rare"])).collect()}
    assert {c for c, _ in got} == {"a", "b"}  # one value, or too few, say nothing
    for c in "ab":
        for k, g in thirds(called, c):
            r = got[c, k]
            assert (r.n, r.low, r.high) == (len(g), g[c].min(), g[c].max())
            assert r.hit == pytest.approx(g.hit.mean()) and r.vs_all == pytest.approx(g.hit.mean() - called.hit.mean(), abs=6e-5)


def test_a_planted_rule_is_found_confirmed_and_let_through(spark):
    df, v = panel(spark, True)
    found = study.search(v, ["a", "b", "flat", "rare"])
    rows = {(r.condition, r.op): r for r in found.collect()}
    best = rows["a", ">"]
    assert best.place == 1 and best.won and best.survived and best.chosen
    assert [k for k, r in rows.items() if r.chosen] == [("a", ">")] and all(r.holdout_n is None for r in rows.values() if not r.chosen)
    # What the rule leaves in each span, by hand.
    d = df[df.hit.notna()].sort_values(["ts", "symbol"]).reset_index(drop=True)
    x, y = int(0.6 * len(d)), int(0.8 * len(d))
    for part, p in (("discover", d[:x]), ("confirm", d[x:y]), ("holdout", d[y:])):
        left = p[~(p.a > best.threshold)]
        assert best[f"{part}_n"] == len(left) and best[f"{part}_hit"] == pytest.approx(left.hit.mean()) and best[f"{part}_up"] == pytest.approx((left.predicted > 0).mean())
        assert best[f"{part}_score"] == pytest.approx((left.hit.mean() - 0.5) * math.sqrt(len(left)), abs=6e-5) and best[f"{part}_base_hit"] == pytest.approx(p.hit.mean())
    rule = study.gate(found)
    assert [(r.condition, r.op, r.trials) for r in rule.collect()] == [("a", ">", len(rows))]
    got = study.abstains(v.select("symbol", "ts", "a", F.lit(9).alias("n")), rule, ["a", "b"]).collect()
    assert len(got) == len(df) and all(r.abstain == (r.a > best.threshold) for r in got)


def test_chance_is_not_let_through(spark):
    _, v = panel(spark, False)
    found = study.search(v, ["a", "b"])
    assert study.gate(found).count() == 0
    assert not any(r.abstain for r in study.abstains(v, study.gate(found), ["a", "b"]).collect())


def test_unknown_values_short_and_empty_tables(spark):
    _, v = panel(spark, True, 150)  # below 180 called rows no span is told
    assert study.search(v, ["a", "b"]).count() == 0 and study.search(v.limit(0), ["a"]).count() == 0
    rule = spark.createDataFrame([("a", "<", 0.5)], "condition string, op string, threshold double")
    rows = spark.createDataFrame([(0.4,), (0.5,), (None,)], "a double")
    assert [r.abstain for r in study.abstains(rows, rule, ["a"]).orderBy(F.desc_nulls_last("a")).collect()] == [False, True, False]
    other = study.abstains(rows.withColumnRenamed("a", "z"), rule, ["a"])  # a condition the rows do not have
    assert {r.abstain for r in other.collect()} == {False}
