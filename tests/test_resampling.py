"""Block lengths, block bootstraps, searches under the null and similarity features against plain numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_market import candle_rows
from tidebar.operators import resampling, retrieval
from tidebar.sources.bars import CANDLE


def ar1(n, phi, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    return x


def block_by_hand(x):
    """Politis and White's circular block length, lag by lag."""
    n = len(x)
    if n < 50:
        return max(1, n // 4)
    e = x - x.mean()
    run = max(5, int(math.log10(n)))
    most = math.ceil(math.sqrt(n)) + run
    cov = [float(e[k:] @ e[: n - k]) / n for k in range(most + 1)]
    cor = [abs(float(e[k:] @ e[: n - k])) / math.sqrt(float(e[k + 1 :] @ e[k + 1 :]) * float(e[: n - k - 1] @ e[: n - k - 1])) for k in range(most + 1)]
    cut = 2 * math.sqrt(math.log10(n) / n)
    last = next((i - run for i in range(run, most + 1) if all(c < cut for c in cor[i - run : i])), None)
    width = most if last is None else min(2 * max(last, 1), most)
    g, s = 0.0, cov[0]
    for k in range(1, width + 1):
        flat = 1 if k / width <= 0.5 else 2 * (1 - k / width)
        g, s = g + 2 * flat * k * cov[k], s + 2 * flat * cov[k]
    best = ((2 * g * g) / (4 / 3 * s * s)) ** (1 / 3) * n ** (1 / 3)
    return int(max(1, min(round(min(best, math.ceil(min(3 * math.sqrt(n), n / 3)))), n // 4)))


def test_pick_block(spark, monkeypatch):
    series = {"noise": ar1(400, 0.0, 1), "some": ar1(700, 0.5, 2), "strong": ar1(1500, 0.9, 3), "short": ar1(20, 0.5, 4), "one": np.array([3.0]), "flat": np.ones(90), None: ar1(300, 0.7, 5)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("some", -1, None), ("some", -2, float("nan"))]
    d = spark.createDataFrame(rows, "key string, t long, x double").where("key IS NOT NULL")
    want = {k: block_by_hand(x) if k != "flat" else 1 for k, x in series.items() if k}
    for part in (8192, 64):
        monkeypatch.setattr(resampling, "PART", part)
        got = {r.key: (r.n, r.block) for r in resampling.pick_block(d, ["key"], ["t"], "x").collect()}
        assert got == {k: (len(series[k]), b) for k, b in want.items()}
    assert want["noise"] < want["some"] < want["strong"]
    (whole,) = resampling.pick_block(d.where("key = 'some'"), [], ["t"], "x").collect()
    assert whole.block == want["some"]
    assert resampling.pick_block(d.limit(0), ["key"], ["t"], "x").count() == 0


def draw(n, *parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) % n


def means_by_hand(key, x, block, rounds, seed):
    n = len(x)
    block = max(1, min(block, max(1, n // 4)))
    out = []
    for r in range(1, rounds + 1):
        got = []
        for j in range(1, math.ceil(n / block) + 1):
            at = draw(n, seed, key, r, j)
            got += [x[(at + i) % n] for i in range(block)]
        out.append(float(np.mean(got[:n])))
    return np.array(out)


def test_bootstrap_verdict(spark):
    series = {"a": ar1(60, 0.6, 1) + 0.8, "b": ar1(37, 0.0, 2), "tiny": np.array([1.0, 2.0, 3.0])}
    d = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("b", 99, None)], "key string, t long, x double")
    blocks = spark.createDataFrame([("a", 7), ("b", 50), ("tiny", 1)], "key string, block long")
    got = {r.key: r for r in resampling.bootstrap_verdict(d, blocks, 40, 3).collect()}
    for k, block in (("a", 7), ("b", 9)):
        x = series[k]
        null, spread = means_by_hand(k, x - x.mean(), block, 40, 3), means_by_hand(k, x, block, 40, 4)
        assert (got[k].n, got[k].block) == (len(x), block) and got[k].mean == pytest.approx(x.mean())
        assert got[k].p == pytest.approx(((null >= x.mean()).sum() + 1) / 41)
        assert (got[k].lo, got[k].hi) == pytest.approx(tuple(np.percentile(spread, [2.5, 97.5])))
    assert got["tiny"].n == 3 and got["tiny"].mean is None and got["tiny"].p is None
    assert got["a"].p < got["b"].p
    assert resampling.bootstrap_verdict(d.where("key = 'a'"), None, 20).first().block == block_by_hand(series["a"])


def test_null_best_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    n, block, rounds = 205, 10, 12
    hit, flags = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, (n, 3)).astype(bool)
    flags[:, 2] = False
    hit[::40] = np.nan
    rows = [(i, None if np.isnan(h) else float(h), *map(bool, f)) for i, (h, f) in enumerate(zip(hit, flags))]
    d = spark.createDataFrame(rows, "t long, hit double, c0 boolean, c1 boolean, c2 boolean")
    got = {r.round: r.best for r in resampling.null_best(d, ["t"], "hit", ["c0", "c1", "c2"], block, rounds, 20, 5).collect()}
    assert sorted(got) == list(range(rounds + 1))
    m = n // block
    for s in range(rounds + 1):
        a, c = resampling._step(m, 5, s)
        moved = hit.copy()
        for b in range(m):
            to = (a * b + c) % m
            moved[to * block : to * block + block] = hit[b * block : b * block + block]
        assert np.nansum(moved) == np.nansum(hit)
        best = -math.inf
        for k in range(3):
            own = moved[flags[:, k] & ~np.isnan(moved)]
            if len(own) >= 20:
                best = max(best, (own.mean() - 0.5) * math.sqrt(len(own)))
        assert got[s] == pytest.approx(best)
    assert len({round(v, 9) for v in got.values()}) > 5
    assert resampling.null_best(d.limit(0), ["t"], "hit", ["c0"], block, 2).count() == 0


def test_analog_features_by_hand(spark, monkeypatch):
    length, horizon, k = 12, 6, 4
    rows = candle_rows(130, "A", 1) + candle_rows(90, "B", 2) + candle_rows(25, "C", 3)
    d = spark.createDataFrame(rows, CANDLE)
    for size in (512, 17):
        monkeypatch.setattr(retrieval, "BLOCK", size)
        got = {(r.symbol, r.ts): r for r in retrieval.analog_features(d, length, horizon, k).collect()}
        assert len(got) == len(rows)
        for name in "ABC":
            bars = [r for r in rows if r[0] == name]
            close = np.array([r[5] for r in bars])
            n, gap = len(close), max(horizon, length // 2)
            z = np.array([(w - w.mean()) / w.std() for w in np.lib.stride_tricks.sliding_window_view(close, length)])
            for i, r in enumerate(bars):
                q, own = i - length + 1, got[name, r[1]]
                some = [j for j in range(0, q - gap + 1) if j + length - 1 + horizon < n] if q >= 0 else []
                if n < length + horizon + k + 10 or len(some) < k:
                    assert own.analog_median is None
                    continue
                best = sorted(some, key=lambda j: (-round(float(z[q] @ z[j]) / length, 12), j))[:k]
                out = np.array([math.log(close[j + length - 1 + horizon] / close[j + length - 1]) for j in best])
                corr = [float(z[q] @ z[j]) / length for j in best]
                want = [math.tanh(np.median(out) / 0.05), math.tanh(out.mean() / 0.05), (out > 0).mean() * 2 - 1, math.tanh(out.std(ddof=1) / 0.05), max(corr), float(np.mean(corr))]
                assert [own[c] for c in retrieval.COLUMNS] == pytest.approx(want, abs=1e-9)


def test_analog_features_do_not_look_ahead(spark):
    twins = candle_rows(150, "A") + candle_rows(150, "B", tamper=100)
    got = retrieval.analog_features(spark.createDataFrame(twins, CANDLE), 12, 6, 4).where(F.col("ts") <= 100 * 86_400_000)
    rows = {(r.symbol, r.ts): r[2:] for r in got.collect()}
    assert all(rows["A", t] == pytest.approx(v, nan_ok=True) if v[0] is not None else rows["A", t][0] is None for (s, t), v in rows.items() if s == "B")


def test_set_of_the_best_models_against_numpy(spark):
    rng = np.random.default_rng(11)
    n, block, rounds = 400, 7, 200
    noise = ar1(n, 0.5, 12)
    losses = {"a": np.abs(noise), "b": np.abs(noise) + rng.normal(0, 0.05, n), "c": np.abs(noise) + 0.4 + rng.normal(0, 0.05, n), "d": np.abs(noise) - 0.3 + rng.normal(0, 0.05, n)}
    rows = [(k, f"s{i % 2}", i // 2, float(v[i])) for k, v in losses.items() for i in range(n)]
    # Rows that are not of all models count for none; one that comes twice counts once.
    rows += [("a", "s9", 5, 100.0), ("b", "s9", 5, None), *rows[:3]]
    got = {r.model: r for r in resampling.model_confidence(spark.createDataFrame(rows, "model string, symbol string, ts long, loss double"), "a", block, rounds, seed=5).collect()}
    mean = {k: v.mean() for k, v in losses.items()}
    draws = math.ceil(n / block)
    sample = {k: [] for k in losses}
    for r in range(1, rounds + 1):
        at = []
        for j in range(1, draws + 1):
            start = int(hashlib.md5(f"5:all:{r}:{j}".encode()).hexdigest()[:12], 16) % n
            at += [(start + o) % n for o in range(block if j < draws else n - (draws - 1) * block)]
        for k, v in losses.items():
            sample[k].append(v[at].mean())
    names, p, want = sorted(losses), 0.0, {}
    while len(names) > 1:
        err = {k: np.array(sample[k]) - mean[k] for k in names}
        middle, centre = sum(err.values()) / len(names), sum(mean[k] for k in names) / len(names)
        sd = {k: math.sqrt(((err[k] - middle) ** 2).mean()) for k in names}
        z = {k: (mean[k] - centre) / sd[k] for k in names}
        worst = max(names, key=z.get)
        p = max(p, float(np.mean([max((err[k][r] - middle[r]) / sd[k] for k in names) > z[worst] for r in range(rounds)])))
        want[worst] = p
        names.remove(worst)
    want[names[0]] = 1.0
    assert {k: r.n for k, r in got.items()} == dict.fromkeys(losses, n)
    for k, r in got.items():
        assert r.loss == pytest.approx(mean[k]) and r.p == pytest.approx(want[k], abs=1e-9) and r.included == (want[k] > 0.1)
    assert [k for k, r in sorted(got.items()) if r.included] == ["d"] and got["a"].beaten_p == 0.0
    worse = resampling.model_confidence(spark.createDataFrame([r for r in rows if r[0] != "d"], "model string, symbol string, ts long, loss double"), "a", block, rounds, seed=5).collect()
    assert {r.model for r in worse if r.included} == {"a", "b"} and worse[0].beaten_p > 0.1
    far = resampling.model_confidence(spark.createDataFrame([r for r in rows if r[0] in "ac"], "model string, symbol string, ts long, loss double"), "a", block, rounds, seed=5).collect()
    assert {(r.model, r.included, r.beaten_p) for r in far} == {("a", True, 1.0), ("c", False, 1.0)}  # far worse than the base


def test_models_without_common_rows_have_no_result(spark):
    schema = "model string, symbol string, ts long, loss double"
    apart = spark.createDataFrame([("a", "s", i, 1.0) for i in range(9)] + [("b", "s", 100 + i, 1.0) for i in range(9)], schema)
    assert resampling.model_confidence(apart, "a", 2, 20).count() == 0
    assert resampling.model_confidence(apart.limit(0), "a", 2, 20).count() == 0
    alike = spark.createDataFrame([(m, "s", i, 1.0) for m in "ab" for i in range(9)], schema)
    assert {(r.model, r.included, r.beaten_p) for r in resampling.model_confidence(alike, "a", 2, 20).collect()} == {("a", True, 1.0), ("b", True, 1.0)}
