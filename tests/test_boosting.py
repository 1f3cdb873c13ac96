"""Boosted quantiles against a plain numpy boosting, and against what a constant can reach."""

import math

import numpy as np
import pytest

from tidebar.operators import boosting
from tidebar.operators.boosting import Model, Settings


def planted(n, seed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.normal(size=n)
    y = 1.5 * np.sign(a) + np.where(b == 2, 2.0, 0.5) * rng.normal(size=n)
    return a, b, c, np.round(y, 2), np.arange(n) % 997


def frame(spark, n=3000, seed=3):
    a, b, c, y, t = planted(n, seed)
    rows = [(float(i), float(j), float(k), float(v), int(w)) for i, j, k, v, w in zip(a, b, c, y, t)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, t long"), np.stack([a, b, c], 1), y, t


def at(values, level):
    v = np.sort(values)
    p = level * (len(v) - 1)
    low = v[math.floor(p)]
    return low + (v[math.ceil(p)] - low) * (p - math.floor(p))


def by_hand(x, y, model, cuts, s):
    """One model, node by node and bin by bin."""
    bins = np.stack([[sum(c < v for c in cut) for v in col] for col, cut in zip(x.T, cuts)], 1)
    f = np.full(len(y), at(y, model.level))
    force = lambda n, low: (low * (1 - model.level) - (n - low) * model.level) ** 2 / (n + s.ridge)
    trees = []
    for turn in range(s.rounds):
        r, node, splits = y - f, np.zeros(len(y), int), {}
        for d in range(s.depth):
            after = 2 * node
            for v in sorted(set(node)):
                m = node == v
                best = None
                for j in boosting.looked_at(s, x.shape[1], model, turn, d, v):
                    for b in range(s.bins):
                        left = m & (bins[:, j] <= b)
                        right = m & ~left
                        if left.sum() < s.least or right.sum() < s.least:
                            continue
                        low = r <= 0
                        gain = force(left.sum(), (left & low).sum()) + force(right.sum(), (right & low).sum()) - force(m.sum(), (m & low).sum())
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, j, b)
                if best:
                    splits[d, v] = best[1:]
                    after[m & (bins[:, best[1]] > best[2])] += 1
            node = after
        values = np.array([s.rate * at(r[node == v], model.level) if (node == v).any() else 0.0 for v in range(2**s.depth)])
        f = f + values[node]
        trees.append((splits, values))
    return trees, f


@pytest.mark.parametrize("keep", [256, 4])
def test_trees_equal_those_of_numpy(spark, monkeypatch, keep):
    monkeypatch.setattr(boosting, "KEEP", keep)
    monkeypatch.setattr(boosting, "EVERY", 2)
    d, x, y, t = frame(spark, 1500)
    s = Settings(rounds=3, rate=0.3, least=60, share=0.7, bins=16)
    asked = [Model("y", 0.1), Model("y", 0.5, until=600.0), Model("y", 0.9)]
    got = boosting.fit(d.repartition(5), "t", ["a", "b", "c"], asked, s)
    for m in got.models:
        mine = np.ones(len(y), bool) if m.until is None else t <= m.until
        trees, _ = by_hand(x[mine], y[mine], m, got.cuts, s)
        assert m.base == at(y[mine], m.level)
        for (splits, values), (want, leaf) in zip(m.trees, trees, strict=True):
            assert splits == want
            assert np.allclose(values, leaf, rtol=0, atol=1e-12)
    again = boosting.fit(d.repartition(2, "c"), "t", ["a", "b", "c"], asked, s)
    assert [[(a, list(v)) for a, v in m.trees] for m in again.models] == [[(a, list(v)) for a, v in m.trees] for m in got.models]


def test_planted_signal_is_learned(spark):
    d, *_ = frame(spark, 3000, 5)
    s = Settings(rounds=25, rate=0.15, least=50, share=1.0, bins=32)
    fitted = boosting.fit(d, "t", ["a", "b", "c"], [Model("y", q) for q in (0.1, 0.5, 0.9)], s)
    new, x, y, _ = frame(spark, 2000, 6)
    p = np.array([r.predicted for r in boosting.predict(new, fitted).orderBy("a").collect()])
    y = y[np.argsort(x[:, 0])]
    loss = lambda f, q: np.maximum(q * (y - f), (q - 1) * (y - f)).mean()
    for i, q in enumerate((0.1, 0.5, 0.9)):
        assert loss(p[:, i], q) < 0.75 * loss(np.quantile(y, q), q)
        assert abs((y <= p[:, i]).mean() - q) < 0.04


def test_odd_rows(spark):
    rows = [(1.0, 2.0, i, 1.0 if i % 2 else None) for i in range(40)] + [(None, 1.0, 1, 1.0), (float("nan"), 1.0, 1, 5.0)]
    d = spark.createDataFrame(rows, "a double, b double, t long, y double")
    fitted = boosting.fit(d, "t", ["a", "b"], [Model("y", 0.5), Model("y", 0.5, until=-1.0)], Settings(rounds=2))
    assert [m.base for m in fitted.models] == [1.0, None]
    got = [tuple(r.predicted) if r.predicted else None for r in boosting.predict(d, fitted).collect()]
    assert got == [(1.0, None)] * 40 + [None, None]
    empty = boosting.fit(d.limit(0), "t", ["a", "b"], [Model("y", 0.5)], Settings(rounds=1))
    assert empty.models[0].base is None
    assert boosting.predict(d.limit(0), empty).columns == ["a", "b", "t", "y", "predicted"]
