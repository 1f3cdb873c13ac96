"""Golden values, causality, separation of symbols, and cross-models of what SQL does not check."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import series as s
from tidebar.operators import analog, backtest, candles, events, forecast, indicators, ledger, levels, recurrence, signals  # noqa: F401  levels registers its indicators
from tidebar.sources.bars import CANDLE, read_csv, to_ms
from tidebar.streaming import bars as streams

DAY = 86_400_000


def candle_rows(n, symbol, seed=1, tamper=None):
    rng, close, out = np.random.default_rng(seed), 100.0, []
    for i in range(n):
        o, close = close, close * math.exp(rng.normal(0.0004, 0.012))
        h, low, v = max(o, close) + abs(rng.normal(0, 0.006)) * close, min(o, close) - abs(rng.normal(0, 0.006)) * close, float(rng.lognormal(6, 0.4))
        k, kv = (3.0, 50.0) if tamper is not None and i > tamper else (1.0, 1.0)
        out.append((symbol, i * DAY, o * k, h * k, low * k, close * k, v * kv, True))
    return out


@pytest.fixture(scope="module")
def twins(spark):
    """A symbol, and its twin whose bars after the 300th are tampered with."""
    return spark.createDataFrame(candle_rows(360, "A") + candle_rows(360, "B", tamper=300), CANDLE).cache()


def series(spark, closes, **cols):
    rows = [("X", i * DAY, float(cols.get("open", closes)[i]), float(cols.get("high", closes)[i]), float(cols.get("low", closes)[i]), float(closes[i]), 1.0, True) for i in range(len(closes))]
    return spark.createDataFrame(rows, CANDLE)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("symbol", "ts").collect()]


def test_golden(spark):
    d = series(spark, [1, 2, 3, 4, 5])
    assert [v[0] for v in values(d.withColumn("y", s.sma("close", 3)), "y")] == [None, None, 2.0, 3.0, 4.0]
    e = recurrence.ema(3)
    assert [e(x) for x in (10, 11, 12, 13)] == [None, None, 11.0, 12.0]
    r = recurrence.rma(2)
    assert [r(x) for x in (4, 6, 8, 10)][1:3] == [5.0, 6.5]
    assert values(indicators.add_wma(series(spark, [1, 2, 3]), "close", 3, "y"), "y")[2][0] == pytest.approx(14 / 6)
    bars = series(spark, [10.5, 14], open=[10, 12], high=[11, 15], low=[9, 11])
    assert [v[0] for v in values(bars.withColumn("y", s.true_range()), "y")] == [2.0, 4.5]
    assert values(indicators.compute(series(spark, [7.0] * 20), "rsi"), "rsi")[-1] == (100.0,)


@pytest.mark.parametrize("key", sorted(k for k, i in indicators.REGISTRY.items() if i.causal))
def test_no_indicator_looks_ahead(twins, key):
    outs = indicators.REGISTRY[key].outputs
    got = indicators.compute(twins, key).where(F.col("ts") <= 300 * DAY)
    by = {"A": [], "B": []}
    for r in got.orderBy("ts").collect():
        by[r.symbol].append([None if r[o] is None else round(r[o], 9) for o in outs])
    assert len(by["A"]) == 301 and by["A"] == by["B"] and any(v is not None for row in by["A"] for v in row)


def test_signals_do_not_look_ahead(twins):
    got = signals.evaluate(signals.hits(twins)).where(F.col("ts") <= 300 * DAY).orderBy("ts").collect()
    a, b = ([(r.ts, r.hits, round(r.score, 9), r.direction) for r in got if r.symbol == x] for x in "AB")
    assert a == b and len({h.rule for r in a for h in r[1]}) >= 12 and len(signals.RULES) == 15
    for _, hits, score, direction in a:
        w = sum(h.weight for h in hits)
        assert [h.strength * h.weight for h in hits] == sorted((h.strength * h.weight for h in hits), reverse=True)
        assert score == pytest.approx(sum(h.direction * h.strength * h.weight for h in hits) / w if w else 0.0, abs=1e-8)
        assert direction == (1 if score > 0.15 else -1 if score < -0.15 else 0)


def test_distance_from_the_cloud_is_a_share_of_its_edge(spark):
    """Flat at 100 and then one bar at 102, or 98: 2 % off the cloud, two thirds of full strength."""
    for last, way in ((102.0, 1.0), (98.0, -1.0)):
        hits = signals.hits(series(spark, [100.0] * 90 + [last])).orderBy(F.desc("ts")).first().hits
        assert [(h.direction, round(h.strength, 9)) for h in hits if h.rule == "ichimoku_cloud"] == [(way, round(2 / 3, 9))]


def test_short_and_empty_inputs(spark, twins):
    two = twins.where("ts < 2 * 86400000 AND symbol = 'A'")
    for key, spec in indicators.REGISTRY.items():
        if key in ("obv", "ad", "vwap", "psar", "linreg_channel", "candle_patterns", "volume_profile"):
            continue
        assert all(v is None for row in values(indicators.compute(two, key), *spec.outputs) for v in row), key
        assert indicators.compute(two.limit(0), key).count() == 0
    profile = lambda n: values(indicators.compute(twins.where(f"ts < {n} * 86400000 AND symbol = 'A'"), "volume_profile"), "poc")
    assert profile(1) == [(None,)] and all(v[0] is not None for v in profile(2))  # answers from two bars on


def test_settings():
    with pytest.raises(ValueError):
        indicators.settings("bbands", {"nope": 1})
    with pytest.raises(ValueError):
        indicators.settings("pivots", {"kind": "other"})
    with pytest.raises(ValueError):
        indicators.settings("stdev", {"length": 0})
    assert to_ms("15m") == 900_000 and to_ms("1w") == 604_800_000
    for bad in ("1y", "0m", "m", ""):
        with pytest.raises(ValueError):
            to_ms(bad)


def test_supertrend_and_psar_invariants(twins):
    for r in indicators.compute(twins, "supertrend").where("value IS NOT NULL").collect():
        assert r.direction in (1.0, -1.0)
    a = [r for r in indicators.compute(twins, "psar").where("symbol = 'A'").orderBy("ts").collect()]
    assert a[0].value is None
    # A stop lies outside its bar, or is the far point it flipped at.
    assert sum(r.low <= r.value <= r.high for r in a[1:]) < 0.1 * len(a)


def test_fisher_cross_model(twins):
    pdf = twins.where("symbol = 'A'").toPandas().sort_values("ts")
    src = (pdf.high + pdf.low) / 2
    lo, hi = src.rolling(9).min(), src.rolling(9).max()
    x = f = 0.0
    want = []
    for r in 2 * ((src - lo) / (hi - lo) - 0.5):
        if np.isnan(r):
            want.append(None)
            continue
        x = float(np.clip(0.33 * r + 0.67 * x, -0.999, 0.999))
        f = 0.5 * math.log((1 + x) / (1 - x)) + 0.5 * f
        want.append(f)
    got = [v[0] for v in values(indicators.compute(twins.where("symbol = 'A'"), "fisher"), "fisher")]
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_patterns_on_flat_and_plain_bars(spark):
    close = [20, 19, 18, 17, 16, 15, 14]
    flat = indicators.add_patterns(series(spark, close))
    last = flat.orderBy(F.desc("ts")).first()
    assert last.pat_hammer and last.pat_inverted_hammer and not last.pat_doji
    bull = series(spark, [10, 9, 11], open=[10, 10, 8.5], high=[10, 10, 11], low=[10, 9, 8.5])
    assert indicators.add_patterns(bull).orderBy(F.desc("ts")).first().pat_bullish_engulfing


def test_candle_frames(spark):
    rows = spark.createDataFrame([("A", "1000", "1", "2", "1", "1", "5", True, 0), ("A", "1000", "1", "3", "1", "2", "x", True, 1)], "symbol string, ts string, open string, high string, low string, close string, volume string, closed boolean, seq int")
    assert values(candles.to_frame(rows), "ts", "close", "volume") == [(1000, 2.0, None)]
    bad = spark.createDataFrame([("A", 0, 5.0, 4.0, 4.5, 6.0, -1.0, False), ("A", 3, 1.0, 1.0, 1.0, 1.0, 1.0, True)], CANDLE)
    got = {r.rule for r in candles.validate(bad, 2).collect()}
    assert got == {"high_below_low", "open_outside", "close_outside", "negative_volume", "open_bar_before_last", "off_grid"}
    new = bad.where("ts = 3").withColumn("close", F.lit(9.0))
    assert sorted(values(candles.upsert(bad, new), "ts", "close")) == [(0, 6.0), (3, 9.0)]


def test_csv(spark, tmp_path):
    (tmp_path / "ABC_1d.csv").write_text("Date,O,H,L,Adj Close,Vol\n1700000000,1,2,0.5,1.5,10\n1700086400000,1,2,0.5,1.6,\nbad,1,2,3,4,5\n2023-11-17T00:00:00Z,1,2,0.5,1.7,3\n")
    assert values(read_csv(spark, str(tmp_path)), "symbol", "ts", "close", "volume") == [("ABC", 1700000000000, 1.5, 10.0), ("ABC", 1700086400000, 1.6, 0.0), ("ABC", 1700179200000, 1.7, 3.0)]


def test_backtest_counts_every_bar(spark, twins):
    d = twins.where("symbol = 'A'").withColumn("decision", F.when(F.pmod(F.floor(F.col("ts") / DAY / 10), F.lit(3)) == 0, 1).when(F.pmod(F.floor(F.col("ts") / DAY / 10), F.lit(3)) == 1, -1).otherwise(0))
    p = d.toPandas().sort_values("ts").reset_index(drop=True)
    dec = p.decision.where(p.index >= 20, 0)
    pos = dec.shift(1, fill_value=0)
    eq = (1 + (pos * (p.close / p.close.shift(1) - 1)).fillna(0)).cumprod()
    held = backtest.positions(d, "decision", warmup=20)
    assert [v[0] for v in values(backtest.equity(held), "equity")] == pytest.approx(eq.tolist())
    trades = backtest.trades(held).orderBy("entry_ts").collect()
    starts = [i for i in range(1, len(p)) if pos[i] != pos[i - 1] and pos[i] != 0]
    assert [t.entry for t in trades] == pytest.approx([p.open[i] for i in starts])
    t = trades[0]
    assert t.ret == pytest.approx(t.direction * (t.exit / t.entry - 1) - 0.002)


def test_events(spark, twins):
    hits = spark.createDataFrame([("A", "up", i, i * 10) for i in (1, 2, 6, 7, 11, 30)], "symbol string, kind string, bar long, ts long")
    assert sorted(r.bar for r in events.cooled(hits, "bar", 5).collect()) == [1, 6, 11, 30]
    left = spark.createDataFrame([("A", 5), ("A", 10), ("A", 99)], "symbol string, ts long")
    right = spark.createDataFrame([("A", 10, "x"), ("A", 20, "y"), ("B", 1, "z")], "symbol string, ts long, v string")
    assert [v[1] for v in values(events.asof(left, right, "v"), "ts", "value")] == [None, "x", "y"]
    assert [v[1] for v in values(events.asof(left, right, "v", forward=True), "ts", "value")] == ["x", "x", None]


def test_forecast_measures(spark):
    assert forecast.expected_max(1) == 0.0 and forecast.expected_max(100) > forecast.expected_max(10) > 0
    assert forecast.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    null = spark.createDataFrame([(0.0,)] * 200, "x double")
    assert forecast.p_value(null, "x", 999.0).first().p == pytest.approx(1 / 201)
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(240, 12))
    for lift in (0.0, 1.2):
        m = noise.copy()
        m[:, 3] += lift
        grid = spark.createDataFrame([(t, c, float(m[t, c])) for t in range(240) for c in range(12)], "t long, candidate int, value double")
        blocks, low = np.array_split(m, 8), []
        for half in combinations(range(8), 4):
            front, back = (np.concatenate([b for i, b in enumerate(blocks) if (i in half) == side]).mean(axis=0) for side in (True, False))
            low.append((back <= back[front.argmax()]).sum() / 13 < 0.5)
        got = forecast.pbo(grid, 8).first().pbo
        assert got == pytest.approx(np.mean(low)) and (lift == 0 or got < 0.1)
    w = spark.createDataFrame([("a", float(v), k) for v, k in ((1, 1.0), (2, 3.0), (4, 1.0))], "g string, v double, w double")
    v, k = np.array([1, 2, 4.0]), np.array([1, 3, 1.0])
    for q in (0.01, 0.3, 0.5, 0.77, 0.99):
        assert forecast.weighted_quantile(w, ["g"], "v", "w", q).first().quantile == pytest.approx(np.interp(q, (np.cumsum(k) - 0.5 * k) / k.sum(), v))
    base = spark.createDataFrame([(i, i, -i) for i in range(20)], "ts long, a long, b long")
    moved = forecast.block_shuffle(base, ["a"], 5, 1).orderBy("ts").collect()
    assert [r.b for r in moved] == [-i for i in range(20)] and sorted(r.a for r in moved) == list(range(20))
    assert all(moved[i].a + 1 == moved[i + 1].a for i in range(0, 20, 5))


def test_dtw_and_shapes(spark, twins):
    a, b = np.array([0, 0, 1, 2, 1, 0, 0, 0.0]), np.array([0, 0, 0, 1, 2, 1, 0, 0.0])
    assert analog._dtw(a[None], a[None], 0.15)[0] == 0.0 and analog._dtw(a[None], b[None], 0.15)[0] < np.sqrt(((a - b) ** 2).mean())
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 12)), rng.normal(size=(5, 12))
    for k, got in enumerate(analog._dtw(x, y, 0.2)):
        cost = np.full((13, 13), np.inf)
        cost[0, 0] = 0
        for i in range(1, 13):
            for j in range(max(1, i - 2), min(12, i + 2) + 1):
                cost[i, j] = (x[k, i - 1] - y[k, j - 1]) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
        assert got == pytest.approx(np.sqrt(cost[12, 12] / 12))
    flat = spark.createDataFrame([([7.0, 7.0, 7.0],)], "v array<double>").select(analog.znorm(F.col("v")).alias("z")).first().z
    assert flat == [0.0, 0.0, 0.0]
    got = analog.search(twins.where("symbol = 'A'"), 24, 10, 60, 8).collect()
    bars = sorted(r.bar for r in got)
    assert all(y - x >= 12 for x, y in zip(bars, bars[1:])) and max(bars) <= 350


def test_analogs_against_brute_force(spark, twins):
    from tidebar.operators import context

    axes = context.situation(twins).toPandas().sort_values(["symbol", "ts"])
    price = {k: g.sort_values("ts") for k, g in twins.toPandas().groupby("symbol")}
    w = np.array(list(context.weights({"calendar": 0.0}).values()))
    length, horizon, keep, top = 24, 10, 60, 6
    z = lambda v: (v - v.mean()) / v.std() if v.std() > 0 else v * 0
    peers = spark.createDataFrame([("A", "A"), ("A", "B")], "symbol string, source string")
    close = price["A"].close.to_numpy()
    mine, q = axes[axes.symbol == "A"][context.AXES].to_numpy()[-1], z(close[-length:])
    found = []
    for source, g in price.items():
        c, ctx = g.close.to_numpy(), axes[axes.symbol == source][context.AXES].to_numpy().astype(float)
        ends = [i for i in range(length - 1, len(c) - horizon)]
        rms = {i: np.sqrt(((z(c[i - length + 1 : i + 1]) - q) ** 2).mean()) for i in ends}
        for i in sorted(ends, key=lambda i: (rms[i], i))[:keep]:
            ok = np.isfinite(ctx[i]) & np.isfinite(mine.astype(float))
            if ok.sum() < 28 * 0.6:
                continue
            apart = np.sqrt((((ctx[i] - mine.astype(float))[ok] * w[ok]) ** 2).sum() / w[ok].sum())
            warp = analog._dtw(z(c[i - length + 1 : i + 1])[None], q[None], 0.15)[0]
            found.append((0.7 * warp + 0.3 * apart, source, i + 1))
    want = []
    for d, source, bar in sorted(found):
        if len(want) < top and not any(s == source and abs(b - bar) < 12 for _, s, b in want):
            want.append((d, source, bar))
    rows = analog.search(twins, length, horizon, keep, top, context_weight=0.3, group_weights={"calendar": 0.0}, peers=peers).where("symbol = 'A'").orderBy("distance").collect()
    assert [(r.source, r.bar) for r in rows] == [(s, b) for _, s, b in want] and [r.distance for r in rows] == pytest.approx([d for d, _, _ in want])
    half = analog.search(twins.withColumn("m", F.col("ts") % 2 == 0).where("symbol = 'A'"), length, horizon, keep, top, mask="m")
    assert half.count() > 0 and half.where("ts % 2 <> 0").count() == 0


def test_bands_widen_where_matches_do_not_cover_each_other(spark):
    ends = [0.5, -0.5, 0.001, 0.002, 0.003, 0.004]
    m = spark.createDataFrame([("A", 1.0, [0.0, e]) for e in ends] + [("B", 1.0, [0.0, e]) for e in ends[:4]], "symbol string, distance double, path array<double>")
    got = {r.symbol: r for r in analog.coverage(m).collect()}
    assert got["A"].coverage == pytest.approx(4 / 6) and got["A"].widen == pytest.approx(0.8 / (4 / 6))
    assert got["B"].coverage is None and got["B"].widen == 1.0
    last = analog.project(m).where("symbol = 'A' AND step = 1").first()
    v = np.sort(ends)
    plain = {x: np.interp(x, (np.arange(6) + 0.5) / 6, v) for x in (0.1, 0.5, 0.9)}
    assert last.q90 == pytest.approx(plain[0.5] + (plain[0.9] - plain[0.5]) * 1.2) and last.q10 == pytest.approx(plain[0.5] + (plain[0.1] - plain[0.5]) * 1.2)


def test_tick_folding():
    ticks = lambda *rows: pd.DataFrame(rows, columns=["ts", "price", "volume"])
    fold = lambda bar, *rows: (lambda b, out: (b, [tuple(r) for r in out.itertuples(index=False)]))(*streams.fold_ticks(bar, ticks(*rows), 60_000))
    bar, rows = fold(None, (0, 100.0, 1.0), (10, 105.0, 2.0), (20, 95.0, 3.0))
    assert rows == [(0, 100, 100, 100, 100, 1, False), (0, 100, 105, 100, 105, 3, False), (0, 100, 105, 95, 95, 6, False)]
    bar, rows = fold(bar, (60_001, 97.0, 1.0), (7, 1.0, 1.0), (60_002, 99.0, 2.0), (180_000, 5.0, 1.0))
    assert rows == [(0, 100, 105, 95, 95, 6, True), (60_000, 97, 97, 97, 97, 1, False), (60_000, 97, 99, 97, 99, 3, False), (60_000, 97, 99, 97, 99, 3, True), (180_000, 5, 5, 5, 5, 1, False)]
    assert fold(bar, (5, 1.0, 1.0)) == (bar, [])


def test_alert_fires_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [("A", i * DAY, 10.0, 10.0 + i, 9.0 - i, 10.0, 1.0, True) for i in range(5)]
    spark.createDataFrame(rows, CANDLE).coalesce(1).write.parquet(path)
    rules = spark.createDataFrame([("r1", "A", "buy_below", 7.5, True), ("r2", "A", "sell_above", 99.0, True), ("r3", "A", "sell_above", 11.0, False)], "id string, symbol string, kind string, price double, active boolean")
    out = streams.alerts(spark.readStream.schema(CANDLE).parquet(path), rules)
    q = out.writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("fired").collect()] == [("r1", "A", 2 * DAY, 7.5)]


def test_position_plans(spark):
    d = spark.createDataFrame([(100.0, -5.0, 12.0, 6.0), (100.0, -5.0, 12.0, 0.05), (100.0, 1.0, 12.0, 6.0)], "entry double, low double, high double, expected double")
    a, b, c = ledger.plan_from_band(d).collect()
    assert a.stop == pytest.approx(95) and [(round(t.price, 6), t.portion) for t in a.targets] == [(106.0, 0.5), (112.0, 0.5)] and a.risk_pct == pytest.approx(5)
    assert [(round(t.price, 6), t.portion) for t in b.targets] == [(112.0, 1.0)] and c.stop is None
    same = spark.createDataFrame([(100.0, -5.0, 6.0, 6.0), (100.0, -5.0, 6.0, None)], "entry double, low double, high double, expected double")
    one, two = ledger.plan_from_band(same).collect()
    assert [(t.price, t.portion) for t in one.targets] == [(106.0, 0.5), (106.0, 0.5)] and [(t.price, t.portion) for t in two.targets] == [(106.0, 1.0)]
    atr = spark.createDataFrame([(100.0, 0.02), (100.0, 0.0), (100.0, None)], "entry double, atr_pct double")
    x, y, z = ledger.plan_from_atr(atr).collect()
    assert (x.stop, [(t.price, t.portion) for t in x.targets], x.risk_pct) == (97.0, [(103.0, 0.5), (106.0, 0.5)], 3.0) and y.stop is None and z.targets is None
    pos = spark.createDataFrame([(100.0, [(105.0, 1), (110.0, 1), (120.0, None)], 110.0), (100.0, [(105.0, None)], 105.0)], "entry double, targets array<struct<price:double,hit_at:long>>, hit double")
    assert sorted(r.x for r in pos.select(ledger.trail_to(F.col("entry"), F.col("targets"), F.col("hit")).alias("x")).collect()) == [100.0, 105.0]


def test_one_shuffle_for_many_windows(twins):
    df = indicators.compute(indicators.compute(twins, "bbands").drop("upper", "middle", "lower"), "donchian")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 or "InMemory" in plan and plan.count("Exchange hashpartitioning") == 1


def test_splits_are_not_ntile(spark):
    v = spark.createDataFrame([("A", i, float(i), float(i % 2)) for i in range(11)], "symbol string, ts long, cond double, hit double")
    assert [r.n for r in ledger.splits(v, "cond", "hit", 1).orderBy("bucket").collect()] == [4, 3, 4]


def test_spread_buckets_are_not_ntile(spark):
    from tidebar.operators import crosssection

    p = spark.createDataFrame([(f"S{i:02d}", 0, float(i), 1.0) for i in range(12)], "symbol string, ts long, f double, y double")
    assert [r.n for r in crosssection.spread(p, {"f": 1.0}, "y").orderBy("bucket").collect()] == [3, 4, 5]
    assert pd.notna(crosssection.spearman(p.withColumn("y", F.col("f")), "f", "y").first().ic)


def test_volume_profile_and_levels_cross_model(spark, twins):
    pdf = twins.where("symbol = 'A'").toPandas().sort_values("ts")
    edges = np.linspace(pdf.low.min(), pdf.high.max(), 61)
    w = np.zeros(60)
    for lo, hi, v in zip(pdf.low, pdf.high, pdf.volume):
        o = np.clip(np.minimum(edges[1:], hi) - np.maximum(edges[:-1], lo), 0, None)
        w += v * o / o.sum()
    got = indicators.compute(twins.where("symbol = 'A'"), "volume_profile").first()
    p = int(w.argmax())
    assert got.poc == pytest.approx((edges[p] + edges[p + 1]) / 2)
    i, j = int(np.abs(edges - got.val).argmin()), int(np.abs(edges - got.vah).argmin())
    assert w[i:j].sum() >= 0.7 * w.sum() > max(w[i + 1 : j].sum(), w[i : j - 1].sum()) - max(w[i], w[j - 1])
    sw = indicators.compute(twins.where("symbol = 'A'"), "swings").toPandas()
    prices, clusters = sorted([*sw.swing_high.dropna(), *sw.swing_low.dropna()]), []
    for x in prices:
        if clusters and abs(x - clusters[-1][0]) / clusters[-1][0] <= 0.005:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    want = sorted(clusters, key=lambda c: (-len(c), abs(np.mean(c) - pdf.close.iloc[-1])))[:6]
    r = indicators.compute(twins.where("symbol = 'A'"), "support_resistance").first()
    assert [r[f"level{i + 1}"] for i in range(6)] == pytest.approx([np.mean(c) for c in want])
    assert len(indicators.REGISTRY) == 35


def test_places_and_quantiles(spark):
    from tidebar.functions.places import places, quantiles

    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in (("a", 300), ("b", 7), ("c", 1)) for v in rng.integers(0, 40, n)] + [("a", 5.0)] * 400 + [("b", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    known = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    for r in quantiles(d, ["g"], "v", [0.0, 0.1, 0.5, 0.97, 1.0]).collect():
        assert r.quantile == pytest.approx(known[known.g == r.g].v.quantile(r.q))
    assert [r.quantile for r in quantiles(d, [], "v", [0.25]).collect()] == [pytest.approx(known.v.quantile(0.25))]
    p = places(d.where("v IS NOT NULL"), ["g"], ["v"]).orderBy("g", "place").collect()
    assert [r.v for r in p] == sorted(known[known.g == "a"].v) + sorted(known[known.g == "b"].v) + sorted(known[known.g == "c"].v)
    assert all(r.total == len(known[known.g == r.g]) for r in p) and quantiles(d.limit(0), ["g"], "v", [0.5]).count() == 0


def test_detector_golden(spark):
    """Hand-made bars of 100 with a known event each: gap severity, breaks that rest, a calm before a volatility jump."""
    n = 200
    rows = [("A", i * DAY, 100.0, 100.5 + 0.001 * (i % 7), 99.5 - 0.001 * (i % 5), 100.0 + 0.01 * (i % 3), 10.0 + i % 4, True) for i in range(n)]
    rows[170] = ("A", 170 * DAY, 102.0, 103.0, 101.5, 102.0, 10.0, True)  # gap of about 2 % and a new high
    rows[175] = ("A", 175 * DAY, 100.0, 104.0, 99.5, 100.0, 10.0, True)  # a higher high within the rest: not counted
    rows[180] = ("A", 180 * DAY, 100.0, 100.5, 99.6, 100.0, 60.0, True)
    got = {(r.ts // DAY, r.kind): r.severity for r in events.detect(spark.createDataFrame(rows, CANDLE)).collect()}
    assert got[(170, "gap")] == pytest.approx((102.0 / rows[169][5] - 1) / 0.05) and got[(170, "new_high")] == 0.5
    assert (175, "new_high") not in got and got[(180, "volume")] == pytest.approx(min(1, 60 / np.mean([r[6] for r in rows[161:181]]) / 6))
    assert got[(170, "spike")] == pytest.approx((102.0 / rows[169][5] - 1) / 0.15)
    assert events.detect(spark.createDataFrame(rows[:64], CANDLE)).count() == 0


def test_labels_pay_the_close_of_the_hit_bar(spark):
    from tidebar.operators import ranges

    bars = [("A", i, 100.0, 101.0, 99.5, c, 1.0, True, 2.0) for i, c in enumerate((100.0, 100.5, 103.0, 100.0, 97.5, 100.0))]
    bars[2] = ("A", 2, 100.0, 104.5, 99.5, 103.0, 1.0, True, 2.0)
    d = spark.createDataFrame(bars, "symbol string, ts long, open double, high double, low double, close double, volume double, closed boolean, w double")
    first = values(ranges.triple_barrier(d, "w", 3), "label", "hit_bars", "ret")[0]
    assert first == (1.0, 2.0, pytest.approx(0.03))
    none = values(ranges.triple_barrier(d.withColumn("w", F.lit(0.0)), "w", 3), "label")
    assert all(x == (None,) for x in none)


def test_calendar_golden(spark):
    from tidebar.operators import context

    ts = int(pd.Timestamp("2024-11-15T12:00:00Z").timestamp() * 1000)
    r = context.calendar(spark.createDataFrame([("A", ts)], "symbol string, ts long")).first()
    assert r.month_cos == pytest.approx(np.cos(2 * np.pi * 11 / 12)) and r.quarter_sin == pytest.approx(0.0, abs=1e-12)
    assert r.quarter_progress == pytest.approx(45.5 / 92) and r.month_progress == pytest.approx(14 / 29) and (r.asia, r.europe, r.us) == (0.0, 1.0, 0.0)


def test_measures_without_trades_and_short_symbols(spark):
    rows = [("A", i, 10.0, 10.0, 10.0, 10.0 + 0.1 * i, 1.0, True, 0) for i in range(40)] + [("B", i, 10.0, 10.0, 10.0, 10.0, 1.0, True, 1) for i in range(6)]
    d = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double, closed boolean, decision int")
    a, b = backtest.metrics(backtest.positions(d, "decision", warmup=10), warmup=10).orderBy("symbol").collect()
    assert (a.trades, a.win_rate, a.avg_win, a.payoff, a.profit_factor, a.sharpe) == (0, 0.0, 0.0, None, None, None)
    assert a.buy_hold == pytest.approx(13.9 / 11.0 - 1) and (b.trades, b.total_return, b.buy_hold) == (0, 0.0, 0.0)


def test_situation_axes(spark, twins):
    from tidebar.operators import context

    assert len(context.AXES) == 28 and sum(context.weights().values()) == pytest.approx(6.9)
    got = context.situation(twins).where("symbol = 'A'").orderBy("ts").toPandas()
    assert got[context.AXES].iloc[-1].notna().all() and got[context.AXES].abs().max().max() <= 1.0 + 1e-9
    short = context.situation(twins.where("ts < 29L * 86400000"))
    assert all(v is None for r in short.collect() for v in list(r)[2:])
    last = context.describe(twins).where("symbol = 'A'").first()
    assert set(last.axes) == set(context.AXES) and last.volatility in (0.0, 1.0, 2.0)


def test_rank_against_pandas(spark):
    from tidebar.operators import crosssection

    rng = np.random.default_rng(6)
    rows = [(f"S{i}", t, *map(float, rng.normal(size=3))) for i in range(9) for t in (0, 1)] + [("S9", 0, 1.0, None, None)]
    rows = [(s, t, a, b if s < "S4" else None, c) for s, t, a, b, c in rows]
    panel = spark.createDataFrame(rows, "symbol string, ts long, a__rel double, b__rel double, c__rel double").withColumn("plain", F.col("a__rel") * 9)
    rel = [("move", "a", -0.2, True), ("move", "b", 0.3, True), ("move", "c", 0.4, False), ("direction", "c", 0.1, True), ("direction", "a", 0.1, True)]
    usable = spark.createDataFrame([(k, f + "__rel", ic, ok) for k, f, ic, ok in rel] + [("move", "plain", 0.9, True), ("direction", "plain", 0.9, True)], "kind string, factor string, ic double, usable boolean")
    names = ["a__rel", "b__rel", "c__rel", "plain"]
    got = {r.symbol: r for r in crosssection.rank(panel, usable, names).collect()}
    last = pd.DataFrame(rows, columns=["symbol", "ts", "a", "b", "c"]).sort_values("ts").groupby("symbol").tail(1).set_index("symbol")
    z = {f: (last[f].fillna(last[f].median()) - last[f].fillna(last[f].median()).mean()) / last[f].fillna(last[f].median()).std(ddof=0) for f in "ac"}
    move, direction = -z["a"], (z["c"] + z["a"]) / 2  # b is known of four symbols only
    for s, r in got.items():
        assert r.move == pytest.approx(move[s]) and r.direction == pytest.approx(direction[s]) and [w.factor for w in r.why] == ["a__rel"]
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1].place)] == list(move.sort_values(ascending=False).index)
    assert crosssection.rank(panel.where("symbol < 'S4'"), usable, names).count() == 0
    assert crosssection.rank(panel, usable.where("NOT usable"), names).count() == 0
    assert crosssection.rank(panel, usable.where("factor = 'plain'"), names).count() == 0


def test_usable_factors(spark):
    """A factor that orders the symbols as the label does at every time is usable; one without a constant sign is not."""
    from tidebar.operators import crosssection

    rng = np.random.default_rng(9)
    rows = []
    for t in range(1000):
        y = rng.normal(size=7)
        rows += [(f"S{i}", t, float(y[i] + rng.normal()), float(y[i] * (1 if t < 500 else -1)), float(y[i])) for i in range(7)]
    panel = spark.createDataFrame(rows, "symbol string, ts long, good double, turns double, y double")
    got = {r.factor: r for r in crosssection.measure_all(panel, ["good", "turns"], {"direction": "y"}, 3).collect()}
    assert got["good"].usable and got["good"].folds == 4 and got["good"].coverage == 1000 and got["good"].t > 10
    assert not got["turns"].usable
    few = crosssection.measure_all(panel.where("ts < 30"), ["good"], {"direction": "y"}, 3).first()
    assert (few.ic, few.t, few.folds, few.coverage, few.usable) == (0.0, 0.0, 0, 30, False)
    some = crosssection.measure_all(panel.where("ts < 300"), ["good"], {"direction": "y"}, 3).first()
    assert some.folds < 3 and some.ic > 0.3 and not some.usable and crosssection.measure_all(panel.limit(0), ["good"], {"direction": "y"}, 3).first().coverage == 0


def test_scenario_masks_loosen(spark, twins):
    from tidebar.operators import scenario

    a = twins.where("symbol = 'A'")
    ev = a.where(f"ts = {100 * DAY}L").selectExpr("symbol", "ts - 5 AS ts")
    on = lambda **k: scenario.mask(a, **k).where("mask").select(F.floor(F.col("ts") / DAY).alias("d"), "applied").orderBy("d").collect()
    assert [(r.d, r.applied) for r in on(events=ev, least=3)] == [(100, "both"), (101, "both"), (102, "both")]
    assert len(on(events=ev, least=4)) == a.count() and {r.applied for r in on(events=ev, least=4)} == {"none"}
    assert len(on(events=ev.limit(0), least=3)) == a.count() and len(on()) == a.count()
    high = on(volatility=2, least=5)
    assert 0 < len(high) < a.count() and {r.applied for r in high} == {"both"}
    mixed = on(events=ev, volatility=2, least=len(high))
    assert [r.d for r in mixed] == [r.d for r in high] and {r.applied for r in mixed} == {"regime"} or {r.applied for r in mixed} == {"both"}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_time_is_utc_in_any_session_zone(spark, zone, tmp_path):
    """Calendar, session ends, bars of tables without a zone, and CSV times do not move with the session's time zone."""
    from tidebar.operators import context
    from tidebar.plans import study_queries
    from tidebar.sources.bars import session_end

    (tmp_path / "A_1h.csv").write_text("date,open,high,low,close,volume\n2024-03-10 02:30:00,1,1,1,1,1\n2024-03-10T02:30:00Z,1,1,1,1,1\n2024-03-10T04:30:00+02:00,1,1,1,1,1\n2024-03-10,1,1,1,1,1\n1710000000,1,1,1,1,1\n")
    times = [1704067200000, 1710037800000, 1711846800000, 1719791999999, 1735689540000]
    d = spark.createDataFrame([("A", t) for t in times], "symbol string, ts long")

    def seen():
        cal = context.calendar(d).select(*study_queries.CAL).collect()
        ends = d.select(session_end("ts", F.lit("kr")), session_end("ts", F.lit("us"))).collect()
        bars = study_queries.bars_hourly(spark, "/root/testdata/sf0.001").orderBy("symbol", "ts").limit(50).collect()
        daily = study_queries.bars_daily(spark, "/root/testdata/sf0.001").orderBy("symbol", "ts").limit(50).collect()
        return cal, ends, bars, daily, read_csv(spark, f"{tmp_path}/A_1h.csv").select("ts").collect()

    want = seen()
    assert want[0][0][:4] == (0.0, 0.0, 1.0, 1.0) and want[0][1][0] == 2.5 and [r.ts for r in want[4]] == [1710037800000] * 3 + [1710028800000, 1710000000000]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert seen() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_volume_is_the_least_volume_ratio(spark):
    from tidebar.operators import context

    rows = [(*r[:6], 0.0 if i in (50, 59) else r[6], r[7]) for i, r in enumerate(candle_rows(60, "A"))]
    got = {r.ts: r.volume_ratio for r in context.situation(spark.createDataFrame(rows, CANDLE)).collect()}
    assert got[50 * DAY] == got[59 * DAY] == -1.0 and -1 < got[49 * DAY] < 1
    still = context.situation(spark.createDataFrame([(*r[:6], 0.0, r[7]) for r in candle_rows(60, "A")], CANDLE)).select("volume_ratio").distinct().collect()
    assert [r[0] for r in still] == [None]


def test_guards_of_folds_and_pbo(spark):
    panel = spark.createDataFrame([("A", i, float(i)) for i in range(600)], "symbol string, ts long, y double")
    got = {(r.fold, r.part): r["count"] for r in forecast.time_folds(panel, 4, 5).groupBy("fold", "part").count().collect()}
    assert sorted({f for f, _ in got}) == [2, 3, 4] and all(n >= (200 if p == "train" else 60) for (_, p), n in got.items())
    assert forecast.time_folds(panel.where("ts < 300"), 4, 5).count() == 0
    grid = spark.createDataFrame([(t, c, float((t * 7 + c * 13) % 11)) for t in range(80) for c in range(4)], "t long, candidate long, value double")
    assert forecast.pbo(grid, 8).first().pbo is not None and forecast.pbo(grid.where("candidate < 3"), 8).first().pbo is None
    assert forecast.pbo(grid.where("t < 7"), 8).first().pbo is None
