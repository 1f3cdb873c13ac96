"""Streams with typed state: positions from events, alerts at night, bars that go on from history."""

import itertools
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.plans.engine_queries import _drain
from tidebar.streaming import bars, stateful

HOUR, DAY = 3_600_000, 86_400_000


def event(id_, at, kind, price=None, shares=None, target=None, stop=None, targets=None, reason=None):
    return id_, at, kind, price, shares, target, stop, targets, reason


OPEN = event("o", 0, "open", 100.0, 10.0, stop=90.0, targets=[110.0, 120.0])


def test_a_touch_sells_nothing():
    p = stateful.fold([OPEN, event("a", 1, "hit", target=0), event("b", 2, "hit", target=-1)])
    assert (p["shares_left"], p["realized"], p["sales"], p["stop"], p["stop_hit"]) == (10.0, 0.0, 0, 90.0, True)


def test_a_sale_settles_the_first_target_met_and_lifts_the_stop_to_the_entry():
    p = stateful.fold([OPEN, event("a", 1, "hit", target=0), event("b", 2, "sold", 110.0, 5.0)])
    assert (p["shares_left"], p["realized"], p["stop"], p["status"]) == (5.0, 50.0, 100.0, "open")
    assert [t["settled"] for t in p["targets"]] == [True, False]
    p = stateful.fold([OPEN, event("a", 1, "hit", target=0), event("b", 2, "sold", 110.0, 5.0), event("c", 3, "hit", target=1), event("d", 4, "sold", 121.0, 9.0, reason="target")])
    assert (p["shares_left"], p["realized"], p["status"], p["closed_at"], p["reason"]) == (0.0, 155.0, "closed", 4, "target")  # no more than was left


def test_held_trails_the_stop():
    p = stateful.fold([OPEN, event("a", 1, "hit", target=0), event("b", 2, "held")])
    assert p["stop"] == 100.0 and p["targets"][0]["settled"]
    p = stateful.fold([OPEN, event("a", 1, "hit", target=0), event("b", 2, "held"), event("c", 3, "hit", target=1), event("d", 4, "held")])
    assert p["stop"] == 110.0  # the target met before
    p = stateful.fold([OPEN, event("a", 1, "hit", target=-1), event("b", 2, "held")])
    assert p["stop"] == 100.0 and not p["stop_hit"]


def test_retarget_close_and_what_comes_after():
    p = stateful.fold([OPEN, event("a", 1, "retarget", stop=95.0, targets=[130.0]), event("b", 2, "hit", target=0), event("c", 3, "hit", target=1), event("d", 4, "close", reason="manual"), event("e", 5, "sold", 130.0, 1.0)])
    assert (p["stop"], p["status"], p["reason"], p["shares_left"], [t["hit"] for t in p["targets"]]) == (95.0, "closed", "manual", 10.0, [True])
    assert stateful.fold([event("a", 1, "sold", 100.0, 1.0)]) is None and stateful.fold([]) is None
    assert stateful.fold([event("a", -1, "sold", 100.0, 1.0), OPEN])["shares_left"] == 10.0  # before it was open


def test_any_order_of_events_gives_one_position():
    events = [OPEN, event("a", 1, "hit", target=0), event("b", 2, "sold", 110.0, 4.0), event("c", 3, "held"), event("d", 4, "hit", target=1), event("e", 5, "sold", 119.0, 9.0)]
    want = stateful.fold(events)
    assert all(stateful.fold(list(p)) == want for p in itertools.permutations(events))


def written(spark, rows, schema, folder, parts):
    """rows dealt to files of a stream's folder in order, a file a part."""
    for i, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_the_stream_of_shuffled_and_repeated_events_equals_the_batch(spark, tmp_path):
    stateful.rocksdb(spark)
    r, rows = np.random.default_rng(3), []
    for n in range(25):
        rows.append((f"p{n}", *event("o", 5, "open", 100.0, 10.0, stop=90.0, targets=[105.0, 110.0])))
        for k in range(8):
            kind = str(r.choice(["sold", "hit", "held"]))
            rows.append((f"p{n}", *event(f"e{k}", int(r.integers(4, 40)), kind, 104.0 + k if kind == "sold" else None, float(r.integers(1, 4)) if kind == "sold" else None, int(r.integers(-1, 2)) if kind == "hit" else None)))
    rows.append(("never", *event("x", 9, "sold", 1.0, 1.0)))
    rows += [rows[i] for i in r.integers(0, len(rows), 40)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    out = _drain(stateful.positions(written(spark, rows, stateful.EVENT, f"{tmp_path}/in", 4)), "positions", "update")
    last = out.groupBy("position").agg(F.max_by(F.struct(*out.columns[1:]), "version").alias("p")).select("position", "p.*")
    batch = stateful.positions_of(spark.createDataFrame(rows, stateful.EVENT))
    got, want = (sorted(map(tuple, df.collect())) for df in (last, batch))
    assert len(got) == 25 and got == want
    by = {}
    for p, *e in rows:
        by.setdefault(p, {})[e[0]] = tuple(e)
    for row in last.collect():
        assert row.shares_left >= 0 and row.sales <= sum(e[2] == "sold" for e in by[row.position].values())
        assert row.shares_left == stateful.fold(list(by[row.position].values()))["shares_left"]
    assert stateful.positions_of(spark.createDataFrame([], stateful.EVENT)).count() == 0


def test_edges_of_the_quiet_hours():
    at = lambda h, m=0: h * HOUR + m * 60_000 - stateful.OFFSET + 10 * DAY  # noqa: E731  a time on Seoul's clock
    assert stateful.morning(at(22, 59)) is None and stateful.morning(at(7)) is None
    assert stateful.morning(at(23)) == at(7) + DAY and stateful.morning(at(6, 59)) == at(7) and stateful.morning(at(0)) == at(7)


def test_alerts_wait_for_the_morning_and_go_out_once(spark, tmp_path):
    stateful.rocksdb(spark)
    at = lambda d, h, m=0: d * DAY + h * HOUR + m * 60_000 - stateful.OFFSET + 100 * DAY
    rows = [
        ("me", "1", at(0, 22, 59), "buy_below", "one"), ("me", "2", at(0, 23), "buy_below", "two"), ("me", "3", at(1, 1), "stop_below", "three"), ("me", "4", at(1, 6, 59), "target_above", "four"), ("you", "5", at(1, 2), "buy_below", "five"),
        ("me", "6", at(1, 7), "buy_below", "six"), ("me", "7", at(1, 12), "buy_below", "seven"), ("me", "8", at(1, 23, 30), "buy_below", "eight"),
    ]
    for parts in (1, 8):  # all at once, or an alert a batch
        out = _drain(stateful.delivered(written(spark, rows, stateful.ALERT, f"{tmp_path}/{parts}", parts)), "delivered", "append")
        got = sorted((r.owner, r.at, r.batch, r.n, r.ids, r.title) for r in out.collect())
        assert got == sorted(
            [("me", x[2], False, 1, [x[1]], x[4]) for x in (rows[0], rows[2], rows[5], rows[6])] + [("me", at(1, 7), True, 2, ["2", "4"], "two / four"), ("you", at(1, 7), False, 1, ["5"], "five")]
        )  # the eighth waits for the second morning


def test_bars_by_watermark_are_told_once_and_late_ticks_are_dropped(spark, tmp_path):
    rows = [("a", 10, 1.0, 1.0, 0), ("a", HOUR + 5, 2.0, 1.0, 1), ("a", 20, 3.0, 1.0, 2), ("a", 3 * HOUR + 9, 4.0, 1.0, 3), ("a", 3 * HOUR + 10, 6.0, 1.0, 4), ("a", 30, 9.0, 1.0, 5), ("a", 9 * HOUR, 5.0, 1.0, 6)]
    ticks = written(spark, rows, bars.TICK, f"{tmp_path}/in", len(rows))
    got = sorted((r.ts, r.open, r.close, r.volume) for r in _drain(bars.tumbling(ticks, HOUR, "1 hour"), "tumbling", "append").collect())
    # The third tick comes within the hour allowed, the sixth does not; the last bar is still open.
    assert got == [(0, 1.0, 3.0, 2.0), (HOUR, 2.0, 2.0, 1.0), (3 * HOUR, 4.0, 6.0, 2.0)]


@pytest.mark.parametrize("cut", [0, 1, 7, 20, 39])
def test_bars_go_on_from_history_at_any_tick(spark, tmp_path, cut):
    stateful.rocksdb(spark)
    r = np.random.default_rng(7)
    rows = [("ab"[int(r.integers(2))], int(t), float(r.integers(1, 50)), 1.0, i) for i, t in enumerate(np.sort(r.integers(0, 6 * HOUR, 40)) - r.choice([0, HOUR], 40, p=[0.9, 0.1]))]
    rows = [(s, abs(t), *x) for s, t, *x in rows]
    whole = pd.DataFrame(rows, columns=["symbol", "ts", "price", "volume", "seq"])
    want = []
    for symbol, g in whole.groupby("symbol"):
        bar, _ = bars.fold_ticks(None, g[g.seq < cut], HOUR) if (g.seq < cut).any() else (None, None)
        late = g[g.seq >= cut]
        if len(late):
            want += [(symbol, *map(float, x)) for x in bars.fold_ticks(bar, late, HOUR)[1].to_numpy()]
    history = stateful.forming(spark.createDataFrame(rows[:cut], bars.TICK), HOUR)
    live = written(spark, rows[cut:], bars.TICK, f"{tmp_path}/in", 1)
    out = _drain(stateful.continued(live, HOUR, history), "continued", "append")
    got = [(r.symbol, *map(float, (r.ts, r.open, r.high, r.low, r.close, r.volume, r.closed))) for r in out.collect()]
    assert sorted(got) == sorted(want) and got


def test_many_positions_take_no_call_of_python_each(spark, tmp_path):
    """Spark's own aggregate keeps the events; of events that share an id one counts, the same in any order."""
    n = 3000
    opened = spark.range(n).selectExpr("cast(id AS string) AS position", "'o' AS event", "0L AS at", "'open' AS kind", "100.0D AS price", "10.0D AS shares", "int(null) AS target", "90.0D AS stop", "array(110.0D) AS targets", "string(null) AS reason")
    sold = opened.selectExpr("position", "'s' AS event", "1L AS at", "'sold' AS kind", "101.0D AS price", "1.0D AS shares", "target", "double(null) AS stop", "cast(null AS array<double>) AS targets", "reason")
    for i, part in enumerate([sold, opened, sold, sold.withColumn("price", F.lit(102.0))]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = spark.readStream.schema(stateful.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    df = stateful.positions(events)
    assert "TransformWithState" not in df._jdf.queryExecution().logical().toString()
    last = _drain(df, "positions", "update").groupBy("position").agg(F.max("version").alias("version"), F.max_by("realized", "version").alias("realized"))
    assert [tuple(r) for r in last.groupBy("version").agg(F.count("*")).collect()] == [(2, n)]
    whole = stateful.positions(opened.unionByName(sold).unionByName(sold.withColumn("price", F.lit(102.0))))
    assert {r.realized for r in whole.collect()} == {1.0}


def test_the_ledger_keeps_rows_and_not_what_they_tell(spark, tmp_path, monkeypatch):
    """State of sf0.01 (135,000 events) in bytes when the stream ends, and none afterwards."""
    from tidebar.plans import engine_queries, stream_queries

    kept, dropped = [], engine_queries.dropped

    def seen(session, path):
        kept.append(sum(f.stat().st_size for f in Path(path.removeprefix("file://")).rglob("*.sst")))
        dropped(session, path)

    monkeypatch.setattr(engine_queries, "dropped", seen)
    monkeypatch.setattr(engine_queries, "shared_dir", lambda session, name: f"file://{tmp_path}/{name}")
    assert stream_queries.QUERIES["position_ledger"](spark, "/root/testdata/sf0.01").count() == 15000
    assert len(kept) == 1 and 0 < kept[0] < 25 * 135_000
    assert not list(tmp_path.rglob("*.sst"))


def test_events_of_rows_are_those_of_their_rows(spark):
    """Rows that repeat, and rows that stand for events of one id, count as the events would."""
    rows = spark.createDataFrame([(7, (True, 5)), (7, (False, 6)), (7, (False, 6)), (7, (False, 8)), (None, (True, 5)), (8, (False, 6))], "position long, row struct<opens: boolean, at: long>")
    sale = "struct('s' AS event, {at} AS at, 'sold' AS kind, 101.0D AS price, 1.0D AS shares, int(null) AS target, double(null) AS stop, cast(null AS array<double>) AS targets, string(null) AS reason)"
    opened = "struct('o' AS event, {at} AS at, 'open' AS kind, 100.0D AS price, 10.0D AS shares, int(null) AS target, 90.0D AS stop, array(110.0D) AS targets, string(null) AS reason)"
    flat = rows.selectExpr("cast(position AS string) AS position", f"CASE WHEN row.opens THEN {opened.format(at='row.at')} ELSE {sale.format(at='row.at')} END AS e").select("position", "e.*")
    made = lambda r: F.array(F.when(r["opens"], F.struct(*_fields("o", r["at"], "open", 100.0, 10.0, 90.0, [110.0]))).otherwise(F.struct(*_fields("s", r["at"], "sold", 101.0, 1.0, None, None))))
    got = sorted(map(repr, stateful.positions_of_rows(rows, made).collect()))
    assert got == sorted(map(repr, stateful.positions(flat).collect())) and len(got) == 2
    assert "version=2" in got[0] and "sales=1" in got[0]


def _fields(event, at, kind, price, shares, stop, targets):
    values = {"event": F.lit(event), "at": at, "kind": F.lit(kind), "price": F.lit(price), "shares": F.lit(shares), "target": F.lit(None).cast("int"), "stop": F.lit(stop).cast("double"), "targets": F.array(*map(F.lit, targets)) if targets else F.lit(None).cast("array<double>"), "reason": F.lit(None).cast("string")}
    return [v.alias(k) for k, v in values.items()]


def test_the_column_of_mornings_is_morning(spark):
    ats = [h * HOUR // 2 + x for h in range(96) for x in (-1, 0, 1)]
    df = spark.createDataFrame([(k, at) for at in ats for k in ("buy_below", "stop_below")], "kind string, at long")
    for r in df.withColumn("u", stateful.waits_until(F.col("kind"), F.col("at"))).collect():
        assert r.u == (None if r.kind == "stop_below" else stateful.morning(r.at))


def test_alerts_pass_through_batch_by_batch():
    """The rows of a key are never held together: each frame is answered, or kept in the state, before the next is read."""
    kept, timers, read = [], [], []

    class Held:
        def appendList(self, rows):
            kept.append(len(rows))

    class Handle:
        def getListState(self, *_):
            return Held()

        def registerTimer(self, at):
            timers.append(at)

    def frames():
        for i in range(3):
            read.append(i)
            yield pd.DataFrame({"id": [f"{i}a", f"{i}b"], "at": [i, i], "title": ["x", "y"]})

    night = stateful.Night()
    night.init(Handle())
    for out in night.handleInputRows(("me", -1, 0), frames(), None):
        assert len(out) == 2 and out["n"].tolist() == [1, 1] and len(read) == (int(out["ids"].iloc[0][0][0]) + 1)
    assert list(night.handleInputRows(("me", DAY, 0), frames(), None)) == [] and kept == [2, 2, 2] and timers == [DAY]
