"""Streams with several typed states a key: positions from their events, alerts held at night, bars that go on from history.

They need the RocksDB state store: call `rocksdb(spark)` before the stream is started."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .bars import BAR, fold_ticks

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB; typed states and timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


@contextmanager
def compact(spark: SparkSession):
    """Streams started in here take little disk: their state is packed by zstd, and a task that has committed its part keeps no
    copy of it beside the checkpoint."""
    conf = {"spark.sql.streaming.stateStore.rocksdb.compression": "zstd", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Positions
#: kind: open (price, shares, stop, targets), hit (target: its number from 0, or -1 for the stop), sold (price, shares, reason), held,
#: retarget (stop, targets; null leaves either), close (reason).
EVENT = "position string, event string, at long, kind string, price double, shares double, target int, stop double, targets array<double>, reason string"
POSITION = "position string, version long, status string, entry double, shares_left double, realized double, stop double, stop_hit boolean, armed array<double>, sales long, closed_at long, reason string"
_STORED = ["event", "at", "kind", "price", "shares", "target", "stop", "targets", "reason"]


def _targets(prices) -> list[dict]:
    return [{"price": round(float(x), 8), "hit": False, "settled": False} for x in prices]


def _raised(p: dict, below: float) -> None:
    """The stop goes up to the entry, or to the highest target met below a price; never down."""
    moved = max([p["entry"], *(t["price"] for t in p["targets"] if t["hit"] and t["price"] < below)])
    if moved > p["stop"]:
        p["stop"] = round(moved, 8)


def _closed(p: dict, at: int, reason: str | None) -> None:
    p.update(status="closed", closed_at=at, reason=reason)


def fold(events: list[tuple]) -> dict | None:
    """A position after its events (fields of EVENT without position), by time and then id, or None before it is open.

    A hit sells nothing: only `sold` lowers shares_left, and never below zero. A closed position takes no further event. Events are
    few (plan, touches and sales of one position), so they are folded again whenever one arrives, in whatever order."""
    p = None
    for event, at, kind, price, shares, target, stop, targets, reason in sorted(events, key=lambda e: (e[1], e[0])):
        if p is None:
            if kind == "open":
                p = {"status": "open", "entry": price, "shares_left": shares, "realized": 0.0, "stop": round(stop or 0.0, 8), "stop_hit": False, "targets": _targets(targets or []), "sales": 0, "closed_at": None, "reason": None}
            continue
        if p["status"] == "closed":
            continue
        if kind == "hit" and target == -1:
            p["stop_hit"] = p["stop_hit"] or p["stop"] > 0
        elif kind == "hit" and target is not None and 0 <= target < len(p["targets"]):
            t = p["targets"][target]
            t["hit"] = t["hit"] or not t["settled"]
        elif kind == "sold":
            taken = min(shares, p["shares_left"])
            if taken <= 0:
                continue
            p.update(shares_left=round(p["shares_left"] - taken, 10), realized=round(p["realized"] + (price - p["entry"]) * taken, 6), sales=p["sales"] + 1)
            for t in p["targets"]:
                if t["hit"] and not t["settled"]:
                    t["settled"] = True
                    break
            if p["shares_left"] <= 1e-9:
                _closed(p, at, reason)
                continue
            _raised(p, price)
            p["stop_hit"] = False  # the stop is armed again
        elif kind == "held":
            met = [t for t in p["targets"] if t["hit"] and not t["settled"]]
            for t in met:
                t["settled"] = True
            _raised(p, max([t["price"] for t in met], default=p["entry"]))
            p["stop_hit"] = False
        elif kind == "retarget":
            p["stop"] = p["stop"] if stop is None else round(stop, 8)
            p["targets"] = p["targets"] if targets is None else _targets(targets)
            p["stop_hit"] = False
        elif kind == "close":
            _closed(p, at, reason)
    return p


_FIELDS = [tuple(c.split(" ")) for c in POSITION.split(", ")]


def _rows(batches):
    """Record batches of (position, events) to POSITION rows. Of events with one id the least counts, whatever order they came in."""
    import pyarrow as pa

    shape = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in _FIELDS])
    for whole in batches:
        for k in range(0, whole.num_rows, 2000):
            b = whole.slice(k, 2000)
            lists, out = b.column("events"), {n: [] for n, _ in _FIELDS}
            flat = lists.flatten()  # the fields of all events, then cut by position
            every = list(zip(*[flat.field(c).to_pylist() for c in _STORED]))
            at = 0
            for position, n in zip(b.column("position").to_pylist(), lists.value_lengths().to_pylist()):
                events, at = every[at : at + n], at + n
                if len({e[0] for e in events}) < n:
                    events = list({e[0]: e for e in sorted(events, key=repr, reverse=True)}.values())
                p = fold(events)
                if p is not None:
                    open_ = p["status"] == "open"
                    p |= {"position": position, "version": len(events), "armed": [t["price"] for t in p["targets"] if open_ and not t["settled"]]}
                    for c, values in out.items():
                        values.append(p[c])
            yield pa.RecordBatch.from_pydict(out, schema=shape)


def positions(events: DataFrame) -> DataFrame:
    """EVENT rows to the state of every position, None before it is open: of a table after all its events; of a stream (in
    update mode) of every position that a batch touches, version by version; keep the highest version.

    The state is the set of a position's events, kept by Spark's own aggregate; the last version is the fold of them all,
    whatever order they came in and however often."""
    g = events.groupBy("position").agg(F.collect_set(F.struct(*_STORED)).alias("events"))
    return g.mapInArrow(_rows, POSITION)


def positions_of_rows(rows: DataFrame, made: Callable[[Column], Column]) -> DataFrame:
    """positions() of the events that rows (position, row) stand for: `made` gives a row's, an array of EVENT's fields without position.

    The state is the set of a position's rows, and events are made of it afterwards: neither the shuffle nor the state holds what
    can be told from a row."""
    g = rows.groupBy("position").agg(F.collect_set("row").alias("rows"))
    return g.select(F.col("position").cast("string"), F.flatten(F.transform("rows", made)).alias("events")).mapInArrow(_rows, POSITION)


def positions_of(events: DataFrame) -> DataFrame:
    """The batch twin of positions(): the state of every position after all its events."""
    return positions(events)


# Alerts at night
#: Seoul's offset, and the hours (its clock) from and until which all but stops are held back.
OFFSET, FROM, UNTIL, DAY = 9 * 3_600_000, 23, 7, 86_400_000
ALERT = "owner string, id string, at long, kind string, title string"
DELIVERED = "owner string, at long, batch boolean, n long, ids array<string>, title string"


def morning(at: int) -> int | None:
    """When an alert of this time may go out if it has to wait for the end of the quiet hours, else None."""
    clock = (at + OFFSET) % DAY
    if UNTIL * 3_600_000 <= clock < FROM * 3_600_000:
        return None
    end = at - clock + UNTIL * 3_600_000
    return end if clock < UNTIL * 3_600_000 else end + DAY


def waits_until(kind: Column, at: Column) -> Column:
    """morning() of an alert's time as a column; null for stops, which never wait."""
    clock = F.pmod(at + OFFSET, F.lit(DAY))
    end = at - clock + UNTIL * 3_600_000
    hours = lambda h: F.lit(h * 3_600_000)
    return F.when((kind == "stop_below") | ((clock >= hours(UNTIL)) & (clock < hours(FROM))), None).when(clock < hours(UNTIL), end).otherwise(end + DAY)


#: Parts that the alerts of an owner that do not wait are dealt to.
LANES = 16


class Night(StatefulProcessor):
    """The alerts of an owner's night held back (list state) and a timer at its end; those that do not wait pass by. Rows go
    through batch by batch: only a night that goes out is held in memory, as it is one row."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id string, title string")

    def handleInputRows(self, key, rows, timerValues):
        owner, until, _ = key
        for frame in rows:
            at = frame["at"].astype("int64")
            if until < 0:
                yield pd.DataFrame({"owner": owner, "at": at, "batch": False, "n": 1, "ids": [[i] for i in frame["id"]], "title": frame["title"]}, columns=["owner", "at", "batch", "n", "ids", "title"])
            elif len(frame):
                self.held.appendList(list(zip(at.tolist(), frame["id"], frame["title"])))
        if until >= 0:
            self.handle.registerTimer(int(until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = sorted(tuple(h) for h in self.held.get())
        self.held.clear()
        if due:
            title = due[0][2] if len(due) == 1 else " / ".join(d[2] for d in due[:4])
            yield pd.DataFrame([{"owner": key[0], "at": expiredTimerInfo.getExpiryTimeInMs(), "batch": len(due) > 1, "n": len(due), "ids": [d[1] for d in due], "title": title}])


def delivered(alerts: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of ALERT rows to what is sent: stops and daytime alerts at once, the others together when the night ends.

    Night ends by event time, once alerts `late` past seven have been seen, so a run again sends the same. A batch of alerts
    names the first four titles and carries all ids; one alert alone goes out as itself. A key is an owner's night, so
    neither a task nor a state has all of an owner's alerts."""
    timed = alerts.withColumn("time", F.timestamp_millis("at")).withWatermark("time", late)
    until = F.coalesce(waits_until(F.col("kind"), F.col("at")), F.lit(-1).cast("long"))
    keyed = timed.withColumn("until", until).withColumn("lane", F.when(F.col("until") < 0, F.pmod(F.hash("id"), F.lit(LANES))).otherwise(0))
    return keyed.groupBy("owner", "until", "lane").transformWithStateInPandas(Night(), DELIVERED, "Append", "EventTime")


# Bars that go on from history
class Forming(StatefulProcessor):
    """The forming bar of a symbol, given by history at first."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle) -> None:
        self.bar = handle.getValueState("bar", "ts long, open double, high double, low double, close double, volume double")

    def _keep(self, bar) -> None:
        self.bar.update((int(bar[0]), *(float(x) for x in bar[1:])))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        self._keep([r[c] for c in ("ts", "open", "high", "low", "close", "volume")])

    def handleInputRows(self, key, rows, timerValues):
        t = pd.concat(list(rows)).sort_values("seq", kind="stable")
        bar, out = fold_ticks(tuple(self.bar.get()) if self.bar.exists() else None, t, self.step)
        if bar is not None:
            self._keep(bar)
        out.insert(0, "symbol", key[0])
        yield out.astype({"ts": "int64", "closed": bool})


def forming(ticks: DataFrame, step_ms: int) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): the last bar of every symbol of a table of ticks in order of `seq`, still open."""
    t = ticks.withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(step_ms)))
    bars = t.groupBy("symbol", "ts").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*bars.columns[1:]), "ts").alias("b")).select("symbol", "b.*")


def continued(ticks: DataFrame, step_ms: int, history: DataFrame) -> DataFrame:
    """streaming.bars.exact() whose forming bars begin as those of history, at most one a symbol: no gap, no second opening of the bar
    that was open when history ended, and its volume counts on. Without history a symbol starts from its first tick."""
    return ticks.groupBy("symbol").transformWithStateInPandas(Forming(step_ms), BAR, "Append", "None", initialState=history.groupBy("symbol"))
