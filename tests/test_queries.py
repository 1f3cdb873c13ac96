"""Every query with SQL gives what DuckDB gives for it."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(got: pd.DataFrame, want: pd.DataFrame, name: str) -> None:
    assert sorted(got.columns) == sorted(want.columns), name
    assert len(got) == len(want), (name, len(got), len(want))
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    for c in cols:
        a, b = got[c], want[c]
        assert (a.isna() == b.isna()).all(), (name, c, int((a.isna() != b.isna()).sum()))
        bad = (a != b) & ~a.isna()
        assert not bad.any(), (name, c, int(bad.sum()), got[bad].head(3).to_dict(), want[bad].head(3).to_dict())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    same(df.toPandas(), duck.execute(entry.oracle_sql()[name]).df(), name)


def test_drained_streams_lie_in_files(spark, tmp_path):
    from tidebar.plans.engine_queries import _drain

    for i in range(3):
        spark.range(10 * i, 10 * i + 10, 1, 1).write.parquet(f"{tmp_path}/in/{i}")
    ids = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = _drain(ids, "ids", "append")
    assert got.inputFiles() and sorted(r.id for r in got.collect()) == list(range(30))
    counted = _drain(ids.groupBy((ids.id % 2).alias("odd")).count(), "counted", "complete")
    assert counted.inputFiles() and sorted(map(tuple, counted.collect())) == [(0, 15), (1, 15)]


HOURLY = ["bars_hourly", "dedup_keep_last", "alert_touched", "alert_followup", "asof_backward", "asof_forward", "volatility_scale", "stream_bars_tumbling", "stream_exact_updates", "stream_seeded_updates"]


@pytest.fixture(scope="module")
def finely_timed(spark, tmp_path_factory):
    """Events of 300 hours, two of each hour within a ms of its end, and pairs within a ms whose ids run against time."""
    d = str(tmp_path_factory.mktemp("fine"))
    span = "TIMESTAMP '2024-01-01' + to_microseconds(h * 3600000000 + "
    times = {0: 5_000_900, 1: 5_000_700, 2: 1_800_000_000, 3: 3_599_999_400, 4: 3_599_999_500, 5: 3_599_999_499}
    each = " UNION ALL ".join(f"SELECT h * 6 + {k} AS event_id, {span}{us}) AS ts, h AS user_id, ['view', 'click'][1 + (h + {k // 3}) % 2] AS event_type, 1 + (h * 7 + {k} * 13) % 50 + {k} * 0.25::DOUBLE AS value, '{{}}' AS props FROM range(300) r(h)" for k, us in times.items())
    c = duckdb.connect()
    c.execute(f"COPY ({each}) TO '{d}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return d, c


@pytest.mark.parametrize("name", HOURLY)
def test_hourly_queries_take_times_as_sql_does(spark, finely_timed, name):
    d, c = finely_timed
    same(entry.queries()[name](spark, d).toPandas(), c.execute(entry.oracle_sql()[name]).df(), name)


def test_open_bars_are_told_in_their_last_state(spark, tmp_path):
    from tidebar.plans.engine_queries import _drain
    from tidebar.sources.bars import UNITS
    from tidebar.streaming import bars

    rows = [("a", 10, 1.0, 1.0, 0), ("a", UNITS["h"] + 5, 2.0, 1.0, 1), ("a", UNITS["h"] + 9, 4.0, 1.0, 2), ("a", 20, 3.0, 1.0, 3)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], bars.TICK).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    ticks = spark.readStream.schema(bars.TICK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = _drain(bars.tumbling(ticks, UNITS["h"]), "told", "update", ["symbol", "ts"])
    assert got.columns == ["symbol", "ts", "open", "high", "low", "close", "volume", "closed"]
    assert sorted((r.ts, r.open, r.close, r.volume) for r in got.collect()) == [(0, 1.0, 3.0, 2.0), (UNITS["h"], 2.0, 4.0, 2.0)]


def test_the_stream_of_bars_tells_as_many_as_the_table(spark):
    assert entry.queries()["stream_bars_tumbling"](spark, SF).count() == entry.queries()["bars_hourly"](spark, SF).count()
