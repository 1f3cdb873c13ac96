"""Queries of candle frames, catalogues and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import candles, catalogue, ledger
from ..sources.bars import UNITS, bars_daily, bars_hourly, hourly_ticks
from ..streaming.bars import touched
from . import oracle as q
from .study_queries import flat, r6, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql is not None:
        ORACLE[name] = sql


def _arrivals(spark, d):
    """Ticks as rows of hourly bars, in order of arrival: several rows a bar."""
    t = hourly_ticks(spark, d)
    price = F.col("price").alias
    return t.select("symbol", (F.col("ts") - F.pmod("ts", F.lit(UNITS["h"]))).alias("ts"), *[price(c) for c in ("open", "high", "low", "close")], "volume", F.lit(True).alias("closed"), F.col("seq.event_id").alias("seq"))


add("dedup_keep_last", lambda spark, d: flat(candles.to_frame(_arrivals(spark, d)), ["symbol", "ts"], ["close"]), f"SELECT event_type AS symbol, CAST(epoch_ms(ts) - epoch_ms(ts) % 3600000 AS BIGINT) AS ts, {r6('arg_max(1.0::DOUBLE + value, event_id)')} AS close FROM events GROUP BY ALL HAVING true".replace("GROUP BY ALL HAVING true", "GROUP BY event_type, epoch_ms(ts) - epoch_ms(ts) % 3600000"))
add("validate_bars", lambda spark, d: candles.validate(bars_daily(spark, d).withColumn("high", F.col("open") * 1.001), UNITS["w"]).select("symbol", "rule", F.col("violations").cast("long").alias("violations")), f"""WITH {q.DAILY.strip()}, v AS (SELECT symbol, open * 1.001::DOUBLE AS high, low, open, close, ts FROM bars),
r AS (SELECT symbol, 'high_below_low' AS rule, count(*) FILTER (WHERE high < low) AS violations FROM v GROUP BY symbol UNION ALL SELECT symbol, 'open_outside', count(*) FILTER (WHERE open > high OR open < low) FROM v GROUP BY symbol
UNION ALL SELECT symbol, 'close_outside', count(*) FILTER (WHERE close > high OR close < low) FROM v GROUP BY symbol UNION ALL SELECT symbol, 'off_grid', count(*) FILTER (WHERE ts % 604800000 <> 0) FROM v GROUP BY symbol)
SELECT symbol, rule, violations FROM r WHERE violations > 0""")
add("recurring_events", lambda spark, d: catalogue.recurring(spark, "2023-01-15", "2024-12-20"), """WITH m AS (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS DATE) AS f),
e AS (SELECT f AS d, 'month-start' AS title FROM m UNION ALL SELECT last_day(f), 'month-end' FROM m UNION ALL SELECT CAST(f + CAST((5 - isodow(f) + 7) % 7 + 14 AS INT) AS DATE), 'third-friday' FROM m
UNION ALL SELECT last_day(f), 'quarter-end' FROM m WHERE month(f) % 3 = 0 UNION ALL SELECT CAST(last_day(f) - CAST((isodow(last_day(f)) - 5 + 7) % 7 AS INT) AS DATE), 'quarter-expiry' FROM m WHERE month(f) % 3 = 0)
SELECT CAST(epoch_ms(CAST(d AS TIMESTAMP)) AS BIGINT) AS ts, 'calendar' AS kind, title FROM e WHERE d BETWEEN DATE '2023-01-15' AND DATE '2024-12-20'""")
add("macro_changes", lambda spark, d: flat(catalogue.changes(bars_daily(spark, d).select("symbol", "ts", F.col("close").alias("value")), 60.0), ["symbol", "ts"], ["change", "severity"], 4), rows(["symbol", "ts"], {"change": "c", "severity": "least(1.0::DOUBLE, abs(c) / 240.0::DOUBLE)"}, f"ch AS (SELECT symbol, ts, close - {q.lag('close')} AS c FROM bars), cf AS (SELECT * FROM ch WHERE abs(c) >= 60)||cf").replace(", 6) + 0.0", ", 4) + 0.0"))
add("search_symbols", lambda spark, d: catalogue.match(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("symbol"), F.col("p_partkey").alias("place")), "ring").select("symbol", "place", F.col("grade").cast("long").alias("grade")), "SELECT symbol, place, grade FROM (SELECT p_name AS symbol, p_partkey AS place, CAST(CASE WHEN upper(p_name) = 'RING' OR list_contains(regexp_split_to_array(upper(p_name), '[-/]'), 'RING') THEN 0 WHEN starts_with(upper(p_name), 'RING') THEN 1 WHEN contains(upper(p_name), 'RING') THEN 2 END AS BIGINT) AS grade FROM part) WHERE grade IS NOT NULL ORDER BY grade, place LIMIT 30")


def _origins(spark, d):
    b = bars_daily(spark, d)
    return b.groupBy("symbol").agg(F.max("ts").alias("z")).select("symbol", F.explode(F.array(*[F.col("z") - k * UNITS["d"] for k in (0, 500, 1000)])).alias("origin"))


add("asof_cut", lambda spark, d: flat(catalogue.cut(bars_daily(spark, d), _origins(spark, d)).groupBy("symbol", "origin").agg(F.count("*").alias("n"), F.max_by("close", "ts").alias("last")), ["symbol", "origin"], ["n", "last"], 4), rows(["symbol", "origin"], {"n": "n", "last": "l"}, "og AS (SELECT symbol, CAST(max(ts) - k * 86400000::BIGINT AS BIGINT) AS origin FROM bars, (SELECT unnest([0, 500, 1000]) AS k) GROUP BY symbol, k), ct AS (SELECT b.symbol, origin, count(*) AS n, arg_max(close, ts) AS l FROM bars b JOIN og ON og.symbol = b.symbol AND b.ts <= origin GROUP BY b.symbol, origin)||ct").replace(", 6) + 0.0", ", 4) + 0.0"))


def _rules(spark, d):
    b = bars_hourly(spark, d).groupBy("symbol").agg(F.avg("close").alias("m"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("m") * f).alias("price")) for k, f in (("buy_below", 0.5), ("sell_above", 1.5), ("stop_below", 0.2), ("target_above", 2.5))])
    return b.select("symbol", F.explode(kinds).alias("k")).select("symbol", "k.kind", "k.price")


add(
    "alert_touched",
    lambda spark, d: flat(bars_hourly(spark, d).join(_rules(spark, d), "symbol").where(touched(F.col("kind"), F.col("price"), F.col("low"), F.col("high"))).groupBy("symbol", "kind").agg(F.min("ts").alias("first"), F.count("*").alias("n")), ["symbol", "kind", "first"], ["n"]),
    rows(["symbol", "kind", '"first"'], {"n": "n"}, "mm AS (SELECT symbol, avg(close) AS m FROM hours GROUP BY symbol), ru AS (SELECT symbol, kind, m * f AS price FROM mm, (VALUES ('buy_below', 0.5::DOUBLE), ('sell_above', 1.5::DOUBLE), ('stop_below', 0.2::DOUBLE), ('target_above', 2.5::DOUBLE)) k(kind, f)), tc AS (SELECT h.symbol, kind, min(ts) AS \"first\", count(*) AS n FROM hours h JOIN ru ON ru.symbol = h.symbol AND CASE WHEN kind LIKE '%below' THEN low <= price ELSE high >= price END GROUP BY h.symbol, kind)||tc", q.HOURLY),
)


def _positions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    entry = 100.0 + F.pmod("o_orderkey", F.lit(50))
    return o.select(F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.col("o_orderpriority").alias("currency"), entry.alias("entry"), F.lit(10.0).alias("shares"), (F.pmod("o_custkey", F.lit(41)) - 20).cast("double").alias("realized"))


add("position_summary", lambda spark, d: flat(ledger.record(_positions(spark, d)), ["currency"], ["n", "realized", "avg_pct", "wins"], 4), "WITH p AS (SELECT o_orderpriority AS currency, 100.0::DOUBLE + o_orderkey % 50 AS entry, CAST(o_custkey % 41 - 20 AS DOUBLE) AS realized FROM orders WHERE o_orderstatus = 'F') SELECT currency, round(count(*) + 1.23456789e-8::DOUBLE, 4) + 0.0::DOUBLE AS n, round(sum(realized) + 1.23456789e-8::DOUBLE, 4) + 0.0::DOUBLE AS realized, round(avg(100 * realized / (entry * 10)) + 1.23456789e-8::DOUBLE, 4) + 0.0::DOUBLE AS avg_pct, round(count(*) FILTER (WHERE realized > 0) + 1.23456789e-8::DOUBLE, 4) + 0.0::DOUBLE AS wins FROM p GROUP BY currency")
add(
    "condition_splits",
    lambda spark, d: flat(ledger.splits(bars_daily(spark, d).withColumns({"cond": F.round(F.col("close") - s.lag("close"), 1), "hit": (s.lead("close") > F.col("close")).cast("double")}).where("hit IS NOT NULL"), "cond", "hit"), [], ["bucket", "n", "rate", "delta"]),
    rows([], {"bucket": "bucket", "n": "n", "rate": "rate", "delta": "rate - (SELECT avg(hit) FROM vv)"}, f"vw AS (SELECT symbol, ts, round(close - {q.lag('close')}, 1) AS cond, CAST({q.lead('close')} > close AS DOUBLE) AS hit FROM bars), vv AS (SELECT *, row_number() OVER (ORDER BY cond, symbol, ts) AS r, count(*) OVER () AS n FROM vw WHERE cond IS NOT NULL AND hit IS NOT NULL), sb AS (SELECT CASE WHEN r <= 1 + (n - 1) / 3.0::DOUBLE THEN 0 WHEN r <= 1 + 2 * (n - 1) / 3.0::DOUBLE THEN 1 ELSE 2 END AS bucket, count(*) AS n, avg(hit) AS rate FROM vv GROUP BY 1 HAVING count(*) >= 30)||sb"),
)
