"""DuckDB SQL of the queries, written apart from the Spark code: the same results by plain window SQL."""

from __future__ import annotations

DAILY = """
daily_ticks AS (
  SELECT p_type AS symbol, epoch_ms(l_shipdate) AS ts, p_retailprice * (1 - l_discount) AS price, l_quantity AS qty,
         row_number() OVER (PARTITION BY p_type ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, CAST(ts - ts % 86400000 AS BIGINT) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(qty) AS volume
  FROM daily_ticks GROUP BY 1, 2)"""
HOURLY = """
hourly_ticks AS (
  SELECT event_type AS symbol, epoch_ms(ts) AS ts, 1.0::DOUBLE + value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events),
hours AS (
  SELECT symbol, CAST(ts - ts % 3600000 AS BIGINT) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM hourly_ticks GROUP BY 1, 2)"""
#: Added before rounding: prices have few decimals, so their means would often lie on a tie, where engines differ.
NUDGE = "1.23456789e-6::DOUBLE"


def rounded(x: str, digits: int = 4) -> str:
    return f"round(({x}) + {NUDGE}, {digits}) + 0.0::DOUBLE"


P = "PARTITION BY symbol ORDER BY ts"


def over(n: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({P})"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0.0::DOUBLE))"


def query(columns: dict[str, str | tuple[str, int]], *steps: str, base: str = "bars", with_: str = DAILY, where: str = "") -> str:
    """SELECT symbol, ts and rounded columns over base and steps; each step is SQL that reads the one before as `b`."""
    ctes, last = [with_.strip()], base
    for i, step in enumerate(steps):
        ctes.append(f"s{i} AS ({step.replace('FROM b', f'FROM {last} AS b')})")
        last = f"s{i}"
    picks = ", ".join(f"{rounded(*((c, 4) if isinstance(c, str) else c))} AS {name}" for name, c in columns.items())
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT symbol, ts, {picks} FROM {last} {where}"


TP = "((high + low + close) / 3)"
CLV = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0.0::DOUBLE), 0.0::DOUBLE)"
NUMBERED = f"SELECT *, CAST(row_number() OVER ({P}) AS BIGINT) AS i FROM b"


def wma(x: str, n: int) -> str:
    terms = " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n))
    return f"(({terms}) / ({n} * ({n} + 1) / 2.0::DOUBLE))"


def seeded(x: str, n: int, a: str, out: str, source: str) -> str:
    """CTEs for y = a x + (1 - a) y from the mean of the first n values of x; valid rows of source are numbered again."""
    return f"""{out}_v AS (SELECT symbol, ts, {x} AS x, row_number() OVER ({P}) AS k FROM {source} WHERE {x} IS NOT NULL),
{out}_r(symbol, k, y) AS (
  SELECT symbol, {n}, avg(x) FROM {out}_v WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL
  SELECT v.symbol, v.k, {a} * v.x + (1 - {a}) * r.y FROM {out}_r r JOIN {out}_v v ON v.symbol = r.symbol AND v.k = r.k + 1),
{out} AS (SELECT v.symbol, v.ts, r.y FROM {out}_v v LEFT JOIN {out}_r r ON r.symbol = v.symbol AND r.k = v.k)"""


def ema_a(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


def rma_a(n: int) -> str:
    return f"(1.0::DOUBLE / {n})"


TR = f"tr AS (SELECT symbol, ts, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS x FROM bars)"


def recurrence(ctes: list[str], columns: dict[str, str], joins: str) -> str:
    picks = ", ".join(f"{rounded(x)} AS {n}" for n, x in columns.items())
    return f"WITH RECURSIVE {', '.join([DAILY.strip(), *ctes])} SELECT b.symbol, b.ts, {picks} FROM bars b {joins}"


def left(*names: str) -> str:
    return " ".join(f"LEFT JOIN {n} ON {n}.symbol = b.symbol AND {n}.ts = b.ts" for n in names)
