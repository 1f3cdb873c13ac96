"""Periodic runs of words, found by bit-parallel lags (operator 11)."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, packed, sliced, table

#: A run has this many words and this many periods at least.
LEAST, REPEATS = 6, 4
#: Lags are sieved together while their comparisons number about this many, or the words of the text if those are more.
SIEVED = 1 << 16

_WORDS = re.compile(WORD)


def word_ids(words: list[str]) -> np.ndarray:
    """Small numbers, equal for equal words alone."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Bit b of every id as one big integer: bit i of plane b is bit b of the id of word i."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(top)]


def zero_stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of every maximal stretch of at least `least` places whose words equal those `lag` later.

    Each plane is XORed with itself shifted by the lag, the mismatches are ORed, and ANDs of the matches with themselves
    shifted by doubling steps leave one bit for each place where `least` matches begin. What no stretch survives is
    given up before the planes that remain."""
    same = (1 << n - lag) - 1
    starts = 0
    for i, plane in enumerate(planes or [0]):  # without planes one word alone comes again and again
        same &= ~(plane ^ plane >> lag)
        if i % 3 == 2 or i + 1 >= len(planes):
            starts, have = same, 1
            while starts and have < least:
                step = min(have, least - have)
                starts &= starts >> step
                have += step
            if not starts:
                return []
    bits = np.unpackbits(np.frombuffer(starts.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    edge = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    return [(int(a), int(b) + least - 1) for a, b in zip(edge[::2], edge[1::2])]


def _sieve(ids: np.ndarray):
    """(lag, places) for the lags that can have a run, ascending: places are multiples of the lag from which four words, a lag
    apart, are equal. The matches of a run cover three multiples of its period in a row, so each run shows at one of them."""
    n, low = len(ids), 1
    while low <= n // REPEATS:
        high, pairs = low, 0
        while high <= n // REPEATS and pairs <= max(SIEVED, n):
            pairs += n // high
            high += 1
        lags = np.arange(low, high)
        many = (n - 1) // lags - 2  # multiples with three more below n
        lag = np.repeat(lags, many)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(many) - many, many)) * lag
        own = ids[at]
        hit = np.flatnonzero(own == ids[at + lag])
        hit = hit[own[hit] == ids[at[hit] + 2 * lag[hit]]]
        hit = hit[own[hit] == ids[at[hit] + 3 * lag[hit]]]
        first = np.flatnonzero(np.diff(lag[hit], prepend=0))
        for a, b in zip(first, [*first[1:], len(hit)]):
            yield int(lag[hit[a]]), at[hit[a:b]]
        low = high


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    A run is a stretch with smallest period q, of at least max(LEAST, REPEATS * q) words, that no neighbouring word
    extends. At a multiple of q its stretch comes up again; there it is passed over: a place that lies in a run whose
    period divides the lag, and which is long enough for it, tells of nothing new."""
    n, planes, found = len(ids), None, []
    known = np.empty((0, 3), np.int64)  # (start, end, period) of runs that are long enough for the lags to come
    for lag, places in _sieve(ids):
        known = known[known[:, 1] - known[:, 0] >= REPEATS * lag]
        for s, e, _ in known[lag % known[:, 2] == 0]:
            places = places[(places < s) | (places >= e - lag)]
        if not len(places):
            continue
        planes = bit_planes(ids) if planes is None else planes
        old = {(s, e) for s, e, _ in known.tolist()}
        new = [(s, e + lag, lag) for s, e in zero_stretches(planes, n, lag, max(LEAST, REPEATS * lag) - lag) if (s, e + lag) not in old]
        if new:
            found += new
            known = np.concatenate([known, np.array(new, np.int64)])
    return sorted((s, e - s, q) for s, e, q in found)


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a tail made periodic for one doc_id in ten, by its checksum (a null doc_id: unchanged)."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]



_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs with n_words, runs (an array of start, length and period, by start, then period) and collapsed, the text without repeats.

    One pass without a shuffle; a task holds a few texts at a time. Null, empty and blank texts have no runs and an empty
    collapsed text. Rows that repeat come out as often. Columns of docs come through as a struct `row`, so no name can
    clash; an empty table gives no rows. With plant, texts are first changed as `planted` says (by the column doc_id).
    """

    def run(batches):
        for b in sliced(batches):
            size, runs, left = [], [], []
            for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = _WORDS.findall(text or "")
                words = planted(words, key) if plant else words
                got = find_runs(word_ids(words))
                size.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                left.append(" ".join(collapse(words, got)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(runs, _RUN), pa.array(left, pa.string())], ["row", "n_words", "runs", "collapsed"])

    d = packed(docs, doc_id=F.col("doc_id").cast("long") if plant else F.lit(None).cast("long"), text=F.col("text"))
    kind = d.schema["row"].dataType.simpleString()
    return d.mapInArrow(run, f"row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document, with the planted tails.

    start to exponent_milli are of the longest run (ties: least start, then period), null without a run. Odd rows as in
    `periodic_runs`; a text without runs has the digest of no lines."""
    got = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = got.select(F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length = -F.col("best.less")
    milli = F.floor(1000 * length / F.col("best.period")).cast("long")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return d.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))
