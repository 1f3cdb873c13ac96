"""Shared pieces of the training-data operators: inputs, shared folders, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space, so multi-byte characters stay whole.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under spark.checkpoint.dir; where that is unset, a temporary folder on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidebar-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, held in the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession, "unused")
    return df.checkpoint()


#: Spark's setting by which the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping(spark: SparkSession):
    """Spark is asked to drop what an action shuffled when the action ends; frames it runs on must be made in here."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """df written once as Parquet and read back. What the write shuffled is not needed again and is dropped."""
    spark = df.sparkSession
    with dropping(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the scratches that are open, the innermost last.
_SCRATCH: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written() to a folder of its own in the shared folder; it stays, or goes with the innermost scratch()."""
    path = shared_dir(df.sparkSession, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return written(df, path)


def dropped(spark: SparkSession, path: str) -> None:
    """A folder of the shared folder goes, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is staged in here goes when it ends; what is read later must be written() to a folder of its own."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            dropped(spark, path)


def sliced(batches, rows: int = 1000, size: int = 8 << 20):
    """The record batches cut into ones of at most `rows` rows and, as far as whole rows allow, about `size` bytes."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def packed(docs: DataFrame, **named) -> DataFrame:
    """docs as one struct column `row` beside named expressions over it, so that no column of docs can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[x.alias(n) for n, x in named.items()])


def filter_places(key, bits: int) -> list:
    """The two places of a key in a filter of 2 ** bits bits."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << bits)) for i in (1, 2)]


def filter_bits(keys: DataFrame, places: list, bits: int) -> np.ndarray:
    """A Bloom filter of 2 ** bits bits over the rows of keys, summed by Spark; its size does not follow the data."""
    at = keys.select(F.explode(F.array(*places)).alias("b")).select(F.floor(F.col("b") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, int(b % 64))").alias("m"))
    out = np.zeros(1 << bits - 6, np.int64)
    with dropping(keys.sparkSession):
        words = at.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # one job; as many rows of 16 bytes as the filter has words
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out


def maybe(bits: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Whether a filter may hold the keys with these places."""
    out = np.ones(len(places[0]), bool)
    for at in places:
        out &= (bits[at >> 6] >> (at & 63) & 1).astype(bool)
    return out


def texts_of(known: DataFrame, sids: DataFrame, bits: int) -> DataFrame:
    """(sid, text) of known, of the sids in sids and hardly any other: a filter of fixed size spares the shuffle of texts that no
    join wants; the join that follows is exact."""
    held = known.sparkSession.sparkContext.broadcast(filter_bits(sids, filter_places("sid", bits), bits))

    def run(batches):
        for b in batches:
            wanted = pa.array(maybe(held.value, b.column(2).to_numpy(), b.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays([c.filter(wanted) for c in b.columns[:2]], ["sid", "text"])

    return known.select("sid", "text", *filter_places("sid", bits)).mapInArrow(run, "sid long, text string")


def parted(d: DataFrame, keys: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of d whose key is certainly not in keys (kept; both have a column key), and the others, told apart by a filter of
    fixed size: only the others need a join, which is exact."""
    held = d.sparkSession.sparkContext.broadcast(filter_bits(keys, filter_places("key", bits), bits))

    def those(inside: bool):
        def run(batches):
            for b in batches:
                wanted = maybe(held.value, b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy())
                yield b.filter(pa.array(wanted == inside)).select(range(b.num_columns - 2))

        return d.select("*", *filter_places("key", bits)).mapInArrow(run, d.schema)

    return those(False), those(True)


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


# --- word and shingle hashes, over the bytes of many texts at once -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        steps = np.full(max(n, 2 * len(_POW), 256), _BASE, np.uint64)
        steps[0] = 1
        _POW = np.cumprod(steps)
    return _POW


def word_hashes(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words in UTF-8 bytes, in order; with fold, A-Z are lower-cased first."""
    solid = ~_SPACE[data]
    if not solid.any():
        return np.empty(0, np.uint64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.cumsum(solid) - 1
    begin = at[first]
    own = data[solid]
    own = (_LOWER[own] if fold else own).astype(np.uint64) + np.uint64(1)
    size = np.diff(begin, append=len(own))
    place = np.arange(len(own)) - np.repeat(begin, size)
    return mix(np.add.reduceat(own * _powers(int(size.max()))[place], begin) + size.astype(np.uint64) * _M2)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    own = min(n, k)
    acc = np.full(n - own + 1, own, np.uint64)
    for i in range(own):
        acc = mix(acc * _BASE + words[i : n - own + 1 + i])
    return np.unique(acc)


def text_shingles(text: str | None, k: int) -> np.ndarray:
    return shingle_hashes(word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)), k)
