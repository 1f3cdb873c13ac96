"""N-gram Jaccard join by PartEnum signatures, and the components of its links (operator 4)."""

from __future__ import annotations

from bisect import bisect_right
from itertools import combinations
from math import exp, sqrt
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_bits, filter_places, maybe, mix, scratch, shared_dir, sliced, staged, table, text_shingles, texts_of, written

#: Buckets up to this many sets compare all their pairs; larger ones compare with a pivot first.
SMALL = 12
#: Least cells of a sketch; bits, as a power of 2, of the filter that finds the texts to compare: 2 MB, whatever the data.
CELLS, FILTER_BITS = 128, 24
#: Bits of the filter that finds shared shingles before they are shuffled, as a power of 2: 16 MB, whatever the data.
SHARED_BITS = 27
#: A share of the shingles, one in so many, is looked at first to tell which sets can still link.
SHARE = 3
#: Most sets, and about the most shingles, of one side of a block comparison; shared shingles that it counts at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS, SALT = 2048, 1 << 20, 4096, 32
#: Steps of size that a band spans (neighbours overlap in one of them); seeds tried before a set gives a signature of its band alone.
BAND, _SEEDS = 5, 6
#: Bits of a signature that are kept (sets that agree in them by chance are compared, as all are); signatures that a task packs
#: at a time, and into how many ranges of their values for each partition of a shuffle.
SIG_BITS, PACK, RANGES = 48, 1 << 20, 16


class PartEnum:
    """Signatures of sets, such that sets with 100 * intersection >= threshold * union share one.

    Sizes fall into overlapping bands, and two similar sets share a band. There the hashed element domain is cut into
    first-level parts of `cells` second-level cells. A set that differs from a similar one of its size or larger in at
    most d elements needs d // (miss + 1) + 1 good parts, ones with more than `miss` non-empty cells: one of them holds at
    most `miss` differences, so some non-empty subset of cells - miss of its cells is alike in both sets. A set gives a
    signature for each non-empty subset of each part, in order of the parts, until it has that many good ones. Of two
    similar sets, what the one that stops first shares with the other lies before the other's end, so no pair is lost.
    Sets that run out of parts also give the signatures of a further seed, as often as it takes.
    """

    def __init__(self, threshold: int = 85, cells: int = 3, miss: int = 1):
        self.t, self.cells, self.miss = threshold, cells, miss
        self.subsets = [np.array(s) for s in combinations(range(cells), cells - miss)]
        self.low, self.high, self.parts = [1], [1], [0]

    def _partner(self, n: int) -> int:
        return 100 * n // self.t  # the largest size that can be similar to size n

    def need(self, n: int) -> int:
        """Good parts that a set of n elements must show; 0 if it is similar to equal sets alone."""
        d = (100 - self.t) * (n + self._partner(n)) // (100 + self.t)
        return d // (self.miss + 1) + 1 if d else 0

    def _extend(self, n: int) -> None:
        while self.low[-1] <= n:
            top = self.high[-1]
            low = top * self.t // 100
            while self._partner(low + 1) <= top:
                low += 1
            low = max(low, self.low[-1]) + 1
            high = low
            for _ in range(BAND):
                high = max(self._partner(high), high)
            need, parts = self.need(high), 0
            while need:
                parts += 1
                full = 1 - exp(-high / (parts * self.cells))
                good = sum(_choose(self.cells, i) * full**i * (1 - full) ** (self.cells - i) for i in range(self.miss + 1, self.cells + 1))
                if parts * good - 2 * sqrt(max(0.0, parts * good * (1 - good))) >= need or parts > 2 * need + 3:
                    break
            self.low.append(low)
            self.high.append(high)
            self.parts.append(parts)

    def bands(self, n: int) -> list[int]:
        self._extend(n)
        i = bisect_right(self.low, n) - 1
        return [j for j in range(max(0, i - 3), i + 1) if self.low[j] <= n <= self.high[j]]

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """Of a sorted array of distinct 64-bit hashes; sets that can only link with equal sets have none."""
        out, need = [], self.need(len(h))
        for j in self.bands(len(h)):
            parts = self.parts[j]
            if not parts:
                continue
            own = h
            for seed in range(_SEEDS):
                if seed:
                    own = np.sort(mix(h + np.uint64(seed * 0xA0761D6478BD642F & (1 << 64) - 1)))
                code = np.uint64((j * _SEEDS + seed) * 0x9FB21C651E98DF25 & (1 << 64) - 1)
                cell = ((own >> np.uint64(32)) * np.uint64(parts * self.cells) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                sums = np.zeros(parts * self.cells, np.uint64)
                sums[cell[first]] = np.add.reduceat(mix(own ^ np.uint64(0x8BB84B93962EACC9)), first)
                full = np.zeros(parts * self.cells, bool)
                full[cell[first]] = True
                sums, full = sums.reshape(parts, -1), full.reshape(parts, -1)
                good = np.cumsum(full.sum(axis=1) > self.miss)
                enough = bool(good[-1] >= need)
                end = int(np.searchsorted(good, need)) + 1 if enough else parts
                sums, full = sums[:end], full[:end]
                place = np.arange(end, dtype=np.uint64) * np.uint64(64)
                for i, s in enumerate(self.subsets):
                    sig = mix(mix(sums[:, s].sum(axis=1, dtype=np.uint64)) + mix(place + np.uint64(i) + code))
                    out.append(sig[full[:, s].any(axis=1)])
                if enough:
                    break
            else:
                out.append(mix(np.array([j + 1], np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def set_id(h: np.ndarray) -> int:
    """A 64-bit name of a set of hashes, as a signed integer."""
    return int(mix(np.array([mix(h ^ np.uint64(0x2D358DCCAA6C78A5)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key, which tells its rows apart whatever doc_id holds (equal keys are repeated rows)."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


_HEAD = Struct("<QB")


def packs(sigs: np.ndarray, sids: np.ndarray, ranges: int):
    """(range, bytes) of signatures and the ids of their sets: of each range of values its least signature, then, in ascending
    order, what each adds to the one before, in as few bytes as the largest needs, then the ids."""
    sigs = sigs >> np.uint64(64 - SIG_BITS)
    order = np.argsort(sigs)
    sigs, sids = sigs[order], sids[order]
    part = (sigs * np.uint64(ranges) >> np.uint64(SIG_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    more = np.diff(sigs, prepend=np.uint64(0))
    more[first] = 0
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(sigs)]):
        width = max(1, (int(more[i:j].max()).bit_length() + 7) // 8)
        yield int(part[i]), _HEAD.pack(int(sigs[i]), width) + more[i:j].view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + sids[i:j].tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, ids) of the bytes of a range."""
    least, width = _HEAD.unpack_from(data)
    n = (len(data) - _HEAD.size) // (width + 8)
    more = np.zeros((n, 8), np.uint8)
    more[:, :width] = np.frombuffer(data, np.uint8, n * width, _HEAD.size).reshape(n, width)
    return np.uint64(least) + np.cumsum(more.view(np.uint64).ravel()), np.frombuffer(data, np.int64, n, _HEAD.size + n * width)


def expanded(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(at, sid, n, low, many) by one pass over the texts. With n: a row of docs, at is its key, sid names its set of n shingles of
    k words (null if empty). Without n: at is a signature that set sid shares with others, many with it, the least of them low.

    Signatures move as packs, by ranges of their values: a fraction of the bytes that a row each would take, of which there
    are some hundreds a text. A task of the shuffle looks at a range at a time."""
    ranges = min(1 << 16, max(64, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def rows(part, key=None, sid=None, n=None, pack=None):
        none = [None] * len(part)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(none if x is None else x, t) for x, t in zip((part, key, sid, n, pack), types)], ["part", "key", "sid", "n", "pack"])

    def run(batches):
        rule, seen, sigs, sids, held = PartEnum(threshold), set(), [], [], 0

        def packed_rows():
            both = list(packs(np.concatenate(sigs), np.concatenate(sids), ranges))
            sigs.clear(), sids.clear()
            for i in range(0, len(both), 1000):
                yield rows([p for p, _ in both[i : i + 1000]], pack=[x for _, x in both[i : i + 1000]])

        for b in sliced(batches):
            n, sid, key = [], [], b.column(0).to_numpy()
            for text in b.column(1).to_pylist():
                h = text_shingles(text, k)
                n.append(len(h))
                sid.append(set_id(h) if len(h) else None)
                if len(h) and sid[-1] not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(sid[-1])
                    sigs.append(rule.signatures(h))
                    sids.append(np.full(len(sigs[-1]), sid[-1], np.int64))
                    held += len(sigs[-1])
                    if held >= PACK:
                        yield from packed_rows()
                        held = 0
            yield rows((key % ranges).astype(np.int32), key, sid, n)
        if held:
            yield from packed_rows()

    def met(t: pa.Table) -> pa.Table:
        known = t.filter(t.column("n").is_valid())
        none = pa.nulls(known.num_rows, pa.int64())
        both = [unpacked(x) for x in t.column("pack").drop_null().to_pylist()]
        sig, sid = (np.concatenate([x[i] for x in both]) if both else np.empty(0, np.int64) for i in (0, 1))
        order = np.argsort(sig)
        again = sig[order[1:]] == sig[order[:-1]]
        order = order[np.append(again, False) | np.insert(again, 0, False)] if len(order) else order
        sig, sid = sig[order].astype(np.int64), sid[order]
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])  # a set may come from several tasks
        sig, sid = sig[new], sid[new]
        first = np.flatnonzero(np.diff(sig, prepend=-1))
        many = np.diff(first, append=len(sig))
        low, many = np.repeat(sid[first], many), np.repeat(many, many)
        ok = many > 1
        out = [np.array(x[ok], np.int64) for x in (sig, sid, low, many)]
        shared = [pa.array(out[0]), pa.array(out[1]), pa.nulls(int(ok.sum()), pa.int64()), pa.array(out[2]), pa.array(out[3])]
        names = ["at", "sid", "n", "low", "many"]
        return pa.concat_tables([pa.table([known.column("key"), known.column("sid"), known.column("n"), none, none], names), pa.table(shared, names)])

    moved = docs.select("key", "text").mapInArrow(run, "part int, key long, sid long, n long, pack binary")
    return moved.groupBy("part").applyInArrow(met, "at long, sid long, n long, low long, many long")


def _sketch(h: np.ndarray) -> bytes:
    """How many elements fall into each of its cells, 255 at most: CELLS cells, or about half as many as elements.

    The sum of two sketches' differences is never more than the number of elements in which the sets differ, so a
    sketch can rule a pair out but never a link. A finer sketch folds to a coarser one."""
    cells = max(CELLS, 1 << (max(1, len(h) // 2)).bit_length() - 1)
    return np.minimum(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _folded(sketch: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8).reshape(-1, cells).sum(axis=0, dtype=np.int32)


def _apart(a: bytes, b: bytes) -> int:
    """The least number of elements in which the sets of two sketches differ. A cell that is full counts as no difference."""
    if 255 in a or 255 in b:
        a, b = (np.frombuffer(x, np.uint8) for x in (a, b))
        return 0 if len(a) != len(b) else int(np.abs(a.astype(np.int32) - b).sum())
    cells = min(len(a), len(b))
    return int(np.abs(_folded(a, cells) - _folded(b, cells)).sum())


def involved(docs: DataFrame, sets: DataFrame, sids: DataFrame, k: int) -> DataFrame:
    """(sid, n, sketch, text) of the sets in sids, one text each, kept for the comparisons.

    A filter of fixed size over the keys of one row a set first passes over docs, so that only texts that may be wanted
    are cut into shingles and shuffled; the join that follows is exact."""
    one = staged(sets.join(sids, "sid").groupBy("sid").agg(F.min(F.struct("key", "n")).alias("m")).select("sid", F.col("m.key").alias("key"), F.col("m.n").alias("n")), "one")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(one, filter_places("key", FILTER_BITS), FILTER_BITS))

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            wanted = maybe(bits.value, b.column(2).to_numpy(), b.column(3).to_numpy())
            for part in sliced([b.filter(pa.array(wanted))]):
                out = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if key in seen or not len(h := text_shingles(text, k)):
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    out.append((key, _sketch(h), text))
                types = (pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["key", "sketch", "text"])

    found = docs.select("key", "text", *filter_places("key", FILTER_BITS)).mapInArrow(run, "key long, sketch binary, text string")
    found = found.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text")).join(one, "key")
    found = staged(found.select("sid", "n", "sketch", "text"), "involved")
    bits.destroy()
    return found


def verified(pairs: DataFrame, known: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets are similar. Sizes and sketches rule out most pairs before any text moves."""
    brief = known.select("sid", "n", "sketch")
    p = pairs.join(brief.toDF("a", "na", "ka"), "a").join(brief.toDF("b", "nb", "kb"), "b")

    def near(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            far = np.array([_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            ok = _possible(far, na, nb, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    p = staged(p.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(near, "a long, b long"), "near")
    text = texts_of(known, p.select(F.explode(F.array("a", "b")).alias("sid")), FILTER_BITS)
    p = p.join(text.toDF("b", "tb"), "b").join(text.toDF("a", "ta"), "a")

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(sid, text):
            if sid not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[sid] = text_shingles(text, k)
            return kept[sid]

        for batch in sliced(batches, 250):
            out = []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = of(a, ta), of(b, tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return p.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _possible(differ, na, nb, threshold: int):
    """Whether sets of these sizes that differ in `differ` elements at least can still be similar."""
    both = na + nb
    return ((100 + threshold) * np.maximum(differ, np.abs(na - nb)) <= (100 - threshold) * both) & (differ < both)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over links (a, b), for nodes that have links.

    Alternating large-star and small-star steps, each a grouped minimum and a join; a hub is a sum a task and a key that
    the join can split. Links go from a node u to a lesser one v. They end as stars, where whoever has a lesser neighbour
    has no other; links that come as stars take no step. Every step is kept in the shared folder and its shuffle dropped.
    """
    e = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = e.withColumn("up", F.lit(1)).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        near = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum("up").alias("up"), F.count("*").alias("every")), "near")
        if near.where("up > 0 AND every > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = e.join(near.where("every > up").select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")  # u goes to its least neighbour m, and so do its others
        e = staged(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "links")


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs of each small bucket's sets."""
    sets = rows.groupBy("sig").agg(F.array_sort(F.collect_set("sid")).alias("s"))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode_outer(pair).alias("p")).where("p IS NOT NULL").select("p.a", "p.b")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (sig, sid) of the buckets that lie in several components, with root, the component of sid, and low."""
    rows = rows.select("sig", "sid").distinct().join(roots, F.col("sid") == F.col("node"), "left").select("sig", "sid", F.coalesce("root", "sid").alias("root"))
    return _several(rows)


def _several(rows: DataFrame) -> DataFrame:
    """rows (sig, sid, root) of the buckets that lie in several components, with low, the bucket's least set."""
    several = rows.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("sid").alias("low")).where("r1 <> r2")
    return rows.join(several.select("sig", "low"), "sig")


def _shared(sets: DataFrame, k: int, first: bool) -> DataFrame:
    """(sid, size, c) of sets (sid, root, text): of one share of their shingles, chosen by hash, how many a set has and how many
    of these another component has too. Sets without any in that share give no row.

    Shared shingles are found by a grouped minimum and maximum; a filter of fixed size then keeps most others out of the
    join that counts them, which is exact."""
    mask = (1 << SHARED_BITS) - 1

    def shingles(bits=None):
        def run(batches):
            low, share = np.uint64(mask), np.uint64(SHARE)
            for b in sliced(batches, 250):
                hs = [h[(h % share == 0) == first] for h in (text_shingles(t, k) for t in b.column(2).to_pylist())]
                n = [len(h) for h in hs]
                if bits is not None:
                    keep = [maybe(bits.value, (h & low).astype(np.int64), (h >> np.uint64(32) & low).astype(np.int64)) for h in hs]
                    for m in keep:
                        m[:1] = True  # so that a set is there even if it shares nothing
                    hs = [h[m] for h, m in zip(hs, keep)]
                size = [len(h) for h in hs]
                own, root, n = (np.repeat(x, size) for x in (b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(n, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(own), pa.array(root), pa.array(n)], ["h", "sid", "root", "size"])

        return sets.select("sid", "root", "text").mapInArrow(run, "h long, sid long, root long, size long")

    w = F.struct(F.min("root").alias("r1"), F.max("root").alias("r2"))
    common = staged(shingles().groupBy("h").agg(w.alias("r")).where("r.r1 <> r.r2").select("h"), "common")
    places = [F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask))]
    bits = sets.sparkSession.sparkContext.broadcast(filter_bits(common, places, SHARED_BITS))
    met = shingles(bits).select("h", "sid", "size").join(common.withColumn("met", F.lit(1)), "h", "left")
    met = staged(met.groupBy("sid").agg(F.first("size").alias("size"), F.count("met").alias("c")), "met")
    bits.destroy()  # else every executor holds its 16 MB on disk until the driver happens to collect its garbage
    return met


def _shareable(sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those of sets (sid, root, n, text; kept) that can still link with a set of another component.

    Shingles held by one component alone are no common ones, and of n shingles a link leaves out at most 100 - threshold %.
    A first share of the shingles shows that of most sets; the rest is looked at for the others alone, and among them."""
    spare = lambda c, size: (size - c) * 100 <= F.col("n") * (100 - threshold)
    brief = sets.select("sid", "root", "n")
    some = brief.join(_shared(sets, k, True).withColumnRenamed("c", "c1"), "sid", "left").where(F.col("size").isNull() | spare(F.col("c1"), F.col("size")))
    some = staged(some.select("sid", "root", "n", F.coalesce("c1", F.lit(0)).alias("c1")), "some")
    rest = _shared(staged(some.join(texts_of(sets, some, FILTER_BITS), "sid"), "texts"), k, False).drop("size")
    some = staged(some.join(rest, "sid", "left").where(spare(F.col("c1") + F.coalesce("c", F.lit(0)), F.col("n"))).select("sid", "root", "n"), "open")
    return some.join(texts_of(sets, some, FILTER_BITS), "sid")


def _block_links(sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """(a, b): roots of components that a link between sets (cloud, sid, root, n, text) of a cloud connects, enough of them to
    connect whatever links connect, and no more than one a set and block.

    Sets outside a cloud's largest component meet all of the cloud; those inside it need not meet each other. Both sides
    come in blocks of bounded size, and a pair of blocks counts all its common shingles by products of 0/1 matrices."""
    parts = sets.groupBy("cloud", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    shape = parts.groupBy("cloud").agg(F.max(F.struct("m", "root", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.greatest(F.ceil(m / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    shape = shape.select("cloud", F.col("top.root").alias("top"), blocks(F.col("m"), F.col("s")).alias("wide"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("deep"))
    # A cloud may hold a large share of the sets, so its figures meet them in SALT parts.
    shape = shape.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    d = sets.withColumn("own", F.xxhash64("sid")).withColumn("part", F.pmod(F.shiftright("own", 32), F.lit(SALT)).cast("int")).join(shape, ["cloud", "part"])
    base = d.withColumns({"x": F.explode(F.sequence(F.lit(0), F.col("deep") - 1)), "y": F.pmod("own", F.col("wide")).cast("int"), "probe": F.lit(False)})
    probe = d.where("root <> top").withColumns({"x": F.pmod("own", F.col("deep")).cast("int"), "y": F.explode(F.sequence(F.lit(0), F.col("wide") - 1)), "probe": F.lit(True)})

    def compare(t: pa.Table) -> pa.Table:
        _, first, place = np.unique(t.column("sid").to_numpy(), return_index=True, return_inverse=True)
        text = t.column("text")
        hs = [text_shingles(text[int(i)].as_py(), k) for i in first]
        root, n = t.column("root").to_numpy()[first], np.array([len(h) for h in hs])
        probe_ = t.column("probe").to_numpy(zero_copy_only=False)
        left, right = np.unique(place[probe_]), np.unique(place[~probe_])
        row = np.repeat(np.arange(len(hs)), n)
        _, col, often = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        row, col = row[often[col] > 1], (np.cumsum(often > 1) - 1)[col[often[col] > 1]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            lo, hi = np.searchsorted(col, (begin, begin + COLUMNS))
            m = np.zeros((len(hs), COLUMNS), np.float32)
            m[row[lo:hi], col[lo:hi] - begin] = 1
            common += m[left] @ m[right].T
        label, a, b = root.copy(), [], []
        for i, c in zip(left, common.astype(np.int64)):
            ok = right[100 * c >= threshold * (n[i] + n[right] - c)]
            for j in ok[np.unique(label[ok], return_index=True)[1]]:
                if label[i] != label[j]:
                    a.append(root[i])
                    b.append(root[j])
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cols = ["cloud", "x", "y", "probe", "sid", "root", "text"]
    return base.select(*cols).unionByName(probe.select(*cols)).groupBy("cloud", "x", "y").applyInArrow(compare, "a long, b long")


def links(rows: DataFrame, docs: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """(node, root) of the components of all similar pairs of sets, from rows (sig, sid, low, many) of shared signatures.

    A pair inside one component adds nothing to them. Buckets of up to SMALL sets compare all pairs; larger ones first
    compare each set with the bucket's least one. Sets of large buckets that this leaves in several components, and that
    hold enough shingles of other components to link with them, are then compared in blocks, cloud by cloud: the sets
    that such buckets hold together.
    """
    spark = docs.sparkSession
    known = involved(docs, sets, rows.select("sid").distinct(), k)
    large = rows.where(F.col("many") > SMALL)
    pairs = _all_pairs(rows.where(F.col("many") <= SMALL)).unionByName(large.where("sid <> low").select(F.col("low").alias("a"), F.col("sid").alias("b")))
    roots = components(verified(pairs.distinct(), known, k, threshold))
    left = staged(_rooted(large, roots), "left")
    some = left.select("sid", "root").distinct()
    some = staged(some.join(known.select("sid", "n"), "sid").join(texts_of(known, some, FILTER_BITS), "sid"), "clouds")
    some = staged(_shareable(some, k, threshold), "open")
    left = _several(staged(left.drop("low").join(some.select("sid"), "sid", "left_semi"), "left"))
    clouds = components(left.select(F.col("low").alias("a"), F.col("sid").alias("b")))
    new = _block_links(some.join(clouds.select(F.col("node").alias("sid"), F.col("root").alias("cloud")), "sid"), k, threshold)
    new = staged(new, "new")
    if new.isEmpty():
        return roots
    met = components(new)  # among roots alone; what is known already need not go through it again
    return roots.join(met.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(met)


def classes(docs: DataFrame, k: int = 4, threshold: int = 85) -> DataFrame:
    """(doc_id, key, n_shingles, comp, component_id) of every row of docs: comp names its component, component_id is the
    least doc_id in it.

    Null and blank texts have no shingles, no comp, and their own doc_id as component_id. Rows that repeat a text share a
    component whatever their doc_id; a null doc_id is never the least unless there is no other. Other columns of docs
    are not read; an empty table gives no rows.
    """
    docs, spark = keyed(docs), docs.sparkSession
    with scratch(spark):  # texts and signatures are not needed once the components are known
        rows = staged(expanded(docs, k, threshold), "signatures")
        sets = rows.where("n IS NOT NULL").groupBy(F.col("at").alias("key")).agg(F.first("sid").alias("sid"), F.first("n").alias("n"))
        sets = written(sets, shared_dir(spark, "sets"))
        roots = links(rows.where("n IS NULL").select(F.col("at").alias("sig"), "sid", "low", "many"), docs, sets, k, threshold)
        roots = written(roots, shared_dir(spark, "roots"))
    s = docs.select("doc_id", "key").join(sets, "key").join(roots, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "sid"))
    least = s.where("comp IS NOT NULL").groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("least"))
    s = s.join(least, F.col("comp") == F.col("c"), "left")
    return s.select("doc_id", "key", F.col("n").alias("n_shingles"), "comp", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def spare(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(key, dropped) of the keys whose rows do not all stay where one row of each component is kept, that of least doc_id, then
    least key: dropped ones, and those of repeated rows, of which one stays. Rows without shingles are no copies of each other."""
    c = classes(docs, k, threshold).groupBy("key").agg(F.count("*").alias("rows"), F.first("doc_id").alias("doc_id"), F.first("comp").alias("comp"))
    c = written(c, shared_dir(docs.sparkSession, "classes"))
    kept = c.where("comp IS NOT NULL").groupBy(F.col("comp").alias("c")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "key")).alias("m"))
    c = c.join(kept.select("c", F.col("m.key").alias("_kept")), F.col("comp") == F.col("c"), "left").withColumn("dropped", F.coalesce(F.col("key") != F.col("_kept"), F.lit(False)))
    return c.where("dropped OR rows > 1").select("key", "dropped")


def op4_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, by 4-word shingles at 85 %; odd rows as in `classes`."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
