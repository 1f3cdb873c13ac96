"""Benchmark decontamination by spaced-seed hashing (operator 3). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, staged, table

#: Places of a mask that count; the others may hold any word. By enumeration, whatever words differ: the first two meet
#: every stretch of 15 words or more that SHARE accepts, all three every one of SPAN or more (a test enumerates them).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4), (0, 1, 2, 3))
#: Fewest and most words of the items that a mask serves; words of the shortest item that masks serve.
SERVES = ((7, None), (7, None), (7, 14))
SPAN = 7
#: A stretch of this many words of an item (all of a shorter item) with this share of equal words is a leak.
STRETCH, SHARE = 20, 0.8
#: Test hashes, or keys of documents with hits or leaks, beyond this many are not broadcast (about 40 bytes each); the join is then shuffled.
BROADCAST_ROWS = 1_000_000

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _once(c: Column, f) -> Column:
    """f of c, with c evaluated once: a plain reference inside a lambda would be evaluated at every element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def word_codes(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters, digits and other non-ASCII characters, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(size: Column, mask) -> Column:
    return F.greatest(size - max(mask), F.lit(0))


def seed_hashes(codes: Column, masks=MASKS) -> Column:
    """One hash for each mask and place where it fits: the first mask at every place, then the next, and so on."""

    def under(mask) -> Column:
        name = F.lit(",".join(map(str, mask)))
        places = F.sequence(F.lit(0), _places(F.size(codes), mask) - 1)
        own = F.transform(places, lambda i: F.xxhash64(name, *[F.get(codes, i + p) for p in mask]))
        return F.when(F.size(codes) > max(mask), own).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[under(m) for m in masks])


def _seeded(df: DataFrame, *keep: str, masks=MASKS) -> DataFrame:
    """(keep, mask, h, at) of a frame with the column codes: seed hashes, their masks' numbers and the places they begin at."""
    d = df.select(*keep, "codes").withColumn("size", F.size("codes")).withColumn("hs", _once(F.col("codes"), lambda c: seed_hashes(c, masks)))
    # The outer form keeps the optimizer from filtering on a second evaluation of hs; its null hashes join nothing.
    d = d.select(*keep, "size", F.posexplode_outer("hs").alias("i", "h"))
    begin, mask, at = F.lit(0), F.lit(0), F.col("i")
    for k, m in enumerate(masks[:-1], 1):
        begin = begin + _places(F.col("size"), m)
        mask, at = F.when(F.col("i") >= begin, k).otherwise(mask), F.when(F.col("i") >= begin, F.col("i") - begin).otherwise(at)
    return d.select(*keep, mask.alias("mask"), "h", at.alias("at"))


def benchmark_codes(items: DataFrame) -> DataFrame:
    """(item_id, codes) of the items long enough for the masks."""
    return items.select(F.col("item_id").cast("long"), word_codes(F.col("text")).alias("codes")).where(F.size("codes") >= SPAN)


def _exact(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, share 1.0) of the documents that hold the whole word sequence of an item below SPAN words."""
    short = items.select(F.col("item_id").cast("long"), word_codes(F.col("text")).alias("codes")).withColumn("n", F.size("codes")).where((F.col("n") > 0) & (F.col("n") < SPAN))
    sizes = sorted(r.n for r in short.select("n").distinct().collect())  # SPAN - 1 numbers at most
    if not sizes:
        return docs.select("key", F.lit(0).cast("long").alias("item_id"), F.lit(1.0).alias("share")).where("false")
    runs = tuple(tuple(range(n)) for n in sizes)
    own = _seeded(short, "item_id", "n", masks=runs).where(F.get(F.array(*map(F.lit, sizes)), F.col("mask")) == F.col("n")).select("item_id", "h")
    few = own.count() <= BROADCAST_ROWS
    at = _seeded(docs.select("key", word_codes(F.col("text")).alias("codes")), "key", masks=runs).select("key", "h")
    return at.join(F.broadcast(own) if few else own, "h").select("key", "item_id", F.lit(1.0).alias("share")).distinct()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, share) for each document row (by its key) and item it holds a stretch of.

    Hashes of every place of every whole text meet the items' hashes (broadcast while few, else shuffled); the hits of
    a document, at most a few a place, are brought together by item, and along each diagonal the words are compared. Items below
    SPAN words are looked up by their whole word sequence.
    """
    tests = benchmark_codes(items)
    least = tests.agg(F.min(F.size("codes"))).first()[0] or SPAN
    # Masks that serve no item of the benchmark are left out of the documents' hashes.
    served = [(m, most) for m, (_, most) in zip(MASKS, SERVES) if most is None or least <= most]
    masks = tuple(m for m, _ in served)
    seeds = _seeded(tests.withColumn("n", F.size("codes")), "item_id", "n", masks=masks)
    for k, (_, most) in enumerate(served):
        if most is not None:
            seeds = seeds.where((F.col("mask") != k) | (F.col("n") <= most))
    seeds = seeds.select("item_id", "h", F.col("at").alias("item_at"))
    # The benchmark's hashes are counted first: only a proven small side is broadcast.
    few = seeds.count() <= BROADCAST_ROWS
    coded = docs.select("key", word_codes(F.col("text")).alias("codes"))
    hits = _seeded(coded, "key", masks=masks).join(F.broadcast(seeds) if few else seeds, "h")
    # A row a document and item: the text's words are coded again once for it, whatever the number of its diagonals.
    hits = staged(hits.groupBy("key", "item_id").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("ds")), "hits")
    texts, keys = docs.select("key", "text"), hits.select("key").distinct()
    if keys.count() <= BROADCAST_ROWS:  # few texts hold a hit, and no others move
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    hits = hits.join(F.broadcast(tests) if few else tests, "item_id").withColumnRenamed("codes", "item")
    at = hits.join(texts, "key")
    best = _once(F.struct(word_codes(F.col("text")).alias("codes"), F.col("item").alias("item"), F.col("ds").alias("ds")), lambda x: F.array_max(F.transform(x["ds"], lambda d: _best_stretch(x, d))))
    # Repeated rows of docs have one key, so they come in once each: one of them tells for all.
    found = at.select("key", "item_id", best.alias("share")).groupBy("key", "item_id").agg(F.max("share").alias("share"))
    found = found.where(F.col("share") >= SHARE)
    return found.unionByName(_exact(docs, items))


def _best_stretch(x: Column, d: Column) -> Column:
    """The largest share of equal words in a stretch of the item laid along diagonal d of the document."""

    def word(w, i):
        place = i + d
        return F.coalesce((F.get(x["codes"], F.when(place >= 0, place)) == w).cast("int"), F.lit(0))

    def stretches(same):
        long = F.least(F.size(same), F.lit(STRETCH))
        sums = F.transform(F.sequence(F.lit(1), F.size(same) - long + 1), lambda s: F.aggregate(F.slice(same, s, long), F.lit(0), lambda a, b: a + b))
        return F.array_max(sums) / long

    return _once(F.transform(x["item"], word), stretches)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, best_share) of every row of docs.

    Null or empty texts and empty benchmarks give clean rows, null items are skipped, repeated rows repeat.
    """
    d = keyed(docs)
    found = leaks(d, items).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("best_share"))
    out = d.select("doc_id", "key").join(found, "key", "left")
    n = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.when(F.col("items").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    d = packed(docs, key=F.xxhash64("doc_id", "text"))
    found = staged(leaks(keyed(docs), items).select("key").distinct(), "leaks")
    few = found.count() <= BROADCAST_ROWS
    return d.join(F.broadcast(found) if few else found, "key", "left_anti").select("row.*")


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`judged` for every document against every benchmark item, the shortest included; odd rows as there."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
