"""Removal of repeated passages, located by sharded automata (operator 12).

A window is SPAN consecutive words, and it recurs if its word sequence starts at two places. Windows are brought together by
anchors: the least hash among a window's grams. Consecutive windows with one anchor are a segment, so a segment stands for
up to SPAN - GRAM + 1 windows, and a text shuffles one row for about 14 words. A segment met twice recurs as a whole; the
windows of the others are compared one by one with those under the same anchor. What recurs is confirmed as passages: word
stretches of one document, every window of which recurs.

Documents are dealt to blocks. Each block gets the passages that its documents need, compiles them into an automaton, and
streams its documents through it; a hit is grown, word by word, as far as document and passage agree.
"""

from __future__ import annotations

from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, filter_bits, filter_places, maybe, mix, packed, sliced, staged, table, word_hashes

#: Words of a window and of the grams that anchors are chosen from (the hashing below is laid out for these two).
SPAN, GRAM = 35, 8
#: Words of a piece of a passage: every window holds one of the pieces that a passage is cut into.
PIECE = SPAN // 2 + 1
#: Bits, as powers of 2, of the filters over recurring anchors and over documents that hold them (16 and 4 MB, whatever
#: the data); they spare shuffles and never decide a result.
ANCHOR_BITS, KEY_BITS = 27, 25
#: Places, as a power of 2, of an automaton's table of word pairs (4 MB); it spares steps of the automaton and decides no result.
PAIR_BITS = 22
#: Characters of the documents that share an automaton.
BLOCK_CHARS = 8 << 20

#: Letters that automata tell apart: code points but 0, which is for unknown words, and the surrogates.
_LETTERS = 0x110000 - 0x800 - 1


def _words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes split at ASCII white space alone, as the contract's words do."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _text(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x[: len(y)] * _BASE + y)


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every gram and of every window of word hashes."""
    two = _joined(words, words[1:])
    four = _joined(two, two[2:])
    eight = _joined(four, four[4:])
    sixteen = _joined(eight, eight[8:])
    long = _joined(sixteen, sixteen[16:])
    return eight, _joined(_joined(long, two[32:]), words[34:])


def segments(text: str | None) -> tuple[np.ndarray, ...]:
    """(anchor, name, first, width, n): the distinct segments of a text; windows first to first + width, met n times in it.

    A window's anchor is the leftmost of its least grams. A segment ends where the least changes or is left behind, so
    equal words always give equal segments. Name tells its words: those of its first and last window are all of them."""
    words = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), fold=False)
    if len(words) < SPAN:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    grams, windows = window_hashes(words)
    least = grams
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    over = SPAN - GRAM + 1  # grams of a window; two stretches of 16 cover them
    least = np.minimum(least[: len(windows)], least[over - 16 : over - 16 + len(windows)])
    cut = np.ones(len(windows), bool)
    cut[1:] = (least[1:] != least[:-1]) | (grams[: len(windows) - 1] == least[:-1])
    first = np.flatnonzero(cut)
    width = np.diff(first, append=len(windows)) - 1
    anchor = least[first]
    name = mix(windows[first] * _BASE + windows[first + width]) + mix(width.astype(np.uint64))
    _, one, n = np.unique(mix(anchor) + name, return_index=True, return_counts=True)
    return anchor[one].view(np.int64), name[one].view(np.int64), first[one], width[one], n


def _key():
    return F.xxhash64("doc_id", "text")


def anchored(docs: DataFrame) -> DataFrame:
    """(key, a, name, lo, width, n) of every distinct segment of every text of docs (key, text)."""

    def run(batches):
        for b in sliced(batches):
            got = [segments(t) for t in b.column(1).to_pylist()]
            cols = [np.concatenate([g[i] for g in got]) for i in range(5)]
            key = np.repeat(b.column(0).to_numpy(), [len(g[0]) for g in got])
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(c.astype(np.int64)) for c in cols]], ["key", "a", "name", "lo", "width", "n"])

    return docs.mapInArrow(run, "key long, a long, name long, lo long, width long, n long")


def _anchor_places() -> list:
    mask = (1 << ANCHOR_BITS) - 1
    return [F.col("a").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("a", 32).bitwiseAND(F.lit(mask))]


def _repeated_anchors(rows: DataFrame) -> DataFrame:
    """Those of rows whose anchor may occur more than once: all that do, and hardly any other while the filter has room."""
    often = rows.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    bits = rows.sparkSession.sparkContext.broadcast(filter_bits(often, _anchor_places(), ANCHOR_BITS))
    mask = np.uint64((1 << ANCHOR_BITS) - 1)

    def run(batches):
        for b in batches:
            a = b.column(1).to_numpy().view(np.uint64)
            yield b.filter(pa.array(maybe(bits.value, (a & mask).astype(np.int64), (a >> np.uint64(32) & mask).astype(np.int64))))

    return rows.mapInArrow(run, rows.schema)


def _with_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with the mark `maybe`, false only where keys does not hold their key."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(keys, filter_places("key", KEY_BITS), KEY_BITS))
    docs = docs.select("*", *[p.alias(f"_place{i}") for i, p in enumerate(filter_places("key", KEY_BITS))])

    def run(batches):
        for b in batches:
            mark = maybe(bits.value, *(b.column(b.num_columns - i).to_numpy() for i in (2, 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(mark)], [*b.schema.names[:-2], "maybe"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-2])
    return docs.mapInArrow(run, f"{kinds}, maybe boolean")


def _stretches(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges (first, last) of windows, those that meet or touch made one."""
    out: list[list[int]] = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """From wanted (key, a, lo, width, n, single), segments by the document to take them from: rows (key, lo, text) with the
    words of their stretches, and, where single, (key, lo, a, window, n) with the hash of each of their windows."""
    own = wanted.groupBy("key").agg(F.collect_list(F.struct("lo", "width", "a", "n", "single")).alias("parts"))
    texts = _with_keys(docs, wanted.select("key")).where("maybe").select("key", "text")

    def run(batches):
        for b in sliced(batches, 200):
            cuts, singles = [], []
            for key, text, parts in zip(*[c.to_pylist() for c in b.columns]):
                words = _words(text)
                cuts += [(key, lo, _text(words[lo : hi + SPAN])) for lo, hi in _stretches([(p["lo"], p["lo"] + p["width"]) for p in parts])]
                if parts := [p for p in parts if p["single"]]:
                    windows = window_hashes(word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), fold=False))[1].view(np.int64)
                    size = np.array([p["width"] + 1 for p in parts])
                    at = np.repeat([p["lo"] for p in parts], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    singles.append((np.full(len(at), key), at, np.repeat([p["a"] for p in parts], size), windows[at], np.repeat([p["n"] for p in parts], size)))
            names = ["key", "lo", "text", "a", "window", "n"]
            none = pa.nulls(len(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), pa.array([c[2] for c in cuts], pa.string()), none, none, none], names)
            if singles:
                key, at, a, window, n = (pa.array(np.concatenate([s[i] for s in singles]).astype(np.int64)) for i in range(5))
                yield pa.RecordBatch.from_arrays([key, at, pa.nulls(len(key), pa.string()), a, window, n], names)

    kind = "key long, lo long, text string, a long, window long, n long"
    return staged(texts.join(own, "key").select("key", "text", "parts").mapInArrow(run, kind), "passages")


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (key, text): cuts (key, lo, text), stretches of words of some documents; and needs (key, source, lo, hi): the
    document `key` holds windows that recur as windows lo to hi of the document `source`, which lie in one of its cuts."""
    rows = _repeated_anchors(staged(anchored(docs), "anchors"))
    segs = staged(rows.groupBy("a", "name").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo")).alias("at"), F.first("width").alias("width")), "segments")
    # Where a segment occurs once, its windows may still recur in others of its anchor.
    open_ = staged(segs.groupBy("a").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1 AND least = 1").select(F.col("a").alias("open")), "open")
    segs = segs.join(open_, F.col("a") == F.col("open"), "left").where("n > 1 OR open IS NOT NULL")
    segs = staged(segs.select("a", "name", F.least("n", F.lit(2)).alias("n"), "at.key", "at.lo", "width", F.col("open").isNotNull().alias("single")), "wanted")
    cuts = _cut(docs, segs)
    whole = segs.where("n > 1").select("a", "name", F.col("key").alias("source"), F.col("lo").alias("low"), (F.col("lo") + F.col("width")).alias("hi"))
    needs = rows.join(whole, ["a", "name"]).select("key", "source", F.col("low").alias("lo"), "hi")
    single = cuts.where("text IS NULL").select("key", "lo", "a", "window", "n")
    met = single.groupBy("a", "window").agg(F.sum("n").alias("all"), F.min("n").alias("least"), F.min(F.struct("key", "lo")).alias("at"))
    met = staged(met.where("all > 1 AND least = 1").select("a", "window", F.col("at.key").alias("source"), F.col("at.lo").alias("low")), "met")
    more = single.where("n = 1").join(met, ["a", "window"]).select("key", "source", F.col("low").alias("lo"), F.col("low").alias("hi"))
    return cuts.where("text IS NOT NULL").select("key", "lo", "text"), staged(needs.unionByName(more).distinct(), "needs")


def _passages(cuts: DataFrame, needs: DataFrame, blocks: int) -> DataFrame:
    """(block, text): the passages that the documents of a block need, cut to what they need of them."""
    n = needs.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.col("source").alias("key"), "lo", "hi").distinct()
    n = n.groupBy("key", "block").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    texts = cuts.groupBy("key").agg(F.collect_list(F.struct("lo", "text")).alias("cuts"))

    def run(batches):
        for b in sliced(batches, 200):
            out = []
            for block, parts, cuts in zip(*[c.to_pylist() for c in b.columns]):
                cuts = sorted((c["lo"], _words(c["text"])) for c in cuts)
                i = 0
                for lo, hi in _stretches([(p["lo"], p["hi"]) for p in parts]):
                    while cuts[i][0] + len(cuts[i][1]) < hi + SPAN:
                        i += 1
                    begin, words = cuts[i]
                    out.append((block, _text(words[lo - begin : hi + SPAN - begin])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())], ["block", "text"])

    return n.join(texts, "key").select("block", "parts", "cuts").mapInArrow(run, "block int, text string")


class Phrases:
    """An automaton over the pieces of passages (texts of SPAN words or more), which finds the windows of passages in a text."""

    def __init__(self, passages):
        self.words: dict[bytes, int] = {}
        ids, begin = [0], []  # passages lie one after another, a 0 between them
        for text in passages:
            begin.append(len(ids))
            ids += [self.words.setdefault(w, len(self.words) + 1) for w in _words(text)]
            ids.append(0)
        self.ids, self.found = np.array(ids, np.int64), ahocorasick.Automaton()
        letters = self._letters(self.ids)
        for a, b in zip(begin, [*begin[1:], len(ids)]):
            for at in range(a, b - PIECE, PIECE):
                piece = letters[at : at + PIECE]
                if (places := self.found.get(piece, None)) is None:
                    self.found.add_word(piece, [at])
                else:
                    places.append(at)
        self.found.make_automaton()
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[self._pairs(self.ids)] = True

    @staticmethod
    def _pairs(ids: np.ndarray) -> np.ndarray:
        """Places of every two words in a row in the table."""
        own = ids.astype(np.uint64)
        return (mix(own[:-1] * _BASE + own[1:]) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)

    @staticmethod
    def _letters(ids: np.ndarray) -> str:
        code = np.where(ids > 0, (ids - 1) % _LETTERS + 1, 0)
        return (code + 0x800 * (code >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window of a passage.

        The automaton reads only stretches of PIECE words or more whose every two words in a row may stand in passages: at its
        root a step looks through all first letters. A hit is grown on its diagonal as far as text and passage agree; what
        lies in a stretch already grown is not looked at again."""
        edge = np.zeros(len(words) + 1, np.int64)
        if len(words) < SPAN or not len(self.found):
            return edge[:-1] > 0
        own = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        letters = np.maximum(own, 0)
        met = self.pairs[self._pairs(letters)] & (own[:-1] > 0) & (own[1:] > 0)
        ends = np.flatnonzero(np.diff(met, prepend=False, append=False)).reshape(-1, 2)
        ends = ends[ends[:, 1] - ends[:, 0] >= PIECE - 1]
        letters = self._letters(letters) if len(ends) else ""
        done: dict[int, int] = {}
        for last, places in chain.from_iterable(self.found.iter(letters, lo, hi + 1) for lo, hi in ends.tolist()):
            at = last + 1 - PIECE
            for place in places:
                if done.get(place - at, 0) > at:
                    continue
                after = _agree(own[at:], self.ids[place:])
                before = _agree(own[:at][::-1], self.ids[:place][::-1])
                done[place - at] = at + max(after, 1)
                if after >= PIECE and before + after >= SPAN:  # letters of a large vocabulary may coincide
                    edge[at - before] += 1
                    edge[at + after] -= 1
        return np.cumsum(edge[:-1]) > 0


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements are alike."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 4 * step
    return n


_NONE = np.empty(0, bool)


def _stripped(batch: pa.RecordBatch, phrases: Phrases | None) -> pa.RecordBatch:
    size, gone, kept = [], [], []
    for text in batch.column(batch.schema.get_field_index("row")).field("text").to_pylist():
        words = _words(text)
        drop = phrases.covered(words) if phrases else _NONE
        size.append(len(words))
        gone.append(int(drop.sum()))
        kept.append(_text(words if not gone[-1] else list(compress(words, ~drop))))
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(row, n_words, n_removed, kept) of every row of docs, which come through as a struct, so that no name can clash.

    kept are the words that no recurring window covers, joined by one space. Null, empty and blank texts have no words;
    texts shorter than a window keep theirs. Rows that repeat a text cover each other, whatever their doc_id. An empty
    table gives no rows. Which documents an automaton sees is a matter of their key alone, and what one block's documents
    need of passages is no more than what they hold, so neither a passage that all documents share nor a long document
    makes one block large beyond itself.
    """
    every = packed(docs, key=_key())
    texts = docs.select(_key().alias("key"), "text").where("text IS NOT NULL")
    cuts, needs = recurring(texts)
    blocks = max(1, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    marked = _with_keys(every, needs.select("key"))
    out = f"row {every.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string"

    def plain(batches):
        for b in sliced(batches):
            yield _stripped(b, None)

    def locate(batches):
        block, passages, phrases = None, [], None
        for b in sliced(batches):
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.diff(at * 2 + kind, prepend=-1))
            for i, j in zip(edge, [*edge[1:], b.num_rows]):
                if at[i] != block:
                    block, passages, phrases = at[i], [], None
                if kind[i] == 0:
                    passages += b.column(2).slice(i, j - i).to_pylist()
                else:
                    if phrases is None:
                        phrases, passages = Phrases(passages), []
                    yield _stripped(b.slice(i, j - i), phrases)

    kind = every.schema["row"].dataType
    first = _passages(cuts, needs, blocks).select("block", F.lit(0).alias("kind"), "text", F.lit(None).cast(kind).alias("row"))
    then = marked.where("maybe").select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "row")
    tasks = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = first.unionByName(then).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    return marked.where("NOT maybe").select("row").mapInArrow(plain, out).unionByName(dealt.mapInArrow(locate, out))


def op12_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; odd rows as in `without_repeats`."""
    got = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
