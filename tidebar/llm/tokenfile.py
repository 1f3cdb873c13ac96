"""Token ids as seekable zstandard files (operator 7).

One file holds the documents of one range of doc_id: an independent zstandard frame per document (its ids as
little-endian unsigned 32-bit integers), a skippable frame with the documents' ids, and the trailing seek table of
the public zstandard seekable format (compressed size, plain size and XXH64 checksum of every frame). A reader finds
a document by its place in the tables and decompresses that frame alone.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, sliced, table

# Fixed values of the zstandard seekable format.
SKIP_IDS, SKIP_SEEK, SEEK_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1


# What the tokenizer file for which words are encoded apart says of its normalizer and pre-tokenizer.
FAST = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Longer words are not kept, so that the caches' entries bound their bytes.
LONG = 64
#: Latin-1 letters, marks and digits with tab, newline and space: texts of these alone are encoded word by word.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
#: Of the byte-level alphabet, the bytes from 128 that do not stand for themselves (the first of them follow 33 below 128).
BYTE_LEVEL = {b: 256 + 34 + i for i, b in enumerate([*range(0x80, 0xA1), 0xAD])} | {127: 256 + 33}


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False); file is a tokenizer file's text.

    Where the file says what FAST says, words between white space encode independently, so each distinct word is encoded
    by the library's model once and kept in a bounded cache; texts with any character for which that is not certain go to
    the library whole, and so do all texts under any other file.
    """

    def __init__(self, file: str, keep: int = 800_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_str(file), keep
        self.model = self.tok.model
        said = json.loads(self.tok.to_str())
        marks = [t["content"] for t in said["added_tokens"]]
        model = said["model"]
        self.fast = (
            (said["normalizer"], said["pre_tokenizer"], said["post_processor"]) == (FAST["normalizer"], FAST["pre_tokenizer"], None)
            and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"]
            and all(m.isascii() and m.strip() and not any(c.isspace() for c in m) for m in marks)
        )
        self.marks = [m.lower() for m in marks]
        self.split = regex.compile(FAST["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> str | None:
        """The text in lower case if it holds PLAIN characters alone and none of the file's added tokens, in any case."""
        try:
            if text.encode("latin-1").translate(None, PLAIN):
                return None
        except UnicodeEncodeError:
            return None
        low = text.lower()  # letter by letter for these, as the normalizer does
        return None if any(m in low for m in self.marks) else low

    def part(self, part: str) -> bytes:
        """Ids of a part of a word by the model itself, which takes UTF-8 bytes in the byte-level alphabet."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(BYTE_LEVEL)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        if word.isalpha():  # one part
            out = self.part(word)
        else:
            out = b""
            for part in self.split.findall(word):
                ids = self.words.get(part)
                if ids is None:
                    ids = self.part(part)
                    if len(part) <= LONG and part.isalpha():  # as a word it has these ids too
                        self._keep(part, ids)
                out += ids
        if len(word) <= LONG:
            self._keep(word, out)
        return out

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self.words) >= self.keep:
            self.words.clear()
        self.words[word] = ids

    def encode(self, text: str) -> bytes:
        if not self.fast or (low := self.plain(text)) is None:
            return self.whole(text)
        get, word = self.words.get, self.word
        return b"".join([v if (v := get(w)) is not None else word(w) for w in low.split()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder a worker and file."""
    name = hashlib.sha256(file.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(file)
    return _ENCODERS[name]


class Writer:
    def __init__(self, out, level: int = 3):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.ids: list[tuple[int, bool]] = []
        self.seek: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.ids.append((doc_id or 0, doc_id is None))
        self.seek.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def close(self) -> None:
        ids = b"".join(struct.pack("<q?", *x) for x in self.ids)
        self.out.write(struct.pack("<II", SKIP_IDS, len(ids) + 4) + ids + struct.pack("<I", len(self.ids)))
        self.out.write(struct.pack("<II", SKIP_SEEK, 12 * len(self.seek) + 9) + b"".join(self.seek))
        self.out.write(struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC))
        self.out.close()


class Reader:
    """Random access to a file: the tables at its end first, then only the frames asked for."""

    def __init__(self, file, size: int):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.packed, self.plain, self.sums = table.astype(np.int64).T
        self.begin = np.concatenate([[0], np.cumsum(self.packed)])
        raw = self._at(int(self.begin[-1]) + 8, 9 * n)
        self.doc_ids = [None if gone else i for i, gone in struct.iter_unpack("<q?", raw)]

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        raw = self.unzip.decompress(self._at(int(self.begin[i]), int(self.packed[i])), max_output_size=int(self.plain[i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i] or len(raw) != self.plain[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return raw

    def documents(self, wanted: set | None = None):
        for i, doc_id in enumerate(self.doc_ids):
            if wanted is None or doc_id in wanted:
                yield doc_id, np.frombuffer(self.frame(i), "<u4")


def open_file(uri: str) -> Reader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path), fs.get_file_info(path).size)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encodes text, appends end_id and writes the files, in ascending doc_id order (null first, then ties by text hash).

    One file per range partition, named by the attempt that wrote it; only files in the returned manifest (file_no,
    path, n_docs, n_tokens) count, so retried or speculative tasks leave no double documents. Null text is empty:
    its document holds end_id alone. An empty table gives an empty manifest. Other columns are not read.
    """
    last = np.array([end_id], "<u4").tobytes()
    with open(tokenizer, encoding="utf-8") as f:  # read here: a path of the driver is none of the executors'
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches):
        enc, w, tokens, no = None, None, 0, TaskContext.get().partitionId()
        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w is None:
                    enc = encoder(file.value)
                    uri = f"{folder}/{no:06d}-{uuid.uuid4().hex}.ids.zst"
                    fs, path = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    w = Writer(io.BufferedWriter(_Raw(fs.open_output_stream(path, compression=None)), 1 << 20))
                ids = enc.encode(text or "") + last
                w.add(doc_id, ids)
                tokens += len(ids) // 4
        if w:
            w.close()
            yield pa.RecordBatch.from_pydict({"file_no": [no], "path": [uri], "n_docs": [len(w.ids)], "n_tokens": [tokens]})

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
    )
    return checkpointed(ordered.select("doc_id", "text").mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long"))


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, b):
        self.stream.write(bytes(b))
        return len(b)

    def close(self):
        if not self.closed:
            self.stream.close()
        super().close()


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest; start counts the ids of all documents before.

    wanted: doc_ids to read; other frames are not decompressed. The running sum over the manifest has a row per file.
    """
    pick = None if wanted is None else set(wanted)

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = open_file(path)
                starts = base + np.concatenate([[0], np.cumsum(r.plain // 4)])
                found = ((d, int(starts[i]), int(r.plain[i] // 4), zlib.crc32(r.frame(i))) for i, d in enumerate(r.doc_ids) if pick is None or d in pick)
                while got := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                r.file.close()

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, so that tiny rows are not coalesced
    return manifest.select("path", before.alias("base")).repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_frames(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; odd rows as in `write_tokens`."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return read_tokens(write_tokens(docs, shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))
