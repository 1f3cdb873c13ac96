"""Media columns: TIFF images, one row per page (operator 9)."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

# TIFF 6.0 tags and compression numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
#: Bytes that one image may decode to, and how many a stored byte may stand for, in a page and in all pages of a file
#: together: beyond, a page is an error, not memory.
MOST, RATIO = 1 << 28, 1400


class BadTiff(ValueError):
    pass


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128 and i + 1 < len(data):
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends; the width grows one code early."""
    words = [bytes([i]) for i in range(256)] + [b"", b""]
    out, have, bits, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        have, bits = have << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, have = have >> bits, have & ((1 << bits) - 1)
        if code > len(words) or code == len(words) and not last:
            raise BadTiff(f"LZW code {code} beyond the table")
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if not last:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out += word
        last = word
        n = len(words) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out)


def decode(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == PACKBITS:
        return unpackbits(data, size)[:size]
    if how == LZW:
        return unlzw(data, size)[:size]
    raise BadTiff(f"compression {how}")


def pages(data: bytes):
    """(page, array of rows x columns x samples, 8-bit or 16-bit) for each image directory, followed by its offsets."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise BadTiff("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen: set[int] = set()
    room = RATIO * (len(data) + 64)
    if not at:
        raise BadTiff("no image directory")
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("the directories loop or leave the file")
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            if kind in _TYPES:
                fmt = f"{e}{count}{_TYPES[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(fmt) > 4:
                    (place,) = struct.unpack_from(e + "I", data, place)
                tags[tag] = struct.unpack_from(fmt, data, place)
        image = _image(data, tags, e, room)
        room -= image.nbytes
        yield len(seen) - 1, image
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def _image(data: bytes, tags: dict, e: str, room: int) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, s, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or one(284, 1) != 1:
        raise BadTiff(f"{bits} bits a sample or separate planes")
    if w < 1 or h < 1 or s < 1:
        raise BadTiff(f"an image of {w} x {h} x {s}")
    if one(PREDICTOR, 1) not in (1, 2):
        raise BadTiff(f"predictor {one(PREDICTOR, 1)}")
    kind = np.dtype(f"{e}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h) or 1)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    if bw < 1 or bh < 1 or w * h * s * kind.itemsize > min(MOST, RATIO * (sum(counts) + 64), room) or bw * bh * s * kind.itemsize > MOST:
        raise BadTiff(f"{w} x {h} x {s} samples in {sum(counts)} bytes")
    across = -(-w // bw)
    if len(offsets) < across * -(-h // bh) or len(counts) < len(offsets):
        raise BadTiff("blocks are missing")
    out = np.zeros((h, w, s), kind)
    for i, (place, size) in enumerate(zip(offsets[: across * -(-h // bh)], counts)):
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - y)
        raw = decode(data[place : place + size], one(COMPRESSION, NONE), rows * bw * s * kind.itemsize)
        if len(raw) != rows * bw * s * kind.itemsize:
            raise BadTiff(f"block {i} is short")
        block = np.frombuffer(raw, kind).reshape(rows, bw, s)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + rows, x : x + bw] = block[: h - y, : w - x]
    return out


def packbits(data: bytes) -> bytes:
    """Literal runs and repeats, for writing."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i
        while j + 1 < n and data[j + 1] == data[i] and j - i < 127:
            j += 1
        if j - i >= 2:
            out += bytes([257 - (j - i + 1), data[i]])
            i = j + 1
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes as unlzw reads them: a clear code first and whenever the table is full, an end code last."""
    out, have, bits, width, nxt = bytearray(), 256, 9, 9, 258
    table: dict[int, int] = {}
    word = -1
    for b in data:
        if word < 0:
            word = b
            continue
        key = word << 8 | b
        if (code := table.get(key)) is not None:
            word = code
            continue
        have, bits = have << width | word, bits + width
        table[key] = nxt
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        word = b
        if nxt >= 4094:
            have, bits = have << width | 256, bits + width
            table.clear()
            width, nxt = 9, 258
        if bits > 512:
            left = bits % 8
            out += (have >> left).to_bytes(bits // 8, "big")
            have, bits = have & ((1 << left) - 1), left
    if word >= 0:
        have, bits = have << width | word, bits + width
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
    have, bits = have << width | 257, bits + width
    return bytes(out + (have << -bits % 8).to_bytes(-(-bits // 8), "big"))


PACKERS = {NONE: bytes, DEFLATE: lambda raw: zlib.compress(raw, 1), PACKBITS: packbits, LZW: lzw}


def write(images: list[np.ndarray], rows_per_strip: int = 256, how: int = DEFLATE, predictor: int = 2, layouts: list[tuple] | None = None) -> bytes:
    """8-bit grey images as the pages of one little-endian TIFF: in strips, or as `layouts` has it, (compression, predictor,
    tile) for each page, whose tile is None for strips or the side of square tiles."""
    out, link = bytearray(b"II*\0" + bytes(4)), 4
    for page, img in enumerate(images):
        h, w = img.shape
        how, predictor, tile = layouts[page] if layouts else (how, predictor, None)
        offsets, counts = [], []
        if tile:
            blocks = [np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1]))) for y in range(0, h, tile) for x in range(0, w, tile) for b in [img[y : y + tile, x : x + tile]]]
        else:
            blocks = [img[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            raw = PACKERS[how](block.tobytes())
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        lists = []
        for values in (offsets, counts):
            lists.append(values[0] if len(values) == 1 else len(out) + len(out) % 2)
            if len(values) > 1:
                out += bytes(len(out) % 2) + struct.pack(f"<{len(values)}I", *values)
        out += bytes(len(out) % 2)
        entries = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, how), (PHOTOMETRIC, 3, 1, 1)]
        if tile:
            entries += [(SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor), (TILE_WIDTH, 4, 1, tile), (TILE_HEIGHT, 4, 1, tile), (TILE_OFFSETS, 4, len(offsets), lists[0]), (TILE_COUNTS, 4, len(counts), lists[1])]
        else:
            entries += [(OFFSETS, 4, len(offsets), lists[0]), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, rows_per_strip), (COUNTS, 4, len(counts), lists[1]), (PREDICTOR, 3, 1, predictor)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *x) for x in entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def decode_pages(media: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, samples, pixels, error): a row per page of the binary column `media`.

    Null media give no row; a file that cannot be read, or can be read in part, gives its good pages and then a row with
    error and no pixels; so does an image of no size, of an unknown predictor, of more than MOST bytes, or of more than its
    blocks, or with the pages before it all of the file, can hold. Pages go on one by one, so a task holds one at a time.
    Repeated rows repeat; other columns are not read; an empty table gives none."""

    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    names = ["doc_id", "page", "width", "height", "samples", "pixels", "error"]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def read(batches):
        for b in sliced(batches, 256):
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = -1
                try:
                    for page, img in pages(data) if data is not None else ():
                        yield row(doc_id, page, img.shape[1], img.shape[0], img.shape[2], img.tobytes(), None)
                except (BadTiff, struct.error, zlib.error, ArithmeticError, LookupError, MemoryError, ValueError) as x:
                    yield row(doc_id, page + 1, None, None, None, None, str(x)[:200])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(read, "doc_id long, page int, width int, height int, samples int, pixels binary, error string")


#: How pages are stored, by a number that follows from the text: every reader's path has its share of them.
LAYOUTS = [(LZW, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, 32), (PACKBITS, 2, 32), *[(DEFLATE, 2, None)] * 3, (NONE, 1, 16), *[(DEFLATE, 2, None)] * 7, (LZW, 2, 32)]


def store_text(text: str | None, page_rows: int = 1024) -> tuple[int, bytes, bytes]:
    """(UTF-8 bytes, padded payload, its TIFF of 64 samples a row and page_rows rows a page, each page by its LAYOUTS)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    images, first = [rows[i : i + page_rows] for i in range(0, len(rows), page_rows)], zlib.crc32(payload)
    return len(raw), payload, write(images, layouts=[LAYOUTS[(first + i) % len(LAYOUTS)] for i in range(len(images))])


def feature(samples: np.ndarray) -> str:
    """Mean, standard deviation, entropy in bits and distinct values of 8-bit samples."""
    n = np.bincount(samples, minlength=256)
    p = n[n > 0] / len(samples)
    mean = float(n @ np.arange(256)) / len(samples)
    return f"mean={mean:.3f};std={float((n @ (np.arange(256) - mean) ** 2) / len(samples)) ** 0.5:.3f};entropy={float(-(p * np.log2(p)).sum()):.3f};distinct={len(p)}"


def op9_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF in strips or tiles of any compression, read back page by page; the digest columns come
    from the pages' samples. Null text is empty; an empty text is 64 bytes 0; repeated rows repeat, equal texts give equal
    values; an empty table gives none; other columns are not read."""

    def run(batches):
        for b in sliced(batches):
            got = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, _, stored = store_text(text)
                back = b"".join(img.tobytes() for _, img in pages(stored))
                got.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(back, np.uint8))))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, schema)
