import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from tidebar.llm import tiff, tokenfile, warc
from tidebar.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
TOK = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello  World's don't\n\n12 x's ßÄé", "naïvé ﬁ Ⅻ", "a\x1cb\x85c\xa0d", "<|endoftext|> <|x", "😀 ΑΣ ΣΑΣ", "é" * 3000, "I'LL we've'd ª²µ¿¡", "-- ... !!!a1b2c3"]


def test_cached_encoding_is_the_librarys():
    e, t = tokenfile.Encoder(open(TOK).read()), Tokenizer.from_file(TOK)
    for text in TEXTS * 2:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    t = Tokenizer.from_file(TOK)
    rows = [(i * 7 % 10, x) for i, x in enumerate(TEXTS)] + [(3, None), (None, "null id"), (3, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", __import__("pyspark").sql.functions.lit(1))
    manifest = tokenfile.write_tokens(d, shared_dir(spark, "t"), TOK)
    got = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in tokenfile.read_tokens(manifest).collect())
    ids = {}
    for i, x in rows:
        a = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(i, []).append((len(a), zlib.crc32(a.tobytes())))
    assert [g[1] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for start, i, n, crc in got:
        assert start == at and (n, crc) in ids[i]
        at += n
    some = tokenfile.read_tokens(manifest, [3]).collect()
    assert len(some) == sum(i == 3 for i, _ in rows) and {r.start for r in some} <= {g[0] for g in got}
    assert tokenfile.read_tokens(tokenfile.write_tokens(d.limit(0), shared_dir(spark, "t"), TOK)).count() == 0


def test_damage_is_found(spark):
    d = spark.createDataFrame([(1, "some words here " * 50)], "doc_id long, text string")
    path = tokenfile.write_tokens(d, shared_dir(spark, "t"), TOK).collect()[0].path
    fs, p = pafs.FileSystem.from_uri(path)
    raw = bytearray(fs.open_input_file(p).read())
    raw[-10] ^= 1
    import io

    with pytest.raises(Exception):
        tokenfile.Reader(io.BytesIO(raw), len(raw)).frame(0)


def test_warc_equals_sql_and_edges(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet' union all select page_id + 100000, url, html from '{SF}/pages.parquet' where page_id % 3 = 0")
    d = spark.read.parquet(f"{SF}/pages.parquet")
    d = d.union(d.where("page_id % 3 = 0").selectExpr("page_id + 100000", "url", "html"))
    got = warc.resolved_records(warc.read_warc(warc.write_warc(warc.resolve(d), shared_dir(spark, "w"))))
    want = c.execute(warc.ORACLE).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[3] == "revisit" for r in want)
    odd = spark.createDataFrame([(1, None, None), (2, "u\r\nX: y", ""), (None, "u", "x" * 2000), (5, "u", "x" * 2000), (5, "u", "x" * 2000), (4, "v", "é" * 999)], "page_id long, url string, html string")
    rows = sorted(warc.resolved_records(warc.read_warc(warc.write_warc(warc.resolve(odd), shared_dir(spark, "w")))).collect(), key=str)
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows if r.page_id is None] == [(None, "revisit", 5, 2000)]
    assert sum(r.record_type == "response" for r in rows) == 5 and len(rows) == 6
    assert warc.read_warc(warc.write_warc(warc.resolve(odd.limit(0)), shared_dir(spark, "w"))).count() == 0


@pytest.mark.parametrize("how", [tiff.NONE, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(how, predictor):
    rng = np.random.default_rng(1)
    imgs = [rng.integers(0, 256, (h, w), np.uint8) // (1 + 63 * (h % 2)) for h, w in ((1, 64), (300, 64), (7, 5))]
    back = [p[:, :, 0] for _, p in tiff.pages(tiff.write(imgs, 16, how, predictor))]
    assert len(back) == 3 and all((a == b).all() for a, b in zip(imgs, back))


def lzw(data):
    """A plain encoder, for the test: codes packed most significant bit first, width growing one code early."""
    bits, table, word, width = [], {bytes([i]): i for i in range(256)}, b"", 9
    put = lambda c: bits.append(format(c, f"0{width}b"))
    put(256)
    for b in data:
        nxt = word + bytes([b])
        if nxt in table:
            word = nxt
            continue
        put(table[word])
        table[nxt] = len(table) + 2
        n = len(table) + 2  # one entry ahead of what a reader has, whose width grows at 511, 1023 and 2047
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        word = bytes([b])
        if n >= 4094:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
    if word:
        put(table[word])
    n = len(table) + 2
    width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
    put(257)
    s = "".join(bits)
    s += "0" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big")


def test_lzw_and_tiles():
    rng = np.random.default_rng(2)
    for size in (1, 255, 300, 1500, 20000):
        data = bytes(rng.integers(97, 102, size, np.uint8))
        assert tiff.unlzw(lzw(data), size) == data and tiff.lzw(data) == lzw(data)
    wide = bytes(rng.integers(0, 256, 30000, np.uint8))
    assert tiff.unlzw(tiff.lzw(wide), 30000) == wide and tiff.unlzw(tiff.lzw(b""), 10) == b""
    img = rng.integers(0, 256, (20, 24), np.uint8)
    blocks = [np.pad(img[y : y + 16, x : x + 16], ((0, max(0, y - 4)), (0, max(0, x - 8)))) for y in (0, 16) for x in (0, 16)]
    raw = [lzw(b.tobytes()) for b in blocks]
    out = bytearray(b"MM\0*" + bytes(4))
    offs = []
    for r in raw:
        offs.append(len(out))
        out += r
    lists = len(out)
    out += struct.pack(">4I", *offs) + struct.pack(">4I", *map(len, raw))
    struct.pack_into(">I", out, 4, len(out))
    tags = [(256, 4, 1, 24), (257, 4, 1, 20), (258, 3, 1, 8 << 16), (259, 3, 1, 5 << 16), (277, 3, 1, 1 << 16), (322, 4, 1, 16), (323, 4, 1, 16), (324, 4, 4, lists), (325, 4, 4, lists + 16)]
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + bytes(4)
    ((_, back),) = tiff.pages(bytes(out))
    assert (back[:, :, 0] == img).all()


def test_tiff_query_and_edges(spark):
    got = tiff.op9_tiff_pages(spark, SF).toPandas()
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    for r in got.itertuples():
        n, payload, _ = tiff.store_text(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) > 0
    _, _, long = tiff.store_text("x" * 200_000)
    d = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0" + bytes(40)), (4, bytearray(long)), (4, bytearray(long)), (5, bytearray(long[:-30]))], "doc_id long, media binary")
    rows = tiff.decode_pages(d).collect()
    assert sum(r.doc_id == 4 for r in rows) == 8 and {r.page for r in rows if r.doc_id == 4} == {0, 1, 2, 3}
    assert any(r.error for r in rows if r.doc_id == 2) and any(r.error for r in rows if r.doc_id == 5)
    assert tiff.decode_pages(d.limit(0)).count() == 0


def test_every_layout_round_trips():
    rng = np.random.default_rng(3)
    for h, w in ((1, 64), (16, 64), (100, 64), (33, 17)):
        imgs = [rng.integers(0, 256, (h, w), np.uint8) // d for d in (1, 90)]
        for layout in set(tiff.LAYOUTS):
            back = [p[:, :, 0] for _, p in tiff.pages(tiff.write(imgs, layouts=[layout] * 2))]
            assert all((a == b).all() for a, b in zip(imgs, back)), (layout, h, w)


def test_hostile_files_are_error_rows(spark):
    def of(w, h, bits=8, how=1, extra=()):
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, how), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, max(h, 1)), (279, 4, 1, 4), *extra]
        return b"II*\0" + struct.pack("<I", 12) + b"abcd" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)

    files = [of(0, 2), of(2, 0), of(2**31, 2**31), of(70000, 70000, how=8), of(2, 2, how=9), of(2, 2, how=5), of(2, 2, extra=[(322, 4, 1, 0), (323, 4, 1, 0), (324, 4, 1, 8), (325, 4, 1, 4)]), b"II*\0" + bytes(4), b"II*\0\x08\0\0\0\xff\xff", b"MM\0*" + b"\xff" * 20, b""]
    d = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate([*files, of(2, 2)])], "doc_id long, media binary").selectExpr("*", "1 AS page", "'x' AS error")
    rows = {r.doc_id: r for r in tiff.decode_pages(d).collect()}
    assert len(rows) == len(files) + 1 and all(rows[i].error and rows[i].pixels is None for i in range(len(files)))
    assert bytes(rows[len(files)].pixels) == b"abcd" and rows[len(files)].error is None


def test_tokenizer_files_of_another_kind_are_encoded_whole(tmp_path):
    import json

    said = json.load(open(TOK))
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^ ]+ ?"
    (tmp_path / "other.json").write_text(json.dumps(said))
    other = tokenfile.Encoder((tmp_path / "other.json").read_text())
    text = "Some words, it's 2 of them <|ENDOFTEXT|> é"
    assert not other.fast and tokenfile.Encoder(open(TOK).read()).fast
    for e in (other, tokenfile.Encoder(open(TOK).read())):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids


def test_tiff_bounds_of_a_file_and_unknown_predictors(spark):
    """Directories that share one strip decode to no more than the file can stand for; predictor 3 is an error row."""
    img = np.zeros((3000, 3000), np.uint8)
    one = tiff.write([img], rows_per_strip=3000, predictor=1)
    (at,) = struct.unpack_from("<I", one, 4)
    folder = one[at:-4]
    many = bytearray(one[:-4])
    for _ in range(40):  # further directories over the same strip
        many += struct.pack("<I", len(many) + 4) + folder
    many += bytes(4)
    float_ = bytearray(one)
    place = float_.index(struct.pack("<HHI", tiff.PREDICTOR, 3, 1))
    struct.pack_into("<I", float_, place + 8, 3)
    d = spark.createDataFrame([(1, bytes(many)), (2, bytes(float_)), (3, one)], "doc_id long, media binary")
    got = tiff.decode_pages(d).select("doc_id", "page", "width", "error").collect()
    own = [r for r in got if r.doc_id == 1]
    assert own[-1].error and all(r.width == 3000 for r in own[:-1]) and 1 <= len(own) - 1 <= tiff.RATIO * (len(many) + 64) // img.nbytes < 40
    assert [(r.page, r.error) for r in got if r.doc_id == 2] == [(0, "predictor 3")]
    assert [(r.page, r.width, r.error) for r in got if r.doc_id == 3] == [(0, 3000, None)]


def test_tokenizer_goes_along_with_the_task(spark, tmp_path):
    """The file is read where the job is planned; tasks get its text and need no path."""
    path = tmp_path / "words.json"
    path.write_text(open(TOK).read())
    d = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    ordered = tokenfile.write_tokens(d, shared_dir(spark, "t"), str(path))
    want = Tokenizer.from_file(TOK).encode("some words", add_special_tokens=False).ids
    path.unlink()
    assert sorted((r.doc_id, r.n_tokens) for r in tokenfile.read_tokens(ordered).collect()) == [(1, len(want) + 1), (2, 1)]


def test_latin_words_are_encoded_without_the_whole_pipeline(monkeypatch):
    e, t = tokenfile.Encoder(open(TOK).read()), Tokenizer.from_file(TOK)
    latin = "".join(chr(c) for c in range(0xA1, 0x100))
    texts = ["Größe ÀÉÎ naïve straße", "l'été d'où", "a\xadb ¿Qué? 3½ µ ª º", " ".join(latin), latin, "x" * 70 + "é" * 70, "Été été ÉTÉ"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]

    def whole(text):
        raise AssertionError(f"{text!r} went through the whole pipeline")

    monkeypatch.setattr(e, "whole", whole)
    for _ in range(2):  # from the model, then from what is kept
        assert [np.frombuffer(e.encode(x), "<u4").tolist() for x in texts] == want
