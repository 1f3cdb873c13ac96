import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

import corpus_pipeline
from tidebar.llm import tokencount

SF = "/root/testdata/sf0.001"


def library(vocabulary):
    return models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0)


def test_counts_are_the_librarys(spark):
    voc = tokencount.unigrams(public_tokenizers.path("piece_bpe_32k.model"))
    low = min(s for _, s in voc)
    lib = models.Unigram([("<unk>", low), *voc], unk_id=0)
    own = tokencount.Counter1(voc)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in docs[:60]:
        for w in set((r.text or "").split()[:300]) | {"日本語x😀", "zzzzqqqq"}:
            assert own.word("▁" + w)[0] == len(lib.tokenize("▁" + w)), w


def test_ties(spark):
    voc = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("aa", -2.0), ("aaa", -3.0)]
    lib, own = models.Unigram([("<unk>", -3.0), *voc], unk_id=0), tokencount.Counter1(voc)
    for w in ("▁a", "▁ab", "▁aab", "▁aaaa", "▁aaaabab", "▁xa", "▁axxa", "▁xxb"):
        assert own.word(w)[0] == len(lib.tokenize(w)), w


def test_count_edges(spark):
    voc = [("▁", -1.0), ("a", -1.0), ("▁a", -1.5)]
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a  a\n"), (3, "a  a\n"), (4, "a" * 100_000), (None, "b")], "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(d, voc).collect()}
    assert (got[1], got[2], got[3], got[4], got[None]) == (0, 0, 2, 100_000, 2)
    assert tokencount.count_tokens(d.limit(0), voc).count() == 0
    assert {r.n_tokens for r in tokencount.count_tokens(d, []).where("doc_id = 3").collect()} == {2}


def test_pipeline_stages(spark):
    from .test_joins import brute, brute_leaks

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).selectExpr("doc_id + 900000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).cache()
    f = dict(corpus_pipeline.STAGES)
    assert list(f) == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    one = f["language"](spark, docs, SF).cache()
    assert one.columns == docs.columns and one.where("doc_id >= 900000").count() == 0
    assert {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()} == {r.doc_id for r in one.collect()}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = f["near_duplicates"](spark, one, SF).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)}) and two.columns == docs.columns
    three = f["decontamination"](spark, two, SF).cache()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not any(brute_leaks(r.text, i.text) for i in items)}
    assert three.count() < two.count()
    four = f["mixing"](spark, three, SF).cache()
    times = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == docs.columns and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in three.collect()}
    five = f["tokens"](spark, four, SF).collect()
    assert len(five) == four.count()
    at = 0
    for r in sorted(five, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for x in (docs, one, two, three, four):
        x.unpersist()


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, stage):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[stage][1](spark, empty, SF).count() == 0


def test_count_and_token_queries_against_the_library(spark):
    """Both queries, every row, against the libraries run text by text."""
    import zlib

    import numpy as np

    from tidebar.llm import tokenfile

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    vocabulary = tokencount.unigrams(public_tokenizers.path("piece_bpe_32k.model"))
    lib = library(vocabulary)
    got = {r.doc_id: r.n_tokens for r in tokencount.op5_viterbi_counts(spark, SF).collect()}
    assert got == {r.doc_id: sum(len(lib.tokenize(tokencount.SPACE + w)) for w in (r.text or "").split()) for r in docs}
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    rows = {r.doc_id: r for r in tokenfile.op7_token_frames(spark, SF).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, stage):
    """Columns named like the stages' own, repeated rows, nulls and a very long text: all columns come back as they were."""
    names = ["key", "_key", "row", "score", "lang_pred", "lang_mix", "sid", "times", "n", "more", "at", "h", "_total", "size", "a.b"]
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(9)), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(30)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (50, "", "en", "s1", 0), (51, "word " * 60_000, "en", "s0", 0)]
    docs = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    got = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert got.columns == docs.columns
    out = got.collect()
    assert out and all(list(r)[5:] == [7] * len(names) for r in out)
    assert {r.doc_id for r in out} <= {r[0] for r in rows}
