import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidebar.llm import language, mixing

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = language.op10_language_mixture(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    out = got[got.held_out].join(docs[["lang", "text"]])
    assert {i for i in docs.index if zlib.crc32(str(i).encode()) % 3 == 1} == set(out.index)
    named = out[out.lang_pred != "und"]
    assert (named.lang_pred == named.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_mixtures_and_edges(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, logp = language.train(docs)
    by = {r.lang: r.text for r in docs.where("length(text) between 1500 and 3000").collect()}
    a, b = names[0], names[1]
    both = by[a][:1200] + "\n" + by[b][:1200]
    rows = [(1, both), (2, None), (3, ""), (4, "123 !!"), (5, "x"), (5, "x"), (6, by[a] * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in language.identify(d, names, logp).collect()}
    assert {p.split(":")[0] for p in got[1].lang_mix.split(",")} == {a, b} and 0.3 < got[1].score < 0.7
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred in names and got[6].lang_pred == a
    assert language.identify(d, [], logp[:0]).where("lang_pred <> 'und'").count() == 0
    assert language.train(docs.limit(0))[0] == []


def test_texts_in_no_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, logp = language.train(docs)
    junk = ["dwtgm lqucav ltalsf yxaaoyj fkaflm ggflhav oqezwd iss zxqvjk", "Orz+tviEstwvjPOqWtlOP72AqUDxXBzH1XJ9EGOFnK4AdaD2W5", "日本語の文章です。" * 3]
    d = spark.createDataFrame(list(enumerate([*junk, "x", "The", "A."])), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(d, names, logp, reject=True).collect()}
    assert [got[i] for i in range(3)] == ["und"] * 3 and all(got[i] in names for i in range(3, 6))
    assert language.identify(docs.where("lang IS NOT NULL AND text RLIKE '[A-Za-z]'"), names, logp).where("lang_pred = 'und'").count() == 0


def test_pipeline_keeps_documents_where_no_language_is_learned(spark, docs_of):
    docs = docs_of([(1, "a few words", None, "s", 0), (2, "12", None, "s", 0)])
    assert corpus_pipeline.known_language(spark, docs, SF).count() == 2


def test_rare_languages_are_learned(spark, docs_of):
    docs = docs_of([(i, "the cat sat", "en", "s", 0) for i in range(2000)] + [(5000 + i, "el gato duerme", "es", "s", 0) for i in range(3)])
    names, logp = language.train(docs, 50)
    assert names == ["en", "es"]
    grams = 0.5 * np.exp(-logp.min(axis=1)) - 0.5 * language.BINS
    learned = grams / [language.ngram_counts(t).sum() for t in ("the cat sat", "el gato duerme")]
    assert 20 < learned[0] < 100 and learned[1] == pytest.approx(3)


def fill(sizes, weights, cap):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(cap * s for i, s in enumerate(sizes) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > cap * sizes[i]}
        for i in range(len(sizes)):
            target[i] = left * weights[i] / w if i in open_ else cap * sizes[i]
        if not over:
            break
        open_ -= over
    return [cap * s if i not in open_ else target[i] for i, s in enumerate(sizes)]


@pytest.mark.parametrize("sizes", [[10, 1000, 5, 0, 300], [7], [0, 0], [100] * 7, [1, 1, 1, 10**6]])
def test_water_filling(spark, sizes):
    d = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.water_fill(d).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3), abs=1e-6)
    assert sum(got) == pytest.approx(sum(sizes))


def test_mix(spark, docs_of):
    got = mixing.op2_source_mix(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.doc_id) == sorted(docs.index)
    sizes = docs.text.map(lambda t: len((t or "").encode().split()))
    assert (got.set_index("doc_id")["size"].sort_index() == sizes.sort_index()).all()
    by = docs.assign(size=sizes).groupby("source")["size"].sum()
    names = sorted(by.index)
    want = dict(zip(names, fill([int(by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    got = got.join(docs.source, on="doc_id")
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == by[s]
        assert abs(g.taken.sum() - want[s]) <= max(0.01 * want[s], left_over(zip(g["size"], g.times)))
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.op2_source_mix(spark, SF).toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(got.doc_id, got.taken))
    odd = docs_of([(1, None, None, None, 0), (2, "a b", "en", None, 3), (2, "a b", "en", None, 3), (3, "", "x", "s", 0), (4, "w " * 9, "x", "é", 0)])
    rows = mixing.mix_plan(mixing.sized(odd)).collect()
    assert len(rows) == 5 and all(r.times * r.size <= 3 * r.size for r in rows)
    assert mixing.mix_plan(mixing.sized(odd.limit(0))).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def left_over(rows):
    """What the mix may miss: half of the smallest row that it takes no more often than it must."""
    rows = [(size, times) for size, times in rows if size]
    return min((size for size, times in rows if times == min(t for _, t in rows)), default=0) / 2 + 1e-6


def near_targets(rows, cap=3):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.times <= cap
    return {k: (sum(r.times * r.size for r in v), v[0].target) for k, v in by.items()}


def test_mix_meets_targets_with_repeats_long_rows_and_few_rows(spark, docs_of):
    ten = "w " * 10
    cases = {
        "repeats": [(i % 2, ten, None, "ab"[i % 2], 0) for i in range(80)],
        "one hot row": [(1, ten, None, "a", 0)] * 60 + [(i, "v " * 7, None, "b", 0) for i in range(2, 40)],
        "a long row, empty rows": [(i, "w " * (2000 if i == 5 else i % 20), None, "ab"[i % 2], 0) for i in range(200)] + [(900, None, None, "a", 0)],
    }
    for name, rows in cases.items():
        d = docs_of(rows)
        plan = mixing.mix_plan(mixing.sized(d)).collect()
        assert len(plan) == len(rows), name
        for source, (taken, target) in near_targets(plan).items():
            assert abs(taken - target) <= left_over((r.size, r.times) for r in plan if r.source == source), (name, source, taken, target)
        # The mixed rows are those of the plan, row by row.
        want = sorted((str(r.doc_id), r.source) for r in plan for _ in range(r.times))
        assert sorted((str(r.doc_id), r.source) for r in mixing.mixed(d).collect()) == want, name


def test_mix_comes_near_where_one_row_is_most_of_a_source(spark, docs_of):
    """A seeded order that fills up with short rows passes the long one over; it must be taken first then."""
    short = [100 + 7 * i for i in range(20)]
    a = [(i, "w " * n, None, "a", 0) for i, n in enumerate([*short, 5670])]
    b = [(100 + i, "w " * 10, None, "b", 0) for i in range(1200)]
    tail = [(5000 + i, "w " * max(1, int(20 * 2.718 ** (1.5 * math.sin(i * 12.9898) * 2))), None, "c", 0) for i in range(40)]
    for seed in range(2):
        rows = mixing.mix_plan(mixing.sized(docs_of(a + b + tail)), seed=seed).collect()
        sizes = {r.source: r.source_size for r in rows}
        for source, (taken, target) in near_targets(rows).items():
            assert abs(taken - target) <= 0.02 * sizes[source], (seed, source, taken, target)
        again = mixing.mix_plan(mixing.sized(docs_of(a + b + tail).repartition(3)), seed=seed).collect()
        assert sorted((r.doc_id, r.times) for r in again) == sorted((r.doc_id, r.times) for r in rows)


def test_languages_are_bounded(spark, docs_of, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    d = docs_of([(i, f"text number {i}", f"l{i % 9 if i % 2 else i % 2}", "s", 0) for i in range(90)])
    names, logp = language.train(d)
    assert len(names) == 3 and "l0" in names and logp.shape == (3, language.BINS)


def test_a_source_of_one_long_row_is_taken_when_that_is_nearer(spark, docs_of):
    d = docs_of([(1, "w " * 900, None, "b", 0), (2, "w " * 1340, None, "a", 0)])
    got = {r.source: (r.times, r.target) for r in mixing.mix_plan(mixing.sized(d)).collect()}
    assert got["b"] == (1, pytest.approx(640)) and got["a"] == (1, pytest.approx(1600))


def test_letters_are_unicode_letters(spark, docs_of):
    rows = [(i, f"the word number {i} is here and there", "en", "s", 0) for i in range(40)] + [(i, f"das wort nummer {i} ist hier und dort", "de", "s", 0) for i in range(40, 80)]
    names, logp = language.train(docs_of(rows))
    odd = docs_of([(1, "\u00b2 \u00bd \u2460 123 _", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (4, "\u00e9", None, None, 0), (5, "q", None, None, 0)])
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, names, logp).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and {got[4], got[5]} <= {"de", "en"}


def test_em_finds_the_likelihood_maximum():
    rng = np.random.default_rng(4)
    p, c = rng.random((40, 2)), rng.integers(1, 9, 40).astype(float)
    w, value = language._em(p, c, np.array([0.5, 0.5]))
    grid = max(float(c @ np.log(p @ np.array([x, 1 - x]))) for x in np.linspace(1e-6, 1 - 1e-6, 20001))
    assert value == pytest.approx(grid, abs=1e-2) and w.sum() == pytest.approx(1)


def test_a_turn_of_mixing_hands_on_no_plan(spark):
    """Joins by source on what a turn left: the next turn reads files, so that nothing inferred of earlier turns grows."""
    rooms = spark.createDataFrame([("a", 9.0), (None, 5.0)], "source string, room double")
    taken = spark.createDataFrame([("a", 1, 2), (None, 1, 1)], "source string, size int, take long")
    for _ in range(3):
        rooms = mixing._left(rooms, taken)
        assert rooms.inputFiles()
    assert {r.source: r.room for r in rooms.collect()} == {"a": 3.0, None: 2.0}
