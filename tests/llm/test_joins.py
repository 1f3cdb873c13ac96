import os
import random
import time
from itertools import combinations

import numpy as np
import pytest

from tidebar.llm import decontaminate, jaccard
from tidebar.llm.common import text_shingles

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, t):
    """{doc_id: (size, component)} by comparing every pair; equal doc_ids are told apart by place."""
    sets = [shingles(x, k) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= t * max(len(sets[a]), len(sets[b])):
            common = len(sets[a] & sets[b])
            if 100 * common >= t * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def family():
    """Chains and clouds of edited copies at all sizes, with texts that share a passage only."""
    rng, rows = random.Random(5), []
    for size in (3, 4, 6, 9, 14, 25, 60, 150):
        base = words(rng, size)
        chain = list(base)
        for _ in range(7):
            rows.append(" ".join(chain))
            chain = list(chain)
            for _ in range(max(1, size // 40)):
                chain[rng.randrange(len(chain))] = "zz" + rng.choice("abcdef")
        rows += [" ".join(base[: max(1, int(size * f))]) for f in (1, 0.99, 0.95, 0.9, 0.86, 0.8)]
        rows += [" ".join(base).upper() + "\n"]
    shared = words(rng, 40)
    for _ in range(25):
        rows.append(" ".join(words(rng, 8) + shared + words(rng, 2)))
    rows += [None, "", " \t\n", "é è", "É È", "  x"]
    rng.shuffle(rows)
    return [(1000 - 3 * i, x) for i, x in enumerate(rows)] + [(5, "one more"), (5, "one more"), (5, "other text here now"), (None, "one more"), (None, "alone at last")]


@pytest.mark.parametrize("k,t", [(4, 85), (5, 80)])
@pytest.mark.parametrize("small", [12, 1])
def test_classes_equal_brute_force(spark, family, k, t, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    if small == 1:  # everything goes through the block comparison, in blocks and column groups of a few
        monkeypatch.setattr(jaccard, "BLOCK", 5)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(jaccard, "COLUMNS", 7)
    d = spark.createDataFrame(family, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS key", "'x' AS sid")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(d, k, t).collect()), key=str)
    assert got == brute(family, k, t)


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, jaccard.op4_partenum_join(spark, SF).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_empty_table(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cells,miss", [(1, 0), (2, 1), (3, 1), (4, 2)])
@pytest.mark.parametrize("t", [80, 85])
def test_similar_sets_share_a_signature(cells, miss, t):
    rule, rng = jaccard.PartEnum(t, cells, miss), np.random.default_rng(9)
    for n in [*range(1, 40), 75, 200, 900]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**63, n, np.uint64))
            gone = int(rng.integers(0, n - (-(-n * t // 100)) + 1))
            more = 0
            while 100 * (n - gone) >= t * (n + more + 1) and rng.random() < 0.9:
                more += 1
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, more, np.uint64)]))
            if len(a) == len(b) and (a == b).all():
                continue
            assert 100 * len(np.intersect1d(a, b)) >= t * len(np.union1d(a, b))
            assert len(np.intersect1d(rule.signatures(a), rule.signatures(b)))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_signatures_move_as_packs(spark):
    """Every shared signature is met, and a signature takes half the bytes that a row of it took (24)."""
    rng = np.random.default_rng(1)
    sigs, sids = rng.integers(0, 2**64, 100_000, np.uint64), rng.integers(-(2**63), 2**63, 100_000)
    packs = dict(jaccard.packs(sigs, sids, 64))
    got = [jaccard.unpacked(packs[i]) for i in sorted(packs)]
    order = np.argsort(sigs)
    assert (np.concatenate([g[0] for g in got]) == sigs[order] >> np.uint64(16)).all() and (np.concatenate([g[1] for g in got]) == sids[order]).all()
    assert [int(g[0].max()) * 64 >> 48 for g in got] == list(range(64))
    docs = jaccard.keyed(spark.read.parquet(f"{SF}/documents.parquet"))
    rule, by = jaccard.PartEnum(85), {}
    sets = {r.key: text_shingles(r.text, 4) for r in docs.collect()}
    for h in {jaccard.set_id(h): h for h in sets.values() if len(h)}.values():
        for x in rule.signatures(h).tolist():
            by.setdefault(x >> 16, set()).add(jaccard.set_id(h))
    before, rows = shuffle_files(spark), jaccard.expanded(docs, 4, 85)
    got = rows.collect()
    shared = {x: s for x, s in by.items() if len(s) > 1}
    assert sorted((r.at, r.sid, r.low, r.many) for r in got if r.n is None) == sorted((x, i, min(s), len(s)) for x, s in shared.items() for i in s)
    assert {(r.at, r.sid, r.n) for r in got if r.n is not None} == {(k, jaccard.set_id(h) if len(h) else None, len(h)) for k, h in sets.items()}
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    moved = sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data") and f.getName() in shuffle_files(spark) - before)
    assert 0 < moved < 16 * sum(map(len, by.values()))


def folders(spark):
    from tidebar.llm.common import shared_dir

    base = shared_dir(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    return {f for f in os.listdir(base) if os.path.isdir(f"{base}/{f}")}


def test_near_copies_leave_sets_and_roots_alone(spark, family):
    before = folders(spark)
    classes = jaccard.classes(spark.createDataFrame(family, "doc_id long, text string"))
    assert {f.split("-")[0] for f in folders(spark) - before} == {"sets", "roots"}
    assert classes.count() == len(family)


def test_the_pipeline_keeps_its_last_documents_alone(spark):
    import corpus_pipeline

    before = folders(spark)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = {f.split("-")[0] for f in folders(spark) - before}
    assert "mixing" in new and not new & {"language", "near_duplicates", "decontamination", "mix", "signatures", "involved", "spare", "leaks"}
    assert rows.count() > 0


def test_one_of_each_group_stays_and_few_documents_move(spark, monkeypatch):
    """Repeated rows, copies and texts without words, with a filter that tells nothing too."""
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(60))
    rows = [(5, line), (3, line), (3, line), (9, line + " end"), (7, "alone at last here"), (7, "alone at last here"), (8, None), (8, None), (2, None), (None, line), (None, "no id")]
    for bits in (jaccard.FILTER_BITS, 6):
        monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
        got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, line), (7, "alone at last here"), (8, None), (2, None), (None, "no id")], key=str)


def test_components_keep_no_shuffle(spark):
    """Steps are kept as files, so what they shuffled goes at once, however many steps a long path takes."""
    names = random.Random(8).sample(range(10**6), 60)
    path = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    before = shuffle_files(spark)
    roots = jaccard.components(path)
    for _ in range(40):  # files go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    assert not left
    assert {r.root for r in roots.collect()} == {min(names)}


def test_stars_take_no_step(spark):
    stars = [(c, c + i) for c in (0, 1000, 2000) for i in range(1, 30)]
    spark.sparkContext.setJobGroup("stars", "stars")
    try:
        roots = jaccard.components(spark.createDataFrame(stars, "a long, b long"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.root, r.node) for r in roots.collect()) == stars
    assert jobs <= 8


def codes(text):
    import re

    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute_leaks(text, item):
    """Best share of equal words in a stretch, over every diagonal: no mask is asked. Items below 7 words leak whole."""
    d, q = codes(text), codes(item)
    if len(q) < 7:
        return float(bool(q) and any(d[i : i + len(q)] == q for i in range(len(d))))
    at = {}
    for i, w in enumerate(q):
        at.setdefault(w, []).append(i)
    hits = {a - b for a, w in enumerate(d) for b in at.get(w, ())}
    best, long = 0.0, min(len(q), 20)
    for g in hits:
        same = [0 <= i + g < len(d) and d[i + g] == w for i, w in enumerate(q)]
        best = max(best, max(sum(same[s : s + long]) for s in range(len(q) - long + 1)) / long)
    return best if best >= 0.8 else 0.0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((6, 7, 15, 22, 60, 60))] + [(9, None), (None, "a b c d e f g h"), (10, "")]
    docs = [(1, None), (2, ""), (3, "short"), (4, items[5][1]), (4, items[5][1])]
    for n, (_, t) in enumerate(items[:6]):
        w = t.split()
        docs.append((20 + n, " ".join(words(rng, 30) + w + words(rng, 9))))
        edited = [x if i % 6 else "zz" for i, x in enumerate(w)]
        docs.append((30 + n, "Intro. " + ", ".join(edited).upper()))
        docs.append((40 + n, " ".join([x if i % 3 else "zz" for i, x in enumerate(w)])))
        docs.append((50 + n, " ".join(w[: len(w) // 3] + words(rng, 40))))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS key", "'c' AS codes", "1 AS item_id")
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.judged(d, q).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = dict(docs)[r.doc_id]
        want = {i: brute_leaks(text, t) for i, t in items}
        assert r.items == sorted(i for i, s in want.items() if s and i is not None)
        assert r.best_share == pytest.approx(max(want.values())) and r.contaminated == (r.best_share > 0)
    assert any(r.contaminated and r.best_share < 1 for r in rows)
    clean = decontaminate.clean(d, q)
    assert clean.columns == d.columns and clean.count() == sum(not r.contaminated for r in rows)
    assert decontaminate.judged(d.limit(0), q).count() == 0 and decontaminate.judged(d, q.limit(0)).where("contaminated").count() == 0


def test_masks_meet_every_accepted_stretch():
    for n in range(decontaminate.SPAN, decontaminate.STRETCH + 1):
        masks = [m for m, (least, most) in zip(decontaminate.MASKS, decontaminate.SERVES) if n >= least and n <= (most or n)]
        fits = [{i + p for p in m} for m in masks for i in range(n - max(m))]
        for wrong in combinations(range(n), next(e for e in range(n, -1, -1) if (n - e) / n >= decontaminate.SHARE)):
            assert any(f.isdisjoint(wrong) for f in fits), (n, wrong)


def test_every_edit_of_short_items_and_exact_items_below_the_span(spark):
    item = [f"w{i}" for i in range(10)]
    edits = [" ".join("zz" if i in e else w for i, w in enumerate(item)) for e in combinations(range(10), 2)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five"), (3, "alone"), (4, ""), (5, None)], "item_id long, text string")
    docs = list(enumerate(edits)) + [(100, "so One, two three four five!"), (101, "one two three four six"), (102, "alone"), (103, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.best_share) for r in decontaminate.judged(d, items).collect()}
    assert all(got[i] == ([1], 0.8) for i in range(len(edits)))
    assert [got[i] for i in (100, 101, 102, 103)] == [([2], 1.0), ([], 0.0), ([3], 1.0), ([], 0.0)]
    assert [r.doc_id for r in decontaminate.clean(d, items).orderBy("doc_id").collect()] == [101, 103]


def test_shuffled_and_broadcast_agree(spark, monkeypatch):
    a = sorted(map(tuple, decontaminate.op3_spaced_seeds(spark, "/root/testdata/sf0.001").select("doc_id", "items").collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert a == sorted(map(tuple, decontaminate.op3_spaced_seeds(spark, "/root/testdata/sf0.001").select("doc_id", "items").collect()))
    assert any(x[1] for x in a)


def test_sets_that_cannot_link_are_told_by_a_share_of_their_shingles(spark, monkeypatch):
    """A page of shared words in 40 texts of two pages each, and two texts that differ in a word: those alone go on."""
    line = " ".join(f"all{i}" for i in range(120))
    texts = [f"{line} " + " ".join(f"t{t}w{i}" for i in range(200)) for t in range(40)]
    texts += [texts[0] + " end", texts[1] + " end"]
    sets = spark.createDataFrame([(i, i, len(jaccard.text_shingles(t, 4)), t) for i, t in enumerate(texts)], "sid long, root long, n long, text string")
    bits, met = jaccard.filter_bits, []
    monkeypatch.setattr(jaccard, "filter_bits", lambda keys, *a: met.append(keys.count()) or bits(keys, *a))
    hs = [set(jaccard.text_shingles(t, 4).tolist()) for t in texts]
    want = [i for i, h in enumerate(hs) if 100 * sum(any(x in o for j, o in enumerate(hs) if j != i) for x in h) >= 85 * len(h)]
    assert sorted(r.sid for r in jaccard._shareable(sets, 4, 85).collect()) == want == [0, 1, 40, 41]
    first = {x for i, h in enumerate(hs) for x in h if x % jaccard.SHARE == 0 and any(x in o for j, o in enumerate(hs) if j != i)}
    assert met[0] == len(first) and len(met) == 2


def test_no_text_moves_that_no_comparison_asks_for(spark, family, monkeypatch):
    known = spark.createDataFrame([(i, 5, f"text {i}") for i in range(3000)], "sid long, n long, text string")
    asked = spark.createDataFrame([(i,) for i in range(0, 3000, 150)], "sid long")
    got = {r.sid: r.text for r in jaccard.texts_of(known, asked, 20).collect()}
    assert {i: got.get(i) for i in range(0, 3000, 150)} == {i: f"text {i}" for i in range(0, 3000, 150)}
    assert len(got) < 40
    # A filter that tells nothing changes no result.
    monkeypatch.setattr(jaccard, "FILTER_BITS", 6)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    got = jaccard.classes(spark.createDataFrame(family, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(family, 4, 85)
