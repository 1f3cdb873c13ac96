import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebar.llm import merkle, periodic, phrases

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def rows_of(spark, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- periodic runs -----------------------------------------------------------------------------------------------


def runs_by_hand(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(x[k] == x[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(0, 50), st.integers(0, 40))
def test_runs_are_those_by_hand(x, q, a, more):
    x = x + [x[a % len(x) + i % q] if a % len(x) + i % q < len(x) else i % q for i in range(more)] if x else x
    assert periodic.find_runs(periodic.word_ids([str(v) for v in x])) == runs_by_hand(x)


def test_runs_of_a_long_text():
    r = random.Random(3)
    x = [str(r.randrange(3000)) for _ in range(30_000)]
    x[5_000:15_000] = (x[5_000:7_000] * 5)[:10_000]
    x[20_000:20_030] = ["a"] * 30
    got = periodic.find_runs(periodic.word_ids(x))
    assert (20_000, 30, 1) in got and any(q == 2_000 and s <= 5_000 and s + n >= 15_000 for s, n, q in got)
    assert periodic.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_periodic_query(spark):
    want = []
    for key, text in rows_of(spark, "doc_id", "text"):
        w = re.findall(WORD, text or "")
        h, n = zlib.crc32(str(key).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        ids = {}
        x = np.array([ids.setdefault(v, len(ids)) for v in w])
        runs = runs_by_lag(x)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want.append((key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(v for i, v in enumerate(w) if i not in gone))))
    assert ordered(periodic.op11_periodic_runs(spark, SF).collect()) == ordered(want)


def runs_by_lag(x):
    """As runs_by_hand, with numpy along each lag."""
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
        for s, j in zip(edge[::2], edge[1::2]):
            e = j + q
            if e - s >= max(6, 4 * q) and not any(q % p == 0 and (x[s : e - p] == x[s + p : e]).all() for p in range(1, q)):
                out.append((int(s), int(e - s), q))
    return sorted(out)


def test_periodic_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b " * 5), (4, "x"), (5, "a b " * 5), (5, "a b " * 5), (6, "é\x85é " * 9), (7, "w " * 40_000)]
    d = docs_of([(i, t, "l", "s", 1) for i, t in rows]).withColumnsRenamed({"lang": "runs", "source": "row", "n_chars": "n_words"})
    got = periodic.periodic_runs(d)
    by = {(r.row.doc_id, r.row.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    assert got.count() == len(rows) and list(got.schema["row"].dataType.fieldNames()) == d.columns
    assert by[1, None] == by[2, ""] == by[3, " \n"] == (0, [], "") and by[4, "x"] == (1, [], "x")
    assert by[None, "a b " * 5] == by[5, "a b " * 5] == (10, [(0, 10, 2)], "a b") and by[6, "é\x85é " * 9] == (9, [(0, 9, 1)], "é\x85é")
    assert by[7, "w " * 40_000] == (40_000, [(0, 40_000, 1)], "w")
    assert periodic.periodic_runs(d.limit(0), plant=True).count() == 0
    assert periodic.planted(["a", "b"], None) == ["a", "b"] and periodic.planted([], 5) == []


# --- repeated passages -------------------------------------------------------------------------------------------


def removed_by_hand(texts, span=35):
    words = [re.findall(WORD, t or "") for t in texts]
    n = {}
    for w in words:
        for i in range(len(w) - span + 1):
            n[tuple(w[i : i + span])] = n.get(tuple(w[i : i + span]), 0) + 1
    for w in words:
        gone = {j for i in range(len(w) - span + 1) if n[tuple(w[i : i + span])] > 1 for j in range(i, i + span)}
        yield len(w), len(gone), " ".join(v for j, v in enumerate(w) if j not in gone)


def test_phrases_query(spark):
    docs = rows_of(spark, "doc_id", "text")
    want = [(k, n, gone, sha(kept)) for (k, _), (n, gone, kept) in zip(docs, removed_by_hand([t for _, t in docs]))]
    assert ordered(phrases.op12_repeated_phrases(spark, SF).collect()) == ordered(want)


def test_phrases_of_every_length_and_edit(spark, docs_of, monkeypatch):
    """Passages around the least length, one word changed at any place, repeats inside a text, overlaps of two passages."""
    r = random.Random(8)
    word = lambda k=5000: f"w{r.randrange(k)}"
    base = [word() for _ in range(400)]
    texts = [" ".join(base)]
    for n in (33, 34, 35, 36, 52, 69, 70, 71, 140):
        at = r.randrange(0, 400 - n)
        texts.append(" ".join([word() for _ in range(20)] + base[at : at + n] + [word() for _ in range(20)]))
    for at in range(0, 400, 23):
        texts.append(" ".join(base[:at] + [word()] + base[at + 1 :]))
    texts += [" ".join((base[10:60] + [word()]) * 3), " ".join(base[100:150] + base[120:170]), "a " * 34, "a " * 35, "b " * 36, "c " * 500, "d e " * 100, "D e " * 100]
    texts += [" ".join(word(3) for _ in range(300)) for _ in range(6)]
    texts += [None, "", " \t", "x", texts[3], texts[3], " ".join(f"é{i}ß" for i in range(40)), " ".join(f"é{i}ß" for i in range(40)).replace(" ", "\x0b\n")]
    d = docs_of([(i // 2 if i % 7 else None, t, None, "s", 0) for i, t in enumerate(texts)]).withColumnsRenamed({"lang": "row", "source": "kept", "n_chars": "block"})
    want = list(removed_by_hand(texts))
    for size in (8 << 20, 500):
        monkeypatch.setattr(phrases, "BLOCK_CHARS", size)
        got = phrases.without_repeats(d)
        key = lambda x: (x[0] or "", x[0] is None, *x[1:])
        assert sorted([(x.row.text, x.n_words, x.n_removed, x.kept) for x in got.collect()], key=key) == sorted([(t, *w) for t, w in zip(texts, want)], key=key)
        assert got.schema["row"].dataType.fieldNames() == d.columns
    assert phrases.without_repeats(d.limit(0)).count() == 0


def test_filters_only_spare_work(spark, monkeypatch):
    """With filters too small to tell anything the result is the same."""
    want = ordered(phrases.op12_repeated_phrases(spark, SF).collect())
    monkeypatch.setattr(phrases, "ANCHOR_BITS", 6)
    monkeypatch.setattr(phrases, "KEY_BITS", 6)
    assert ordered(phrases.op12_repeated_phrases(spark, SF).collect()) == want


def test_letters_that_coincide_remove_nothing(monkeypatch):
    monkeypatch.setattr(phrases, "_LETTERS", 2)
    r = random.Random(0)
    passage = [b"p%d" % i for i in range(60)]
    own = phrases.Phrases([b" ".join(passage).decode()])
    other = [b"p%d" % r.randrange(60) for _ in range(2000)]
    assert not own.covered(other).any()
    assert own.covered(other + passage[5:50] + other).sum() >= 45


# --- manifest ----------------------------------------------------------------------------------------------------


def leaf(r):
    return hashlib.sha256(b"".join(b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in r)).hexdigest()


def tree(digests):
    """Root, and for each leaf its (siblings, place) level by level."""
    steps, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(i, min(i + 3, len(digests))) for i in range(0, len(digests), 3)]
        for run in runs:
            for j in run:
                for k in under[j]:
                    steps[k].append(([digests[i] for i in run if i != j], j - run[0]))
        digests, under = [sha("".join(digests[i] for i in run)) for run in runs], [sum((under[i] for i in run), []) for run in runs]
    return digests[0], steps


def manifest_by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    for s, up in zip(sources, above):
        for r, steps in zip(own[s], trees[s][1]):
            tamper = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            d = leaf((*r[:4], r[4].replace("\n", "")) if tamper else r)
            for siblings, place in steps + up:
                d = sha("".join([*siblings[:place], d, *siblings[place:]]))
            yield r[0], leaf(r), trees[s][0], root, sha("".join(x for siblings, _ in steps + up for x in siblings)), d, d == root


def test_manifest_query(spark):
    want = list(manifest_by_hand(rows_of(spark, *merkle.FIELDS)))
    assert 0 < sum(w[-1] for w in want) < len(want)
    assert ordered(merkle.op13_merkle_manifest(spark, SF).collect()) == ordered(want)


def test_manifest_of_many_supersteps(spark):
    """Supersteps of one level and of two give the manifest that supersteps of six do."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "source", merkle.leaf_hash("doc_id", "text").alias("leaf"), F.lit(None).cast("string").alias("other"))
    want = ordered(merkle.manifest(d).collect())
    assert len(want) == 200 and all(w[-1] for w in want)
    for height in (1, 2):
        assert ordered(merkle.manifest(d, height).collect()) == want


def test_manifest_of_odd_rows(spark, docs_of, tmp_path):
    """Null in any column, repeated rows and ids, one source of many rows and many of one, empty text, no rows at all."""
    rows = [(i, f"t{i}\n", "l", "hot", i) for i in range(245)] + [(i, "x", None, f"s{i:03d}", None) for i in range(29)]
    rows += [(None, "n", "l", "hot", 1), (7, "t7\n", "l", "hot", 7), (7, None, None, None, None), (8, "", "", "", 0), (9, "é\n\n\x0b", "l", "é", 2), (10, "y" * 300_000 + "\n", "l", "None", 2)]
    docs_of(rows).select("doc_id", "source", "lang", "n_chars", "text", F.lit(1).alias("leaf"), F.lit(2).alias("place")).write.parquet(f"{tmp_path}/documents.parquet")
    want = manifest_by_hand([(i, s, lang, n, t) for i, t, lang, s, n in rows])
    assert ordered(merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()) == ordered(want)
    docs_of([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0
    docs_of(rows[:1]).write.parquet(f"{tmp_path}/one/documents.parquet")
    (one,) = merkle.op13_merkle_manifest(spark, f"{tmp_path}/one").collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("") and one.verified == (zlib.crc32(b"0") % 2 == 1)


def test_automaton_reads_only_where_passages_may_stand():
    passage = [f"w{i}" for i in range(60)]
    p = phrases.Phrases([" ".join(passage), " ".join(passage[::-1])])
    read, found = [], p.found

    class Spy:
        def __len__(self):
            return len(found)

        def iter(self, text, lo=0, hi=None):
            hi = len(text) if hi is None else hi
            read.append(hi - lo)
            return found.iter(text, lo, hi)

    p.found = Spy()
    mixed = [w.encode() for k in range(40) for w in passage[k % 7 :: 7]]  # the same words, in another order
    got = p.covered(mixed + [w.encode() for w in passage[3:50]] + mixed)
    assert got.nonzero()[0].tolist() == list(range(len(mixed), len(mixed) + 47))
    assert 47 <= sum(read) <= 60
    assert not p.covered(mixed).any() and sum(read) <= 60
