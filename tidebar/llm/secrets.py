"""Secret scan: fixed patterns and a randomness test battery (operator 1). DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The contract's patterns. Hex runs under 16 and keys under 18 characters fail whole, so their lengths
# stand in the pattern; an assignment that fails consumes its text, so its length is tested afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Tokens the battery looks at: the longest runs of one alphabet, where '=' only ends a run (so NAME=value falls apart).
#: The first pattern takes runs with + or / and those of letters and digits alone, the second runs with _ or -; a run that
#: lies within another is not taken, so runs overlap only where a text mixes both kinds of marks.
TOKENS = (
    r"(?<![0-9A-Za-z+/])(?=[0-9A-Za-z+/]{20})[0-9A-Za-z]*+[+/][0-9A-Za-z+/]*+={0,2}|(?<![0-9A-Za-z+/_-])[0-9A-Za-z]{20,}+(?![+/_-])={0,2}",
    r"(?<![0-9A-Za-z_-])(?=[0-9A-Za-z_-]{20})[0-9A-Za-z]*+[_-][0-9A-Za-z_-]*+={0,2}",
)
#: The battery's level; the false-discovery rate; bins of -ln p are a quarter wide.
LEVEL, FDR, STEP, MOST = 0.001, 0.01, 4, 400
#: Inferred encodings, the first whose pattern a token meets: name, pattern, alphabet.
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _D + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _D + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _U + "234567"),
    ("base36", "^[0-9a-z]+$", _D + _L),
    ("base62", "^[0-9A-Za-z]+$", _U + _L + _D),
    ("base64", "^[0-9A-Za-z+/]+$", _U + _L + _D + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _U + _L + _D + "-_"),
)


def _tail(z: Column) -> Column:
    """-ln of the normal tail beyond z for z >= 0 (a rational approximation, relative error below 1e-4); ln 2 at most below 0."""
    a = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + F.lit(0.2316419) * a)
    # Fixed values of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return a * a / 2 + math.log(math.sqrt(2 * math.pi)) - F.log(poly)


def _found(text: Column, hits: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """array<struct(start, kind, end)> of a pattern's matches: their places follow from the lengths of what lies between."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(hits, F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + pair["g"]
        end = begin + pair["n"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(pair["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    ok = F.transform(hits, lambda _: F.lit(True)) if keep is None else keep
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.arrays_zip(sizes.alias("n"), ok.alias("ok")), lambda g, x: F.struct(g.alias("g"), x["n"].alias("n"), x["ok"].alias("ok")))
    return F.when(F.size(hits) == 0, zero["out"]).otherwise(F.aggregate(pairs, zero, step, lambda a: a["out"]))


def battery(token: Column) -> Column:
    """struct(encoding, p_random, nat, n) of a token: the battery's combined p-value that it is uniform over its inferred
    alphabet (chi-squared with its exact moments, Wald-Wolfowitz runs about the middle, lag-1 serial correlation; the
    least p-value times three), and nat, -ln p of so few coincidences among its letters if it were written language."""
    bare = F.rtrim(token, F.lit("="))
    name, abc = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, pattern, alphabet in reversed(ENCODINGS):
        name, abc = F.when(bare.rlike(pattern), n).otherwise(name), F.when(bare.rlike(pattern), alphabet).otherwise(abc)
    s = F.struct(bare.alias("bare"), name.alias("enc"), abc.alias("abc"))

    def tests(s):
        n, k = F.length(s["bare"]).cast("double"), F.length(s["abc"]).cast("double")
        counts = F.transform(F.regexp_extract_all(s["abc"], F.lit("."), F.lit(0)), lambda c: n - F.length(F.replace(s["bare"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        values = F.transform(F.regexp_extract_all(s["bare"], F.lit("."), F.lit(0)), lambda c: F.instr(s["abc"], c).cast("double") - (k + 1) / 2)
        return F.struct(s["enc"].alias("enc"), n.alias("n"), k.alias("k"), squares.alias("sq"), values.alias("v"))

    def sums(x):
        v, n = x["v"], x["n"]
        mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n
        high = F.aggregate(v, F.lit(0.0), lambda a, b: a + (b > 0).cast("double"))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.aggregate(pairs, F.lit(1.0), lambda acc, p: acc + ((p["a"] > 0) != (p["b"] > 0)).cast("double"))
        co = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
        var = F.aggregate(v, F.lit(0.0), lambda acc, b: acc + (b - mean) * (b - mean))
        return F.struct(*[x[c].alias(c) for c in ("enc", "n", "k", "sq")], high.alias("hi"), runs.alias("runs"), F.coalesce(F.try_divide(co, var), F.lit(1.0)).alias("r"))

    def verdict(x):
        n, k = x["n"], x["k"]
        chi = (x["sq"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mu = 2 * x["hi"] * (n - x["hi"]) / n + 1
        runs = F.coalesce(F.try_divide(F.abs(x["runs"] - mu), F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(0.0)))), F.lit(99.0))
        serial = F.abs(x["r"] + 1 / n) * F.sqrt(n)
        worst = F.greatest(_tail(chi), _tail(runs) - math.log(2), _tail(serial) - math.log(2))
        same = (x["sq"] - n) / (n * (n - 1))
        usual = F.greatest(F.lit(0.065), 2 / k)  # chance that two letters of written language agree
        nat = _tail((usual - same) / F.sqrt(2 * usual * (1 - usual) / (n * (n - 1))))
        return F.struct(x["enc"].alias("encoding"), F.least(F.lit(1.0), 3 * F.exp(-worst)).alias("p_random"), nat.alias("nat"), n.cast("int").alias("n"))

    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  an expression used many times, evaluated once
    return once(once(once(s, tests), sums), verdict)


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base and random spans of every whole text; code points, end exclusive; null text is empty.

    A random span is a token (a longest run of one alphabet) apart from every base span, with a letter and a digit, that
    passes the battery and whose
    -ln p under written language is a discovery by Benjamini-Hochberg among all such tokens of its length band (powers
    of two) in the table. The bands' cut-offs come from counts by band and bin, so the driver sees at most
    32 * MOST numbers. Repeated rows and equal doc_ids give a row each; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"))
    d = d.select("doc_id", "t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX, *TOKENS))])
    long_enough = F.when(F.size("m0") > 0, F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= 12)).otherwise(F.array().cast("array<boolean>"))

    def tokens(m: str, pattern: str) -> Column:
        none = F.array().cast("array<struct<span:struct<start:int,kind:int,end:int>,token:string>>")
        return F.when(F.size(m) > 0, F.arrays_zip(_found(F.col("t"), F.col(m), pattern, 3).alias("span"), F.col(m).alias("token"))).otherwise(none)

    d = d.select(
        "doc_id",
        F.concat(_found(F.col("t"), F.col("m0"), ASSIGN, 0, long_enough), _found(F.col("t"), F.col("m1"), ACCESS, 1), _found(F.col("t"), F.col("m2"), HEX, 2)).alias("base"),
        F.concat(*[tokens(f"m{3 + i}", p) for i, p in enumerate(TOKENS)]).alias("tokens"),
    )
    apart = F.filter("tokens", lambda x: x["token"].rlike("[A-Za-z]") & x["token"].rlike("[0-9]") & ~F.exists(F.col("base"), lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])))
    judged = F.transform(apart, lambda x: F.struct(x["span"].alias("span"), battery(x["token"]).alias("b")))
    d = d.select("doc_id", "base", judged.alias("judged"))
    shown = F.transform("judged", lambda x: F.struct(x["span"].alias("span"), (x["b"]["p_random"] >= LEVEL).alias("random"), F.floor(F.log2(x["b"]["n"].cast("double"))).cast("int").alias("band"), F.least(F.floor(x["b"]["nat"] * STEP), F.lit(MOST)).cast("int").alias("bin")))
    d = d.select("doc_id", "base", shown.alias("judged"))
    counts = d.select(F.explode("judged").alias("x")).groupBy("x.band", "x.bin").agg(F.count("*").alias("n")).collect()
    cut = discoveries([(r.band, r.bin, r.n) for r in counts], fdr)
    cuts = F.create_map(*[F.lit(v) for kv in cut.items() for v in kv]) if cut else F.create_map().cast("map<int,int>")
    random = F.transform(F.filter("judged", lambda x: x["random"] & (x["bin"] >= F.coalesce(F.element_at(cuts, x["band"]), F.lit(MOST + 1)))), lambda x: x["span"])
    return d.select("doc_id", F.array_sort("base").alias("base"), random.alias("random"))


def discoveries(counts: list[tuple[int, int, int]], fdr: float) -> dict[int, int]:
    """By band, the least bin b at which the tokens expected by chance, all * exp(-b / STEP), are at most fdr of those found."""
    out: dict[int, int] = {}
    for band in {b for b, _, _ in counts}:
        own = sorted(((b, n) for g, b, n in counts if g == band), reverse=True)
        every, found = sum(n for _, n in own), 0
        for b, n in own:
            found += n
            if every * math.exp(-b / STEP) <= fdr * found:
                out[band] = b
    return out


def span_text(spans: Column, kinds=KINDS) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "random"))).alias("spans"))
