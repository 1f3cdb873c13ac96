"""Language identification by multilingual mixture inference (operator 10)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, sliced, table

#: Feature bins: byte 1- to 3-grams hashed; the training sample's bound in documents a language; EM's iterations.
BINS, SAMPLE, ITERATIONS = 1 << 14, 6000, 30
#: Languages that are learned: those of the most labelled documents, so that values of a spoilt column cost no memory.
LANGUAGES = 400
#: A text is in no language when the background is likelier than its languages, their price counted, by odds of 1,000 to 1
#: (on the scale of `mixture`: twice the log, n-grams overlapping threefold), so that a letter or two decide nothing.
ODDS = 3 * 2 * math.log(1000)
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def ngram_counts(text: str) -> np.ndarray:
    """Counts by bin of the 1-, 2- and 3-grams of the text's UTF-8 bytes: ASCII folded to lower case, non-letters to spaces."""
    raw = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)  # a run of spaces counts once
    a = raw[keep]
    g2 = a[:-1] * np.uint32(256) + a[1:]
    g3 = g2[:-1] * np.uint32(256) + a[2:]
    total = np.bincount(a * np.uint32(61) % np.uint32(BINS), minlength=BINS)
    for g in (g2, g3):
        total += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - 14), minlength=BINS)
    return total


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and bin) of docs with text and lang.

    The fit takes a bounded sample of each language, however rare it is: the documents whose hash of doc_id falls below
    sample / all documents of the language. The counts are summed by Spark before they reach the driver: LANGUAGES x BINS numbers at most.
    """
    labelled = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    totals = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_total")).orderBy(F.desc("_total"), "_lang").limit(LANGUAGES)
    labelled = labelled.join(F.broadcast(totals), F.col("lang") == F.col("_lang"))
    labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < F.lit((1 << 30) * sample) / F.col("_total"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + ngram_counts(text)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bin", "n"])

    counted = labelled.select("text", "lang").mapInArrow(count, "lang string, bin int, n long")
    rows = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("c")).collect()
    rows.sort(key=lambda r: r.lang)
    logp = np.empty((len(rows), BINS))
    for i, r in enumerate(rows):
        c = np.full(BINS, 0.5)
        c[[x.bin for x in r.c]] += [x.n for x in r.c]
        logp[i] = np.log(c / c.sum())
    return [r.lang for r in rows], logp


def _em(p: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that maximise sum(c * log(p @ w)), and that value; p has a row per n-gram of the document."""
    w, n = start, c.sum()
    for _ in range(ITERATIONS):
        new = w * (p.T @ (c / (p @ w))) / n
        done = np.abs(new - w).max() < 1e-4
        w = new
        if done:
            break
    return w, float(c @ np.log(p @ w))


def mixture(counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Language proportions of a document; languages outside the chosen set have 0.

    Starting from EM over every language, the language of least weight goes while that lowers
    -2 log-likelihood + 3 (n-grams overlap threefold) * languages * log(n-grams).
    """
    at = np.flatnonzero(counts)
    c = counts[at].astype(float)
    lp = logp[:, at].T
    peak = lp.max(axis=1)
    p, base = np.exp(lp - peak[:, None]), float(c @ peak)
    price = 3 * math.log(c.sum())
    single = lp.T @ c
    best = int(single.argmax())
    out = np.zeros(len(logp))
    out[best] = 1.0
    if len(logp) == 1 or 2 * (base - single[best]) <= price:  # even a perfect mixture gains less than its price
        return out
    live = np.arange(len(logp))
    w, fit = _em(p, c, np.full(len(live), 1 / len(live)))
    while len(live) > 1:
        less = np.delete(np.arange(len(live)), w.argmin())
        start = w[less] + 1e-9
        w2, fit2 = _em(p[:, live[less]], c, start / start.sum())
        if 2 * (fit - fit2) >= price:
            break
        live, w, fit = live[less], w2, fit2
    out[:] = 0
    out[live] = w
    return out


def background(logp: np.ndarray) -> np.ndarray:
    """Log-probabilities by bin of text in no language: half of it bytes that follow each other independently, as often
    as in the languages together, half of it n-grams of any bytes at all."""
    byte = np.array([32, *range(97, 123), *range(128, 256)], np.uint32)
    own = byte * np.uint32(61) % np.uint32(BINS)
    one = np.exp(logp[:, own]).mean(axis=0)
    one /= one.sum()
    out, g, p = np.bincount(own, one, BINS), byte, one
    for _ in range(2):
        g = (g[:, None] * np.uint32(256) + byte).ravel()
        p = (p[:, None] * one).ravel()
        out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - 14), p, BINS)
    return np.log(0.5 * out / out.sum() + 0.5 / BINS)


def gain(counts: np.ndarray, logp: np.ndarray, weights: np.ndarray, none: np.ndarray) -> float:
    """Twice the log-likelihood of the languages' mixture over that of the background."""
    at, live = np.flatnonzero(counts), np.flatnonzero(weights)
    return 2 * float(counts[at] @ (np.log(weights[live] @ np.exp(logp[np.ix_(live, at)])) - none[at]))


def identified(docs: DataFrame, languages: list[str], logp: np.ndarray, reject: bool = False) -> DataFrame:
    """(row, lang_pred, score, lang_mix) of every row of docs: row holds its columns whatever their names; lang_pred is the
    language of largest proportion (the first by name on a tie), score that proportion.

    Null text, text without a letter or a model without languages: `und`, score 0, no mix. With reject, so is text that
    the background fits better than the mixture (by ODDS). Every text is read whole, repeated rows give repeated results,
    an empty table none.
    """
    model = docs.sparkSession.sparkContext.broadcast((languages, logp, background(logp) if languages else None))
    d = packed(docs)

    def predict(batches):
        names, lp, none = model.value
        for b in sliced(batches):
            found = []
            for text in pc.struct_field(b.column(0), "text").to_pylist():
                if not names or text is None or not _LETTER.search(text):
                    found.append(("und", 0.0, ""))
                    continue
                c = ngram_counts(text)
                w = mixture(c, lp)
                if reject and gain(c, lp, w, none) - 3 * math.log(c.sum()) * np.count_nonzero(w) < -ODDS:
                    found.append(("und", 0.0, ""))
                    continue
                k = int(w.argmax())
                found.append((names[k], float(min(1.0, w[k])), ",".join(f"{names[i]}:{w[i]:.2f}" for i in np.flatnonzero(w >= 0.005))))
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["row", "lang_pred", "score", "lang_mix"])

    schema = T.StructType([d.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_mix", T.StringType())])
    return d.mapInArrow(predict, schema)


def identify(docs: DataFrame, languages: list[str], logp: np.ndarray, reject: bool = False) -> DataFrame:
    """docs with lang_pred, score and lang_mix of `identified`; columns of docs by these names are replaced."""
    found = identified(docs, languages, logp, reject)
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "lang_mix")]
    return found.select(*keep, "lang_pred", "score", "lang_mix")


def held_out():
    """Whether a document is outside the training part: crc32 of doc_id as text leaves 1 modulo 3 (null doc_id: as '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, lang_mix) of every document; only null or letterless text is `und` here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    languages, logp = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), languages, logp)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_mix")
