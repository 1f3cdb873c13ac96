"""Token counts of a unigram vocabulary by a count-only Viterbi pass (operator 5)."""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

SPACE = "▁"  # stands for a space at the start of a word


def unigrams(model_file: str) -> list[tuple[str, float]]:
    """(piece, log-probability) of a sentencepiece file's plain pieces: its ranks read as a Zipf law.

    Bytes, controls and the unknown piece have no part in it. Pieces made of spaces alone are left out, since white
    space is dropped between words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain = [p for p in plain if p.strip(SPACE) or p == SPACE]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return [(p, -math.log(r + 1) - total) for r, p in enumerate(plain)]


#: Longer words are segmented anew each time.
LONG = 64


class Counter1:
    """Pieces and score of a word, as the tokenizers library's Unigram model segments it.

    An Aho-Corasick automaton lists every vocabulary match once, by its end. The best score and its piece count are carried
    for as many places back as the longest piece, so a word may have any length; matches are tried in order of their start,
    and a later one wins only with a strictly greater score, which is the library's tie rule. A character with no match of its own length counts as unknown at the least score
    minus 10, and a run of unknown characters is one piece.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = 300_000):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.auto.add_word(piece, (len(piece), score))
        if vocabulary:
            self.auto.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.kept: dict[str, tuple[int, float]] = {}
        self.keep, self.any = keep, bool(vocabulary)
        self.ring = 1 + max((len(p) for p, _ in vocabulary), default=1)

    def word(self, word: str) -> tuple[int, float]:
        ring, unknown = self.ring, self.unknown
        matches = iter(self.auto.iter(word) if self.any else ())
        end, match = next(matches, (-1, None))
        # (score, pieces, last piece unknown) of the best way to each of the last places
        best = [(0.0, 0, False)] * ring
        for place in range(1, len(word) + 1):
            here, single, own = None, False, []
            while end == place - 1:
                own.append(match)
                end, match = next(matches, (-1, None))
            for size, s in sorted(own, reverse=True):
                single |= size == 1
                score, pieces, _ = best[(place - size) % ring]
                if here is None or score + s > here[0]:
                    here = (score + s, pieces + 1, False)
            if not single:
                score, pieces, was_unknown = best[(place - 1) % ring]
                if here is None or score + unknown > here[0]:
                    here = (score + unknown, pieces + (not was_unknown), True)
            best[place % ring] = here
        score, pieces, _ = best[len(word) % ring]
        return pieces, score

    def text(self, text: str) -> tuple[int, float]:
        n, total = 0, 0.0
        for w, times in Counter(text.split()).items():
            got = self.kept.get(w)
            if got is None:
                got = self.word(SPACE + w)
                if len(w) <= LONG:  # so that the entries bound the bytes kept
                    if len(self.kept) >= self.keep:
                        self.kept.clear()
                    self.kept[w] = got
            n += got[0] * times
            total += got[1] * times
        return n, total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens, score) of every whole text: pieces of its words, each with a leading space mark, and the sum of
    their log-probabilities. Words are what str.split() gives, so segments never cross them and a word is segmented
    once a task. Null or blank texts have no tokens; repeated rows repeat; an empty vocabulary makes every word one
    unknown piece."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = None
        for b in sliced(batches):
            counter = counter or Counter1(shared.value)
            got = [counter.text(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([round(g[1], 6) for g in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")


def op5_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`count_tokens` of every document by the pieces of piece_bpe_32k.model; odd rows as there."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), unigrams(public_tokenizers.path("piece_bpe_32k.model")))
