"""Toxicity from a weighted lexicon, matched on folded text.

The lexicon is learned: words, and stems that words begin with, that labelled toxic
documents hold far more often than others, weighted by the logarithm of the odds.
Aho-Corasick finds them in text in which look-alike letters and digits are folded; of the
entries that match in a word the heaviest counts. Phrases in which a word is harmless cancel
it: these are learned as well, as pairs of words with an entry in them that clean documents
hold and toxic ones hardly do.
Sums of weights, whole and by length, give a probability by a logistic fit.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alikes of Latin letters: Cyrillic, Greek, digits and signs. I, L, 1 and | are one.
#: Fixed values.
FOLDED = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i", "ı": "i",
}
#: Zero-width characters and soft hyphens, which show nothing.
HIDDEN = "­​‌‍⁠﻿"
#: Lengths of stems.
STEMS = (5, 6, 7, 8)

_TABLE = str.maketrans(FOLDED | dict.fromkeys(HIDDEN, ""))
_CASED = str.maketrans({chr(c): FOLDED.get(chr(c + 32), chr(c + 32)) for c in range(65, 91)} | {k: v for k, v in FOLDED.items() if k.isascii()})
_MARKS = re.compile("[̀-ͯ]")
_INNER = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case without accents, with look-alikes and digits as the letters they stand for."""
    if text.isascii():
        folded = text.translate(_CASED)
    else:
        folded = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_TABLE)
    return _INNER.sub("i", folded) if "!" in folded else folded


@dataclass
class Lexicon:
    """weights: by folded word, or stem with a star; scale: intercept, slopes of features."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    scale: tuple[float, ...] = (-3.0, 2.0, 1.0)
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                bare, stem = word.rstrip("*"), word.endswith("*")
                known = self._machine.get(bare, None)  # a word may be a stem as well
                ends = (known[1:] if known else (0.0, 0.0))
                self._machine.add_word(bare, (len(bare), max(weight, ends[0]) if stem else ends[0], ends[1] if stem else max(weight, ends[1])))
            for phrase in self.exceptions:
                self._machine.add_word(fold(phrase), (len(fold(phrase)), 0.0, 0.0))
            self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the heaviest entry of each word of a folded text, but for
        words within an exception phrase."""
        if not self.weights:
            return []
        found: dict[int, tuple[int, float]] = {}
        harmless = []
        for at, (size, as_stem, as_word) in self.machine().iter(folded):
            start, end = at - size + 1, at + 1
            if start and folded[start - 1].isalpha():
                continue
            ends = end == len(folded) or not folded[end].isalpha()
            weight = max(as_stem, as_word) if ends else as_stem
            if not as_stem and not as_word:
                harmless += [(start, end)] * ends
            elif weight and weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end, weight)
        if not harmless:
            return [(start, end, w) for start, (end, w) in found.items()]
        covered, upto = [], -1
        for a, b in sorted(harmless):  # as spans that don't touch each other
            if a < upto:
                upto = max(upto, b)
                covered[-1] = (covered[-1][0], upto)
            else:
                covered.append((a, b))
                upto = b
        starts = [a for a, _ in covered]
        inside = lambda s, e: (i := bisect.bisect_right(starts, s)) > 0 and e <= covered[i - 1][1]
        return [(start, end, w) for start, (end, w) in found.items() if not inside(start, end)]

    def hits(self, text: str) -> tuple[float, int]:
        """Sum of the weights of words matched, and their number."""
        kept = self.matches(fold(text))
        return sum(w for *_, w in kept), len(kept)

    def phrases(self, text: str) -> set[str]:
        """Pairs of words, one blank between them, of which one holds an entry."""
        folded = fold(text)
        at = {start for start, *_ in self.matches(folded)}
        spans = [m.span() for m in _WORD.finditer(folded)] if at else []
        return {folded[a:d] for (a, b), (c, d) in zip(spans, spans[1:], strict=False) if (a in at or c in at) and folded[b:c] == " "}

    def features(self, text: str) -> tuple[float, float]:
        return self._features(text, self.hits(text)[0])

    def _features(self, text: str, total: float) -> tuple[float, float]:
        if not total:
            return 0.0, 0.0
        words = text.count(" ") + text.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / (words + 20))

    def score(self, text: str) -> float:
        return self.scored(text)[0]

    def scored(self, text: str) -> tuple[float, int]:
        """The score, and the number of words matched."""
        total, n = self.hits(text)
        return self._chance(*self._features(text, total)), n

    def _chance(self, x: float, y: float) -> float:
        a, b, c = self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))

    def bare(self) -> Lexicon:
        return Lexicon(self.weights, self.exceptions, self.scale)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is out of the labels that are learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of distinct words by text: how many texts of either label hold them."""
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w for w in _WORD.findall(fold(text or "")) if 3 <= len(w) <= 32}
            counts[toxic].update(words)
            counts[toxic].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([counts[t][w] for w in words], pa.int64()) for t in (0, 1))], names=["word", "clean", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x / len(y) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _phrase_counts(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Of distinct phrases around entries by text: how many texts of either label hold them."""
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(lexicon.phrases(text or ""))
        phrases = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), *(pa.array([counts[t][w] for w in phrases], pa.int64()) for t in (0, 1))], names=["phrase", "clean", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon from labelled rows that aren't held out.

    max_rows bounds the labelled rows learned from, about: a larger table of labels is
    thinned by the MD5 of doc_id. Equal texts count once. A word or stem enters with at
    least 5 toxic texts and 1 in 200 of all of them, and odds at least 8 times those
    elsewhere, so that there are no more than 200 times as many entries as words in a toxic
    text. A phrase of two words with an entry in it is an exception if 5 clean texts or more
    hold it, and its odds are less than half of those of a clean phrase; `exceptions` are
    further ones. Without toxic or without other labels the lexicon is empty and all scores
    equal the share of toxic labels. Null doc_ids and labels other than 0 and 1 are left out;
    of labels that repeat a doc_id the largest counts.
    """
    spark = docs.sparkSession
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    thin = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32 < max_rows / max(n, 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(usable.where(thin), "doc_id").groupBy(F.sha2("text", 256).alias("same")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).where("text is not null")
    rows = rows.select("text", "toxic").persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            prior = (toxic + 0.5) / (toxic + clean + 1)
            return Lexicon({}, tuple(exceptions), (math.log(prior / (1 - prior)), 0.0, 0.0))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        words = rows.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        best = words.where(F.col("toxic") >= max(5, toxic / 200)).withColumn("odds", odds).where(F.col("odds") >= math.log(8)).select("word", "odds").collect()
        lexicon = Lexicon({r["word"]: round(r["odds"], 6) for r in sorted(best)})
        found = spark.sparkContext.broadcast(lexicon.bare())
        phrases = rows.mapInArrow(lambda b: _phrase_counts(b, found.value), "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        harmless = phrases.where("clean >= 5").withColumn("odds", odds).where(F.col("odds") <= math.log(0.5)).select("phrase").collect()
        lexicon = Lexicon(lexicon.weights, (*map(fold, exceptions), *sorted(r["phrase"] for r in harmless)))
        kept = spark.sparkContext.broadcast(lexicon.bare())

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = kept.value
            for batch in batches:
                found = [own.features(x) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column("toxic").cast(pa.float64())], names=["x", "y", "toxic"])

        seen = np.array(rows.mapInArrow(measured, "x double, y double, toxic double").groupBy("x", "y").agg(F.count("*"), F.sum("toxic")).collect(), float).reshape(-1, 4)
    finally:
        rows.unpersist()
    seen = seen[np.lexsort(seen.T)]  # rows come in any order; sums shall not
    pos, neg = np.repeat(seen[:, :2], seen[:, 3].astype(int), axis=0), np.repeat(seen[:, :2], (seen[:, 2] - seen[:, 3]).astype(int), axis=0)
    lexicon.scale = tuple(round(float(v), 6) for v in _logistic(np.vstack([pos, neg]), np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, n_hits. Only the text is an
    input of the score. A null text is empty; an empty text has the score of no match.
    Rows of null doc_id are not held out. Repeated rows give rows each. The lexicon goes
    to the tasks by broadcast; its size is bounded by `learn`. A very long text is scored whole,
    in time that grows with its length; an empty table gives no rows."""
    kept = docs.sparkSession.sparkContext.broadcast(lexicon.bare())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.value.bare()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            scores = [own.scored(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in scores], pa.float64()), pa.array([int(s >= 0.5) for s, _ in scores], pa.int32()), pa.array([n for _, n in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted", "n_hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, n_hits int")


def is_held_out(doc_id: int) -> bool:
    """The same rule for one id."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
