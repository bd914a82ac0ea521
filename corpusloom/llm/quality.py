"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text places a document on a line; ordered thresholds on
that line separate the grades: P(grade > j) = sigmoid(w x - t_j) with t_0 < t_1 < ... .
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._words import Words, by_text, mix

DIMENSIONS = 1 << 11


def features(words: Words) -> np.ndarray:
    """A row for each text: hashed runs of three bytes and hashed shapes of words, by the
    logarithm of their counts, at length 1; then the share of distinct words, and a one."""
    n = len(words.bounds) - 1
    raw, at = words.raw, np.repeat(np.arange(n), np.diff(words.bounds))
    out = np.zeros((n, DIMENSIONS), np.float32)
    half = DIMENSIONS // 2
    counts = np.zeros(n * DIMENSIONS, np.int64)
    if len(raw) > 2:
        grams = raw[:-2].astype(np.uint32) | raw[1:-1].astype(np.uint32) << 8 | raw[2:].astype(np.uint32) << 16
        code = ((grams * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64) % half
        whole = at[2:] == at[:-2]
        counts += np.bincount((at[:-2] * DIMENSIONS + code)[whole], minlength=n * DIMENSIONS)
    if len(words.start):
        of = np.repeat(np.arange(n), np.diff(words.first))
        head, tail = raw[words.start].astype(np.uint64), raw[words.end - 1].astype(np.uint64)
        size = np.minimum(words.end - words.start, 24).astype(np.uint64)
        shape = (mix(head | tail << np.uint64(8) | size << np.uint64(16)) % np.uint64(half)).astype(np.int64) + half
        counts += np.bincount(of * DIMENSIONS + shape, minlength=n * DIMENSIONS)
    out[:] = np.log1p(counts).reshape(n, DIMENSIONS)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)
    count = np.diff(words.first)
    distinct = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    return np.column_stack([out, distinct / np.maximum(count, 1), np.minimum(count, 50) / 50]).astype(np.float32)


@dataclass
class Ordinal:
    """weights over features, ordered thresholds between grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ self.weights[:, None] - self.thresholds[None, :], -30, 30)))


def fit(x: np.ndarray, grade: np.ndarray, n_grades: int, steps: int = 400, ridge: float = 1e-5, rate: float = 0.05) -> Ordinal:
    """Maximum likelihood by Adam on all rows at once. Thresholds are a first one and
    positive steps, so they stay in order. Rows of unlike grades weigh alike by the root of
    their share, so that the rarer ones count."""
    n, d = x.shape
    share = np.bincount(grade, minlength=n_grades) / n
    weight = np.where(share[grade] > 0, 1 / np.sqrt(n_grades * np.maximum(share[grade], 1e-9)), 0)
    weight /= weight.sum()
    above = np.concatenate([np.ones((1,)), np.cumsum(share[::-1])[::-1][1:]])[1:]
    start = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1 - 1e-3))
    p = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))
        score = x @ p[:d].astype(np.float32)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -30, 30)))
        full = np.column_stack([np.ones(n), tail, np.zeros(n)])  # P(grade >= j)
        chance = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-9)
        slope = full * (1 - full)  # of P(grade >= j) in the score
        g_score = -(slope[rows, grade] - slope[rows, grade + 1]) / chance * weight
        g_t = np.zeros(n_grades + 1)
        np.add.at(g_t, grade, slope[rows, grade] / chance * weight)
        np.add.at(g_t, grade + 1, -slope[rows, grade + 1] / chance * weight)
        g_t = g_t[1:n_grades]
        tail_sums = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate([x.T @ g_score.astype(np.float32) + ridge * p[:d], [tail_sums[0]], tail_sums[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(p[:d], np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])])))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for low quality, 1 for good but toxic, 2 for good and clean. The ratings
    at hand are two labels of two values, put together here to three grades in order. Of
    labels that repeat a doc_id the lowest grade counts; a null toxic counts as clean; rows
    without doc_id or quality are left out."""
    usable = labels.where("doc_id is not null and quality in (0, 1)")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = 4_000) -> Ordinal | None:
    """The model from rated documents (doc_id, grade from 0 up). max_rows bounds the rated
    rows fitted on, about: a larger table is thinned by the MD5 of doc_id. None if fewer
    than two grades are there."""
    ratings = ratings.where("grade >= 0")
    n = ratings.count()
    thin = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32 < max_rows / max(n, 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ratings.where(thin), "doc_id").select("text", "grade")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(words).astype(np.float16)
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column("grade").slice(lo, hi - lo).cast(pa.int32())], names=["x", "grade"])

        return by_text(batches, "text", row)

    got = rows.mapInArrow(made, "x binary, grade int").toArrow()
    grade = got.column("grade").to_numpy()
    levels = int(grade.max()) + 1 if len(grade) else 0
    if len(np.unique(grade)) < 2:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(grade), -1).astype(np.float32)
    order = np.lexsort((*x[:, :4].T, grade))  # rows come in any order; sums shall not
    return fit(x[order], grade[order], levels)


def classify(docs: DataFrame, model: Ordinal | None, at_least: int = 1, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, expected_grade, tail (chance of grade `at_least` or more),
    keep (tail reaches the threshold). A null text is empty; an empty text is scored like
    any other and, as it holds nothing, not kept. Without a model all is kept, with nulls.
    Rows of null doc_id and repeated rows get a row each. Very long texts are scored whole; an empty
    table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)

        def row(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            tails = own.tails(features(words))
            tail = tails[:, at_least - 1]
            keep = (tail >= threshold) & (np.diff(words.first) > 0)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(keep)], names=["doc_id", "expected_grade", "tail", "keep"])

        return by_text(batches, "text", row)

    return rows.mapInArrow(scored, "doc_id long, expected_grade double, tail double, keep boolean")


def select_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier, trained on the labelled ones, keeps, with all
    their columns as they are. Rows are judged where they stand: nothing is shuffled.

    A null text, or one without words, holds nothing and isn't kept. Rows are judged by their
    text alone, so repeated rows, and rows without doc_id, fare alike. If the labels give fewer
    than two grades there is no model, and every row stays, those without words included. Very
    long texts are judged whole; an empty table gives an empty result."""
    model = train(docs, graded(labels))
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)

        def row(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = (own.tails(features(words))[:, 0] >= threshold) & (np.diff(words.first) > 0)
            return batch.slice(lo, hi - lo).filter(pa.array(keep))

        return by_text(batches, "text", row)

    return docs.mapInArrow(kept, docs.schema)
