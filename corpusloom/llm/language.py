"""Language of a text by string kernels.

A text is the set of its runs of two to four bytes (a blended spectrum, by presence). The
kernel of two texts is the number of runs in both over the root of the product of their
sizes. Some learned texts are landmarks (Nystroem): kernel ridge regression of every
language against the rest has a weight for each landmark, so a batch of texts is scored by
two matrix products: presence by landmarks, then kernel rows by weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._words import slices
from corpusloom.session import cut

RUNS = (2, 3, 4)
#: Slots of the table that finds a run's number, as a power of two.
_SLOT_BITS = 20
#: Texts of one matrix product.
_ROWS = 256
UNKNOWN = "und"


def folded(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts with a blank before, between and after them, and the places of these
    blanks. A-Z go to lower case; other ASCII that is no letter is blank."""
    n = len(bounds) - 1
    low = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    low[(raw < 128) & ((low < 97) | (low > 122))] = 32
    out = np.full(len(raw) + n + 1, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(bounds)) + 1] = low
    return out, bounds + np.arange(n + 1)


def runs(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the text and the code (run, and length above it) of every run."""
    padded, blanks = folded(raw, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(blanks))
    last = blanks[1:][owner]
    for length in RUNS:
        n = max(0, len(padded) - length + 1)
        code = np.full(n, length, np.uint64)
        for i in range(length):
            code = code << np.uint64(8) | padded[i : n + i]
        whole = np.arange(n) + (length - 1) <= last[:n] if n <= len(last) else np.zeros(0, bool)
        yield owner[:n][whole], code[whole]


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


@dataclass
class Kernel:
    """codes: the runs of the space; held: by run and landmark, 1 over the root of the
    landmark's size where it holds the run."""

    codes: np.ndarray
    held: np.ndarray

    def __post_init__(self) -> None:
        self.table = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.table[_slot(self.codes)] = np.arange(len(self.codes))

    def rows(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The kernel of each text with each landmark."""
        n = len(bounds) - 1
        out = np.zeros((n, self.held.shape[1]), np.float32)
        if not len(self.codes):
            return out
        for lo in range(0, n, _ROWS):
            hi = min(n, lo + _ROWS)
            present = np.zeros((hi - lo, len(self.codes)), np.float32)
            for owner, code in runs(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]):
                at = self.table[_slot(code)]
                known = (at >= 0) & (self.codes[at] == code)
                present[owner[known], at[known]] = 1
            out[lo:hi] = present @ self.held / np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return out


def kernel_of(texts: pa.Array, most_runs: int) -> Kernel:
    """The kernel with these texts as landmarks. Its space are the runs that two of them hold
    (all runs if there are fewer texts), `most_runs` of them at most, those that most hold;
    of runs that share a slot of the table the one that more hold."""
    pairs = []
    first = 0
    for lo, hi, raw, bounds in slices(texts):
        for owner, code in runs(raw, bounds):
            pairs.append(np.unique(np.column_stack([code, (owner + lo).astype(np.uint64)]), axis=0))
        first = hi
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
    codes, inverse, times = np.unique(both[:, 0], return_inverse=True, return_counts=True)
    order = np.lexsort((codes, -times))
    order = order[times[order] >= min(2, first)][:most_runs]
    order = order[np.sort(np.unique(_slot(codes[order]), return_index=True)[1])]
    kept = codes[order]
    number = np.full(len(codes), -1)
    number[order] = np.arange(len(kept))
    held = np.zeros((len(kept), first), np.float32)
    of = number[inverse]
    held[of[of >= 0], both[of >= 0, 1].astype(np.int64)] = 1
    return Kernel(kept, held / np.sqrt(np.maximum(held.sum(axis=0), 1)))


@dataclass
class Model:
    """languages in code point order; weights: by landmark (the last row: a constant) and
    language."""

    languages: list[str]
    kernel: Kernel
    weights: np.ndarray

    def scores(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.kernel.rows(raw, bounds).astype(np.float64) @ self.weights[:-1] + self.weights[-1]


def fit(kernel: Kernel, rows: np.ndarray, of: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """Ridge regression of each language against the rest on kernel rows, with the kernel of
    the landmarks as penalty; languages weigh alike by the root of their share."""
    x = np.column_stack([rows.astype(np.float64), np.ones(len(rows))])
    share = np.bincount(of, minlength=n) / len(of)
    weight = 1 / np.sqrt(share[of])
    weight *= len(of) / weight.sum()
    between = kernel.held.T.astype(np.float64) @ kernel.held
    penalty = np.zeros((x.shape[1], x.shape[1]))
    penalty[:-1, :-1] = between
    target = np.eye(n)[of]
    return np.linalg.solve(x.T @ (x * weight[:, None]) + ridge * penalty + 1e-6 * np.eye(x.shape[1]), x.T @ (target * weight[:, None]))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning; not for a null doc_id, which is never
    learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, max_rows: int = 4_000, landmarks: int = 256, landmark_bytes: int = 8_192, most_runs: int = 1 << 16, most_languages: int = 512, ridge: float = 0.3) -> Model | None:
    """The model from docs (doc_id, text, lang), those that aren't held out. None if no row has
    a language and a letter.

    Bounds of what is fitted on, all of them parameters: about max_rows rows, as many of each
    language, by the MD5 of doc_id; the most_languages languages with most rows; landmarks
    texts of landmark_bytes bytes at most as landmarks, as many of each language; most_runs
    runs. Whole texts are learned from. Rows that repeat a doc_id are learned from together."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages)
    number = {r["lang"]: r["count"] for r in counts.collect()}
    if not number:
        return None
    rates = docs.sparkSession.createDataFrame([(x, max_rows / len(number) / n) for x, n in number.items()], "lang string, rate double")
    md5 = F.md5(F.col("doc_id").cast("string"))
    thin = F.conv(F.substring(md5, 1, 8), 16, 10).cast("double") / 2.0**32 < F.col("rate")
    sample = cut(rows.join(F.broadcast(rates), "lang").where(thin).select("lang", "text", md5.alias("md5")))
    small = sample.where(F.octet_length("text") <= landmark_bytes)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("md5", "text"))
    chosen = small.withColumn("turn", turn).orderBy("turn", "lang").limit(landmarks).toArrow()
    kernel = kernel_of(chosen.column("text").combine_chunks(), most_runs)
    sent = docs.sparkSession.sparkContext.broadcast((kernel.codes, kernel.held))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Kernel(*sent.value)
        for batch in batches:
            for lo, hi, raw, bounds in slices(batch.column("text")):
                x = own.rows(raw, bounds)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sample.select("lang", "text").mapInArrow(made, "lang string, x binary").toArrow()
    taken = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True))  # rows come in any order; sums shall not
    languages = sorted({lang for lang, _ in taken})
    if not languages:
        return None
    x = np.frombuffer(b"".join(row for _, row in taken), np.float32).reshape(len(taken), kernel.held.shape[1])
    of = np.array([languages.index(lang) for lang, _ in taken])
    return Model(languages, kernel, fit(kernel, x, of, len(languages), ridge))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    The regression of the text's language, cut to 0 to 1, is the score; of equal ones the
    first language by code point wins. Null texts and texts without a letter are `und` with a
    score of 1; without a model all texts are, those with letters at a score of 0. Only text
    is looked at, so repeated rows and rows without doc_id fare as any; an empty table gives
    no rows. Whole texts are scored, in slices of about 2 MB or one longer text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), has_letter(F.col("text")).alias("letter"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.when(F.col("letter"), 0.0).otherwise(1.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.kernel.codes, model.kernel.held, model.weights))
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, codes, held, weights = sent.value
        own = Model(languages, Kernel(codes, held), weights)
        said = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            for lo, hi, raw, bounds in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                scores, letter = own.scores(raw, bounds), part.column("letter").to_numpy(zero_copy_only=False)
                best = np.where(letter, scores.argmax(axis=1), len(languages))
                value = np.where(letter, np.clip(scores.max(axis=1), 0, 1), 1.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(said[best], pa.string()), pa.array(value)], names=names)

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double")
