"""Ranked lexical search over bit-sliced Bloom signatures.

A block holds documents of about as many terms: a row of bits for every place of their
Bloom signatures, a bit for every document. The rows of a term's places, and-ed, are a
bitmap of the documents that may hold it; another such bitmap says which may hold it twice,
three times and so on. So a term stands in a document at most so often, its weights summed
over these slices bound the document's score from above, and documents that can't reach
the k-th best score known are left out. All others are scored exactly from their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._filters import filter_of, id_hash, passes
from corpusloom.llm._words import Words, mix, slices
from corpusloom.operators.retrieval import Best
from corpusloom.session import cut

#: Bytes of ASCII that are no part of a term: all but digits and letters. Fixed values.
SPLITS = np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
#: A signature says whether a term stands in a document so often, at least.
LEVELS = (1, 2, 3, 4, 6, 9, 16)
HASHES = 4
#: Documents of a block, the bits that it has at most, and pairs of term and level held until blocks are made.
COLUMNS, BLOCK_BITS, PENDING = 1024, 1 << 25, 1 << 22
#: Terms counted in a task before counts are given, and terms of the items of a block.
COUNTED, ITEM_TERMS = 1 << 20, 1 << 17

_INDEX = "kind int, term long, n long, ids array<long>, lengths array<long>, width int, bits binary"


def terms(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; then text, hash and count of each distinct term of it."""
    words = Words(raw, bounds, SPLITS)
    length = np.diff(words.first)
    of = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((words.hash, of))
    h, of = words.hash[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
    return length, of[new], h[new], np.diff(np.append(new, len(h)))


def places(h: np.ndarray, level: np.ndarray, width: int) -> np.ndarray:
    """HASHES places (a row each) of every pair of a term and a level; width: a power of two."""
    a = mix(h + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = a >> np.uint64(32) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b & np.uint64(width - 1)).astype(np.int64) for i in range(HASHES)])


def _block(docs: list[tuple[int, int, np.ndarray, np.ndarray]], width: int) -> tuple:
    bits = np.zeros((width, -(-len(docs) // 8) * 8), bool)
    for c, (_, _, h, level) in enumerate(docs):
        bits[places(h, level, width).ravel(), c] = True
    return 0, None, None, [d[0] for d in docs], [d[1] for d in docs], width, np.packbits(bits, axis=1).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _counts(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none, size = pa.nulls, len(h)
    columns = [pa.array(np.ones(size, np.int32)), pa.array(h.view(np.int64)), pa.array(n), none(size, pa.list_(pa.int64())), none(size, pa.list_(pa.int64())), none(size, pa.int32()), none(size, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _INDEX.split(", ")])


def _merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(h, return_inverse=True)
    return known, np.bincount(at, n, len(known)).astype(np.int64)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (kind 0), the documents of terms (1), and documents with terms and all terms (2)."""
    waiting: dict[int, list] = {}
    pending = docs = total = held = 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for lo, _, raw, bounds in slices(batch.column("text")):
            length, of, h, tf = terms(raw, bounds)
            docs, total = docs + int((length > 0).sum()), total + int(length.sum())
            parts.append(_merged(h, np.ones(len(h))))
            held += len(parts[-1][0])
            if held > COUNTED:
                parts = [_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held > COUNTED // 2:
                    yield _counts(*parts[0])
                    parts, held = [], 0
            which, level = np.nonzero(tf[:, None] >= np.array(LEVELS)[None, :])
            pair_bounds = np.searchsorted(of[which], np.arange(len(length) + 1))
            ids = batch.column("doc_id")
            for i in np.flatnonzero(length).tolist():
                doc_id = ids[lo + i].as_py()
                if doc_id is None:
                    continue
                a, b = pair_bounds[i], pair_bounds[i + 1]
                width = 8 << int(b - a - 1).bit_length()
                same = waiting.setdefault(width, [])
                same.append((doc_id, int(length[i]), h[which[a:b]], level[a:b]))
                pending += b - a
                if len(same) >= max(8, min(COLUMNS, BLOCK_BITS // width)):
                    pending -= sum(len(d[2]) for d in same)
                    yield _batch([_block(waiting.pop(width), width)])
            if pending > PENDING:
                for width, same in waiting.items():
                    yield _batch([_block(same, width)])
                waiting, pending = {}, 0
    for width, same in waiting.items():
        yield _batch([_block(same, width)])
    if parts:
        yield _counts(*_merged(*(np.concatenate(x) for x in zip(*parts, strict=True))))
    yield _batch([(2, docs, total, None, None, None, None)])


@dataclass
class Index:
    """blocks: ids, lengths, width, bits; frequency: term, df; documents with terms, all terms."""

    blocks: DataFrame
    frequency: DataFrame
    documents: int
    total: int


def build(docs: DataFrame) -> Index:
    """Signatures of docs (doc_id, text) in one pass; what it makes is kept in the shared
    folder. Null texts have no terms; rows without doc_id are counted, but not found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = cut(rows.mapInArrow(_indexed, _INDEX))
    frequency = made.where("kind = 1").groupBy("term").agg(F.sum("n").alias("df"))
    n, total = made.where("kind = 2").agg(F.sum("term"), F.sum("n")).first()
    return Index(made.where("kind = 0").select("ids", "lengths", "width", "bits"), frequency, n or 0, total or 0)


class Asked:
    """The items of a block: their terms, and what each counts for."""

    def __init__(self, found: pa.Table, df: dict[int, int], documents: int, total: int):
        self.ids = found.column("item_id").to_pylist()
        lists = [np.array(x, np.int64).view(np.uint64) for x in found.column("terms").to_pylist()]
        self.known = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]))
        self.documents, self.total = documents, total
        of_term = [df.get(int(h), 0) for h in self.known.view(np.int64)]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in of_term], np.int64)
        self.items = []  # numbers of terms that some document holds, and weight times repeats
        for own in lists:
            at, times = np.unique(np.searchsorted(self.known, own), return_counts=True)
            held = np.array([of_term[i] > 0 for i in at], bool)
            self.items.append((at[held], (weight[at] * times)[held]))

    def part(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What tf occurrences count for in documents of these lengths, before weights."""
        m = 25 + 75 * lengths * self.documents // max(1, self.total)
        return np.where(tf > 0, 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1), 0)

    def bounds(self, block: dict) -> np.ndarray:
        """A row for each item: no document of the block scores more."""
        lengths = np.array(block["lengths"], np.int64)
        bits = np.frombuffer(block["bits"], np.uint8).reshape(block["width"], -1)
        out = np.zeros((len(self.items), len(lengths)))
        present, before = None, np.zeros(len(lengths), np.int64)
        for level, up_to in enumerate([*LEVELS[1:], None]):
            at = places(self.known, np.full(len(self.known), level), block["width"])
            rows = np.bitwise_and.reduce(bits[at], axis=0)
            present = rows if present is None else rows & present
            if not present.any():
                break
            most = lengths if up_to is None else np.minimum(up_to - 1, lengths)
            worth = self.part(most, lengths)
            each = np.unpackbits(present, axis=1, count=len(lengths)).astype(np.float32)
            for i, (own, weight) in enumerate(self.items):
                out[i] += (weight.astype(np.float64) @ each[own]) * (worth - before)
            before = worth
        return out * (1 + 1e-9)

    def scores(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Exact scores: a row for each item, a column for each text."""
        length, of, h, tf = terms(raw, bounds)
        out = np.zeros((len(self.items), len(length)), np.int64)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        worth = self.part(tf, length[of])[hit]
        of, at = of[hit], at[hit]
        starts = np.searchsorted(of, np.arange(len(length) + 1))
        flat = np.concatenate([np.zeros(0, np.int64), *(own for own, _ in self.items)])
        weight = np.concatenate([np.zeros(0, np.int64), *(w for _, w in self.items)])
        ends = np.cumsum([len(own) for own, _ in self.items])
        full = np.zeros(len(self.known), np.int64)
        for d in range(len(length)):
            a, b = starts[d], starts[d + 1]
            if a < b:
                full[at[a:b]] = worth[a:b]
                sums = np.concatenate([[0], np.cumsum(full[flat] * weight)])
                out[:, d] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                full[at[a:b]] = 0
        return out


def search(index: Index, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: of every item (item_id, text) the k documents of the
    highest score above 0, the smaller doc_id first on ties. `index` is that of docs.

    Items go in blocks of about 128 k terms. A block takes two passes over the signatures
    (documents with the best bounds; then all whose bound reaches the k-th best score found
    among these) and two over the texts (exact scores of either). What is to be scored goes
    to the tasks as a filter of 8 MB, which may let other documents pass: they are scored
    exactly like the rest. Nothing is shuffled but counts and the best k of each task.

    Terms are compared as 64-bit hashes. Null texts have no terms, items without any find
    nothing. Rows that repeat a doc_id are documents each; rows without one are counted, but
    not found. Of items that repeat an item_id the smallest text counts; items without take
    no part. Empty tables give no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    asked = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    asked = cut(asked.mapInArrow(_terms, "item_id long, terms array<long>").where("size(terms) > 0"))
    blocks = max(1, -(-(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // ITEM_TERMS))
    found, shape = None, "item_id long, doc_id long, score double"
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = own.select(F.explode("terms").alias("term")).distinct()
        df = {r["term"]: r["df"] for r in index.frequency.join(F.broadcast(held), "term").collect()}
        sent = spark.sparkContext.broadcast((own.orderBy("item_id").toArrow(), df, index.documents, index.total))

        def likeliest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of = Asked(*sent.value)
            best = Best(len(of.ids), k)
            for batch in batches:
                for one in range(batch.num_rows):
                    made = batch.slice(one, 1).to_pylist()[0]
                    bounds = of.bounds(made)
                    best.add(np.where(bounds > 0, bounds, -np.inf), np.array(made["ids"], np.int64))
            yield best.rows(of.ids, ["item_id", "doc_id", "score"])

        def scored(batches: Iterator[pa.RecordBatch], bits, sent=sent) -> Iterator[pa.RecordBatch]:
            of, own = Asked(*sent.value), bits.value
            best = Best(len(of.ids), k)
            for batch in batches:
                part = batch.filter(pa.array(passes(own, batch.column("h").to_numpy())))
                for lo, hi, raw, bounds in slices(part.column("text")):
                    scores = of.scores(raw, bounds).astype(np.float64)
                    best.add(np.where(scores > 0, scores, -np.inf), part.column("doc_id").to_numpy()[lo:hi])
            yield best.rows(of.ids, ["item_id", "doc_id", "score"])

        def exact(ids: DataFrame) -> DataFrame:
            bits = spark.sparkContext.broadcast(filter_of(ids.select(id_hash("doc_id").alias("h")), "h"))
            got = rows.withColumn("h", id_hash("doc_id")).mapInArrow(lambda batches: scored(batches, bits), shape)
            order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
            return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        first = index.blocks.mapInArrow(likeliest, shape)
        order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
        seeds = exact(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        least = {r["item_id"]: r["score"] for r in seeds.where(F.col("rank") == k).collect()}
        floor = spark.sparkContext.broadcast(least)

        def reaching(batches: Iterator[pa.RecordBatch], sent=sent, floor=floor) -> Iterator[pa.RecordBatch]:
            of = Asked(*sent.value)
            least = np.array([floor.value.get(i, 1.0) for i in of.ids])
            for batch in batches:
                for one in range(batch.num_rows):
                    made = batch.slice(one, 1).to_pylist()[0]
                    reach = (of.bounds(made) >= least[:, None]).any(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(made["ids"], np.int64)[reach])], names=["doc_id"])

        out = exact(index.blocks.mapInArrow(reaching, "doc_id long"))
        out = out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long").alias("score"))
        found = out if found is None else found.unionByName(out)
    return found


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, bounds in slices(batch.column("text")):
            words = Words(raw, bounds, SPLITS)
            lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(words.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, hi - lo), lists], names=["item_id", "terms"])


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""WITH texts AS (SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM texts WHERE len(terms) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held CROSS JOIN stats GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term) CROSS JOIN stats GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10"""
