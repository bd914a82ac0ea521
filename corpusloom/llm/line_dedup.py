"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: by its number of words, then by its leading
words (a word with a digit counts as a variable field). In the leaf that it reaches, a
word is constant if a large enough share of the leaf's lines holds it at that place, else
it is a variable field; the constants make up the line's template. A share does not
change as the input grows, so neither do templates. Every line has templates at two
levels, as a leaf may hold a few kinds of lines or one; the line itself, with words that
hold a digit left open, is a third. Lines of which a template recurs in enough documents
are dropped, but for the first document that carries it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._filters import filter_of, passes
from corpusloom.llm._words import Words, by_text, mix
from corpusloom.session import cut

DEPTH = 4
MIN_DOCS = 5
#: Levels: words are constant from so many in 100 of the leaf's lines on, and of the words of
#: a template so many in 100 are constants at least. The rarer the words, the more of them.
LEVELS = ((10, 60), (50, 50))
#: Of the line itself, words without a digit.
FIXED_PERCENT = 50
_VARIABLE = np.uint64(0x2545F4914F6CDD1D)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """Lines with words: text, number in it, hash of the masked line, leaf, words."""

    def __init__(self, words: Words, depth: int):
        raw = words.raw
        breaks = np.flatnonzero(raw == 10)
        line = np.searchsorted(breaks, words.start)  # breaks before the word
        text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.first))
        digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        masked = np.where(digits[words.end] > digits[words.start], _VARIABLE, words.hash)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        self.at = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.at, [len(line)]]))
        self.text = text[self.at]
        self.number = line[self.at] - np.searchsorted(breaks, words.bounds[:-1])[self.text]
        place = np.arange(len(line)) - np.repeat(self.at, self.size)
        self.words = masked
        placed = mix(masked + place.astype(np.uint64) * _PLACE)
        count = self.size.astype(np.uint64)
        if len(self.at):
            self.hash = mix(np.add.reduceat(placed, self.at) + count)
            self.leaf = mix(np.add.reduceat(np.where(place < depth, placed, np.uint64(0)), self.at) + count * _PLACE)
        else:
            self.hash = self.leaf = np.zeros(0, np.uint64)


def _tokens(batches: Iterator[pa.RecordBatch], depth: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lines = Lines(words, depth)
        ok = np.flatnonzero(passes(bits, lines.leaf))
        if not len(ok):
            return None
        ids = [batch.column(c).slice(lo, hi - lo).take(pa.array(lines.text[ok])) for c in ("doc_id", "text_id")]
        held = [lines.words[a : a + n].tobytes() for a, n in zip(lines.at[ok].tolist(), lines.size[ok].tolist(), strict=True)]
        fixed = np.add.reduceat((lines.words != _VARIABLE).astype(np.int32), lines.at)[ok].astype(np.int32)
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(x) for x in (lines.number[ok].astype(np.int32), lines.leaf[ok].view(np.int64), lines.hash[ok].view(np.int64), lines.size[ok].astype(np.int32), fixed)), pa.array(held, pa.binary())], names=["doc_id", "text_id", "number", "leaf", "line", "size", "fixed", "held"])

    return by_text(batches, "text", make)


def _leaves(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(words, depth)
        return pa.RecordBatch.from_arrays([batch.column("text_id").slice(lo, hi - lo).take(pa.array(lines.text)), pa.array(lines.leaf.view(np.int64))], names=["text_id", "leaf"])

    return by_text(batches, "text", make)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a line that is no variable field: leaf, line, texts, place, word."""
    for batch in batches:
        held = batch.column("held").to_pylist()
        size = np.array([len(h) // 8 for h in held], np.int64)
        which = np.repeat(np.arange(len(held)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        word = np.frombuffer(b"".join(held), np.int64)
        fixed = word.view(np.uint64) != _VARIABLE
        keys = batch.select(["leaf", "line", "texts"]).take(pa.array(which[fixed]))
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(place[fixed].astype(np.int32)), pa.array(word[fixed])], names=["leaf", "line", "texts", "place", "word"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """Lines to drop: doc_id, text_id, numbers (an array of line numbers from 0)."""
    rows = _keyed(docs)
    leaves = rows.mapInArrow(lambda b: _leaves(b, depth), "text_id long, leaf long").groupBy("leaf", "text_id").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs).select("leaf")
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(leaves, "leaf"))
    lines = cut(rows.mapInArrow(lambda b: _tokens(b, depth, sent.value), "doc_id long, text_id long, number int, leaf long, line long, size int, fixed int, held binary"))

    in_texts = lines.groupBy("leaf", "line", "text_id").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("fixed").alias("fixed"), F.first("held").alias("held"))
    distinct = cut(in_texts.groupBy("leaf", "line").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_doc"), F.first("size").alias("size"), F.first("fixed").alias("fixed"), F.first("held").alias("held")))
    words = distinct.mapInArrow(_exploded, "leaf long, line long, texts long, place int, word long")
    # tables of totals are cut, so that a join with them is dealt anew and a hot key can be split
    totals = cut(distinct.groupBy("leaf").agg(F.sum("texts").alias("total")).where(F.col("total") >= min_docs))
    strong = words.groupBy("leaf", "place", "word").agg(F.sum("texts").alias("n")).join(totals, "leaf")
    strong = cut(strong.where(F.col("n") * 100 >= F.col("total") * LEVELS[0][0]).select("leaf", "place", "word", *((F.col("n") * 100 >= F.col("total") * share).alias(f"at{i}") for i, (share, _) in enumerate(LEVELS))))
    sums = [
        x for i in range(len(LEVELS)) for x in (
            F.bit_xor(F.when(F.col(f"at{i}"), F.xxhash64("place", "word"))).alias(f"shape{i}"), F.count_if(F.col(f"at{i}")).alias(f"n{i}"), F.count_if(F.col(f"at{i}") & (F.col("place") >= depth)).alias(f"later{i}"),
        )
    ]
    shaped = words.join(strong, ["leaf", "place", "word"]).groupBy("leaf", "line").agg(*sums)
    # beyond the leading words, which a whole leaf shares, a template has a constant at least
    at_level = lambda i, percent: F.when((F.col(f"n{i}") * 100 >= F.col("size") * percent) & ((F.col("size") <= depth) | (F.col(f"later{i}") > 0)), F.xxhash64("leaf", F.lit(i), f"shape{i}", f"n{i}"))
    found = F.array_compact(F.array(*(at_level(i, percent) for i, (_, percent) in enumerate(LEVELS))))
    template = distinct.select("leaf", "line", "size").join(shaped, ["leaf", "line"]).select("leaf", "line", F.explode(found).alias("template"))
    held = lines.select("doc_id", "text_id", "number", "leaf", "line").join(cut(template), ["leaf", "line"])
    by_text_ = held.groupBy("template", "text_id").agg(F.min("doc_id").alias("doc_id"))
    often = cut(by_text_.groupBy("template").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_doc")).where(F.col("texts") >= min_docs))
    whole = cut(distinct.where((F.col("texts") >= min_docs) & (F.col("fixed") * 100 >= F.col("size") * FIXED_PERCENT)).select("leaf", "line", "first_doc"))
    dropped = held.join(often, "template").select("doc_id", "text_id", "number", "first_doc")
    dropped = dropped.unionByName(lines.select("doc_id", "text_id", "number", "leaf", "line").join(whole, ["leaf", "line"]).select("doc_id", "text_id", "number", "first_doc"))
    return dropped.where("doc_id is null or doc_id <> first_doc").groupBy("doc_id", "text_id").agg(F.collect_set("number").alias("numbers"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """docs with the lines of recurring templates taken out of text, n_chars (where there is
    such a column) set anew, and n_lines and n_dropped added.

    A template recurs if its lines stand in min_docs different texts or more; exact copies
    of a document count once. Of the documents that carry it the one with the smallest
    doc_id keeps its lines. Blank lines are left alone, as are null and empty texts; rows
    of null doc_id are never first. Repeated rows are treated alike. Columns named n_lines
    or n_dropped are replaced. A text that loses all its lines becomes empty and stays.
    Very long texts are split once; an empty table gives an empty result.
    """
    dropped = recurring(docs, min_docs, depth)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row as one value: its columns may have any names
    whole = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    joined = whole.join(dropped, whole.doc.eqNullSafe(dropped.doc_id) & (whole.key == dropped.text_id), "left").select("row", "numbers")
    text = F.col("row.text").cast("string")
    split = joined.select("row", "numbers", F.split(text, "\n").alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("numbers"))
    cleaned = F.when(F.col("numbers").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    counts = [F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(n) for c, n in (("parts", "n_lines"), ("numbers", "n_dropped"))]
    rows = split.select(*(cleaned.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept), *counts)
    if "n_chars" in kept:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows


_levels = " UNION ALL ".join(f"SELECT leaf, place, word, {i} AS level, {percent} AS percent FROM shares WHERE n >= total * {share}" for i, (share, percent) in enumerate(LEVELS))
#: The same in DuckDB's SQL.
SQL = rf"""
WITH docs AS (SELECT doc_id, text, md5(text) AS tid, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, tid, i - 1 AS number, ls[i] AS line FROM (SELECT doc_id, tid, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
masked AS (SELECT doc_id, tid, number, list_transform(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM lines),
keyed AS (SELECT doc_id, tid, number, w, CAST(len(w) AS VARCHAR) || ' ' || array_to_string(w[1:{DEPTH}], ' ') AS leaf, array_to_string(w, ' ') AS line FROM masked WHERE len(w) > 0),
leaves AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT tid) >= {MIN_DOCS}),
known AS (SELECT * FROM keyed WHERE leaf IN (SELECT leaf FROM leaves)),
distinct_ AS (SELECT leaf, line, any_value(w) AS w, count(DISTINCT tid) AS texts, min(doc_id) AS first_, len(any_value(w)) AS size, len(list_filter(any_value(w), lambda x: x <> '<*>')) AS fixed FROM known GROUP BY leaf, line),
words AS (SELECT leaf, line, texts, i AS place, w[i] AS word FROM (SELECT leaf, line, texts, w, unnest(range(1, len(w) + 1)) AS i FROM distinct_) WHERE w[i] <> '<*>'),
totals AS (SELECT leaf, sum(texts) AS total FROM distinct_ GROUP BY leaf),
shares AS (SELECT leaf, place, word, sum(texts) * 100 AS n, any_value(total) AS total FROM words JOIN totals USING (leaf) GROUP BY leaf, place, word),
leveled AS ({_levels}),
shaped AS (SELECT leaf, line, level, percent, string_agg(CAST(place AS VARCHAR) || ':' || word, ' ' ORDER BY place) AS shape, count(*) AS n, count_if(place > {DEPTH}) AS later FROM words JOIN leveled USING (leaf, place, word) GROUP BY leaf, line, level, percent),
templates AS (SELECT s.leaf, s.line, s.leaf || '|' || s.level || '|' || s.shape AS template FROM shaped s JOIN distinct_ d ON s.leaf = d.leaf AND s.line = d.line WHERE n * 100 >= d.size * percent AND (d.size <= {DEPTH} OR later > 0)),
held AS (SELECT doc_id, tid, number, template FROM known k JOIN templates t ON k.leaf = t.leaf AND k.line = t.line),
often AS (SELECT template, min(doc_id) AS first_ FROM held GROUP BY template HAVING count(DISTINCT tid) >= {MIN_DOCS}),
whole AS (SELECT doc_id, number, first_ FROM known k JOIN distinct_ d ON k.leaf = d.leaf AND k.line = d.line WHERE texts >= {MIN_DOCS} AND fixed * 100 >= size * {FIXED_PERCENT}),
dropped AS (SELECT doc_id, number FROM held JOIN often USING (template) WHERE doc_id <> first_ UNION SELECT doc_id, number FROM whole WHERE doc_id <> first_),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(d.number) AS n_dropped, coalesce(string_agg(CASE WHEN d.number IS NULL THEN l.line END, chr(10) ORDER BY l.number), '') AS text
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.number = d.number GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, k.text FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
