"""Keyword and vector retrieval: BM25, nearest vectors, boosts and fusion.

Queries are a query set: they go to the tasks in blocks of bounded size and meet all rows
where these stand, so that neither postings nor pairs of documents and queries are
shuffled. A task keeps the best k rows of each query and gives these alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.batches import pieces
from corpusloom.operators.impacts import Best, Impacts, Postings, _runs
from corpusloom.session import cut, spread

#: Weights of journal ranks 1 to 7. Fixed values.
JOURNAL_WEIGHTS = (1.5, 1.4, 1.3, 1.2, 1.15, 1.05, 1.0)
#: One pass over vectors serves so many components of queries (8 bytes each in a task),
QUERY_VALUES = 1 << 23
#: which meet rows in blocks of so many queries.
QUERY_BLOCK = 4096
TEXT_QUERY_BLOCK = 256
#: One pass over texts serves so many terms of queries (16 bytes each in a task).
QUERY_TERMS = 1 << 22
#: Documents are scored in pieces of so many.
PIECE = 1024
#: So many words, the most frequent, take their weights along to the tasks (16 bytes each).
FREQUENT_WORDS = 1 << 18
#: Rows are compared with all queries of a block in pieces of so many scores.
_SCORES = 1 << 21
#: Words of documents meet the chunks of a block in portions of so many sums.
_OVERLAPS = 1 << 18


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, dl: a row for each term of a document."""
    held = docs.select(key, tokens(text).alias("terms")).select(key, F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    return held.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents and avg_dl, the mean number of terms (0 for an empty corpus)."""
    return docs.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.size(tokens(text))), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_dl"))


def idf_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Smoothed ln(n / (df + 1)) of every term, which may be 0 or less."""
    df = document_frequency(postings(docs, key, text))
    return df.crossJoin(corpus_stats(docs, text).select("n")).select("term", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))


def ranked(df: DataFrame, by: str, score: str, tie: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """Row numbers by descending score within `by`; the smaller tie first; k at most."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie)))
    return out if k is None else out.where(F.col(name) <= k)


def _query_blocks(asked: DataFrame, query: str, size: int) -> Iterator[list]:
    """The rows of asked, which is kept, in blocks of about `size`."""
    n = max(1, -(-asked.count() // size))
    for block in range(n):
        yield (asked if n == 1 else asked.where(F.pmod(F.xxhash64(query), F.lit(n)) == block)).collect()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a list column."""
    size = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False)


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query_text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, key, score: of every query the k best documents that share a term with it. A
    term that a query repeats counts as often; rows of one query count as one text. Ties go
    to the smaller key.

    Texts are read once for some millions of the queries' terms: what a document holds of
    them is kept, which gives the counts, and is scored for all blocks of queries in one
    more pass, pruned by bounds (see impacts). Terms are compared as 64-bit hashes. Null
    texts have no terms; documents or queries without a key take no part."""
    spark = docs.sparkSession
    hashed = lambda c: F.transform(tokens(c), lambda t: F.xxhash64(t))
    rows = docs.select(F.col(key).cast("long").alias(key), hashed(text).alias("h")).where(F.col(key).isNotNull())
    terms = queries.where(F.col(query).isNotNull()).select(F.col(query).cast("long").alias(query), F.explode(hashed(query_text)).alias("h"))
    asked = cut(terms.groupBy(query, "h").agg(F.count("*").alias("times")))
    names, found = [query, key, "score"], None
    parts = max(1, -(-asked.count() // QUERY_TERMS))
    for part in range(parts):
        pairs = asked.where(F.pmod(F.xxhash64(query), F.lit(parts)) == part).toArrow()
        known, term = np.unique(pairs.column("h").to_numpy(), return_inverse=True)
        ids, of = np.unique(pairs.column(query).to_numpy(), return_inverse=True)
        order = np.lexsort((term, of))
        term, of, times = term[order].astype(np.int32), of[order].astype(np.int32), pairs.column("times").to_numpy()[order].astype(np.int32)
        held = cut(_held(rows, spark.sparkContext.broadcast(known), key))
        each = held.select("dl", F.explode(F.concat("term", F.array(F.lit(-1)))).alias("term"))  # -1 stands once in each document
        counted = each.groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).toArrow()
        which, many = counted.column("term").to_numpy(), counted.column("n").to_numpy()
        df = np.zeros(len(known))
        df[which[which >= 0]] = many[which >= 0]
        n, length = int(many[which < 0].sum()), int(counted.column("length").to_numpy()[which < 0].sum())
        gain = times * np.log((n - df + 0.5) / (df + 0.5) + 1)[term]
        sent = spark.sparkContext.broadcast((ids, of, term, gain, max(length / max(n, 1), 1e-9)))

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, of, term, gain, avg = sent.value
            blocks = []
            for lo in range(0, len(ids), TEXT_QUERY_BLOCK):
                x, y = np.searchsorted(of, [lo, lo + TEXT_QUERY_BLOCK])
                blocks.append((ids[lo : lo + TEXT_QUERY_BLOCK], Impacts(of[x:y] - lo, term[x:y], gain[x:y], min(TEXT_QUERY_BLOCK, len(ids) - lo), k)))
            for batch in batches:
                for lo in range(0, batch.num_rows, PIECE):
                    own = batch.slice(lo, PIECE)
                    row, which = _flat(own.column("term"))
                    tf, dl = own.column("tf").flatten().to_numpy(), own.column("dl").to_numpy()
                    piece = Postings(own.column(key).to_numpy(), row, which, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avg)))
                    for _, block in blocks:
                        block.add(piece)
            yield from (block.best.rows(own, names) for own, block in blocks)

        out = held.where("size(term) > 0").mapInArrow(scored, f"{query} long, {key} long, score double")
        found = out if found is None else found.unionByName(out)
    return ranked(found, query, "score", key, k).drop("rank")


def _held(rows: DataFrame, known, key: str) -> DataFrame:
    """key, dl, term, tf: of every document its length and, of the known terms (a broadcast,
    in order), those that it holds, by place, and how often. Documents are looked at in pieces
    of a batch, so that a task's memory grows with none of its batches."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for batch in batches:
            for own in pieces(batch, "h"):
                row, h = _flat(own.column("h"))
                at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
                ok = terms[at] == h if len(terms) else np.zeros(len(h), bool)
                each, tf = np.unique(row[ok] * max(1, len(terms)) + at[ok], return_counts=True)
                which, term = np.divmod(each, max(1, len(terms)))
                ends = pa.array(np.searchsorted(which, np.arange(own.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([own.column(key), pa.array(np.bincount(row, minlength=own.num_rows), pa.int64()), *lists], names=[key, "dl", "term", "tf"])

    return rows.mapInArrow(matched, f"{key} long, dl long, term array<int>, tf array<int>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query, key, similarity: the k rows with the largest dot product for every query. Rows or
    queries without a vector or a key take no part; ties go to the smaller key. The vectors
    are read once for some millions of the queries' components."""
    asked = queries.where(F.col(query_vector).isNotNull() & F.col(query).isNotNull()).select(F.col(query).cast("long").alias(query), F.col(query_vector).cast("array<double>").alias("v"))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    asked, names, found = cut(asked), [query, key, "similarity"], None
    wide = asked.agg(F.max(F.size("v"))).first()[0] or 1
    for block in _query_blocks(asked, query, max(1, QUERY_VALUES // wide)):
        sent = vectors.sparkSession.sparkContext.broadcast(([r[query] for r in block], np.array([r["v"] for r in block], np.float64)))

        def compared(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            starts = range(0, len(ids), QUERY_BLOCK)
            best = [Best(min(QUERY_BLOCK, len(ids) - x), k) for x in starts]
            step = max(1, _SCORES // max(1, min(QUERY_BLOCK, len(ids))))
            for batch in batches:
                for lo in range(0, batch.num_rows if ids else 0, step):
                    part = batch.slice(lo, step)
                    m, keys = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1).T, part.column(key).to_numpy()
                    for x, own in zip(starts, best, strict=True):
                        own.add(q[x : x + QUERY_BLOCK] @ m, keys)
            yield from (own.rows(ids[x : x + QUERY_BLOCK], names) for x, own in zip(starts, best, strict=True))

        out = rows.mapInArrow(compared, f"{query} long, {key} long, similarity double")
        found = out if found is None else found.unionByName(out)
    return ranked(found, query, "similarity", key, k)


def citation_boost(citations: Column, factor: float = 0.1, most: float = 1.3) -> Column:
    """min(1 + factor * log10(c + 1), most); 1 for no citations."""
    c = F.coalesce(citations, F.lit(0))
    return F.when(c > 0, F.least(1 + factor * F.log10(c + 1), F.lit(most))).otherwise(F.lit(1.0))


def journal_weight(rank: Column) -> Column:
    weights = F.array(*map(F.lit, JOURNAL_WEIGHTS))
    return F.when(rank.between(1, len(JOURNAL_WEIGHTS)), F.element_at(weights, rank.cast("int"))).otherwise(F.lit(1.0))


def tier_weight(tier: Column) -> Column:
    return F.when(tier == 1, F.lit(0.9)).otherwise(F.lit(0.8))


def journal_search(pool: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", boost: bool = True) -> DataFrame:
    """Of a pool (query, key, similarity, journal_rank), 3 k of which enter, the k best by
    similarity times the weight of the journal."""
    pool = ranked(pool, query, "similarity", key, 3 * k)
    score = F.col("similarity") * (journal_weight(F.col("journal_rank")) if boost else F.lit(1.0))
    return ranked(pool.withColumn("score", score), query, "score", key, k)


def boosted_search(pool: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", boost_before_cut: bool = False) -> DataFrame:
    """The k best of a pool (query, key, similarity, tier, citations), their similarity times
    tier and citation weights, as a share of the best one. By default the boosts come after
    the cut and reorder within it."""
    pool = pool.withColumn("boosted", F.col("similarity") * tier_weight(F.col("tier")) * citation_boost(F.col("citations")))
    cut_by = "boosted" if boost_before_cut else "similarity"
    kept = ranked(pool, query, cut_by, key, k)
    top = F.max("boosted").over(Window.partitionBy(query))
    return ranked(kept.withColumn("score", F.when(top > 0, F.col("boosted") / top).otherwise(F.col("boosted"))), query, "score", key)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, query: str = "query_id", source: str = "source", weight: float = 0.3) -> DataFrame:
    """Hybrid ranking: (query, source, score) of both sides, the best of a source on each
    side, as shares of the best of the query, added up by weight; k best."""

    def side(df: DataFrame, name: str) -> DataFrame:
        best = df.groupBy(query, source).agg(F.max("score").alias(name))
        return best.withColumn(name, F.col(name) / F.max(name).over(Window.partitionBy(query)))

    both = side(semantic, "semantic").join(side(keyword, "keyword"), [query, source], "full_outer").fillna(0.0, ["semantic", "keyword"])
    return ranked(both.withColumn("score", F.col("semantic") * (1 - weight) + F.col("keyword") * weight), query, "score", source, k)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, source: str = "source", texts: DataFrame | None = None) -> DataFrame:
    """query_id, source, score, rank: keyword and vector search of every query, fused. Both
    sides search the documents given and no others.
    docs: doc_id, text, source, tier, citations; vectors: vec_id (= doc_id), embedding;
    queries: query_id, query_text, query_vector; texts: doc_id, text of the same documents,
    where docs are joined from several tables: so texts are read where they stand, and none
    is sent through that join."""
    facts, queries = cut(docs.select("doc_id", source, "tier", "citations")), cut(queries)
    known = vectors.join(facts.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    pool = nearest(known, queries, 2 * k).drop("rank").join(facts, F.col("vec_id") == F.col("doc_id"))
    semantic = boosted_search(pool, 2 * k, key="doc_id").select("query_id", source, "score")
    words = bm25(docs if texts is None else texts, queries, 2 * k).join(facts, "doc_id").select("query_id", source, "score")
    return fuse(semantic, words, k, source=source)


def overlap_passages(docs: DataFrame, chunks: DataFrame, n: int = 3, key: str = "doc_id", chunk: str = "chunk_id", text: str = "text", chunk_text: str = "chunk_text") -> DataFrame:
    """For every chunk the n documents with the best overlap: half the idf-weighted Jaccard
    of their words, half the share of the chunk's words found. Documents that share no word
    with a chunk are none of its; weights of 0 or less count as they are.

    Chunks are a query set: they go to the tasks in blocks and meet the documents there, so
    that pairs are never rows, however frequent the words that they share. Documents are read
    once for some millions of the chunks' words; the most frequent words take their weights
    along, and only rarer ones are sent to theirs. Words go by 64-bit hashes. Rows of one key
    are one document; rows without a key are counted, but not found."""
    spark = docs.sparkSession
    words = lambda c: F.array_distinct(F.transform(tokens(c), lambda t: F.xxhash64(t)))
    base = cut(docs.select(F.col(key).cast("long").alias(key), F.coalesce(words(text), F.array().cast("array<long>")).alias("h")))
    many = float(base.count())
    base = _one_per_key(base, key)
    counted = base.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    idf = cut(counted.select("h", F.length(F.bin("df")).alias("level"), F.log(F.lit(many) / (F.col("df") + 1)).alias("idf")))
    frequent, rare, single = _by_frequency(idf)
    asked = chunks.where(F.col(chunk).isNotNull()).select(F.col(chunk).cast("long").alias(chunk), F.explode(words(chunk_text)).alias("h")).distinct()
    asked = cut(asked.join(idf.drop("level"), "h", "left").select(chunk, "h", F.coalesce("idf", F.lit(1.0)).alias("idf")))
    names, found = [chunk, key, "score"], None
    parts = max(1, -(-asked.count() // QUERY_TERMS))
    for part in range(parts):
        pairs = asked.where(F.pmod(F.xxhash64(chunk), F.lit(parts)) == part).toArrow()
        known, first, term = np.unique(pairs.column("h").to_numpy(), return_index=True, return_inverse=True)
        ids, of = np.unique(pairs.column(chunk).to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        sent = spark.sparkContext.broadcast((ids, of[order], term[order].astype(np.int32), pairs.column("idf").to_numpy()[first]))
        rows = _weighed(base.where(F.col(key).isNotNull()), spark.sparkContext.broadcast((*frequent, known, single)), key)
        if rare is not None:
            rows = cut(rows)
            rest = rows.where("size(rest) > 0")
            more = rest.select(key, F.explode("rest").alias("h")).join(rare, "h").groupBy(key).agg(F.sum("idf").alias("more"))
            rows = rows.where("size(rest) = 0").unionByName(rest.join(more, key).withColumn("total", F.col("total") + F.col("more")).drop("more"))

        def compared(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, of, term, idf = sent.value
            blocks = []
            for lo in range(0, len(ids), TEXT_QUERY_BLOCK):
                x, y = np.searchsorted(of, [lo, lo + TEXT_QUERY_BLOCK])
                own = ids[lo : lo + TEXT_QUERY_BLOCK]
                blocks.append((own, _Overlaps(of[x:y] - lo, term[x:y], idf, len(own), n)))
            for batch in batches:
                row, which = _flat(batch.column("term"))
                for _, block in blocks:
                    block.add(row, which, batch.column("total").to_numpy(), batch.column(key).to_numpy())
            yield from (block.best.rows(own.tolist(), names) for own, block in blocks)

        out = spread(rows.select(key, "total", "term"), key).mapInArrow(compared, f"{chunk} long, {key} long, score double")
        found = out if found is None else found.unionByName(out)
    return ranked(found, chunk, "score", key, n)


def _one_per_key(base: DataFrame, key: str) -> DataFrame:
    """base (key, h: distinct words), with rows of the same key put together."""
    repeated = cut(base.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key))
    if repeated.isEmpty():
        return base
    each = base.join(repeated, key, "left_semi").select(key, F.explode("h").alias("h")).distinct()
    return cut(base.join(repeated, key, "left_anti").unionByName(each.groupBy(key).agg(F.collect_list("h").alias("h"))))


def _by_frequency(idf: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None, float | None]:
    """Of idf (h, level: the binary digits of a word's df, idf) the most frequent words, in order
    of h, and their weights; the other words as rows; or, where these all stand in one document
    only, None and the weight that they have in common."""
    number = {r["level"]: r["count"] for r in idf.groupBy("level").count().collect()}
    least = max(number, default=0) + 1
    while least > 1 and sum(c for level, c in number.items() if level >= least - 1) <= FREQUENT_WORDS:
        least -= 1
    table = idf.where(F.col("level") >= least).select("h", "idf").toArrow()
    h, weight = table.column("h").to_numpy(), table.column("idf").to_numpy()
    order = np.argsort(h)
    rest = idf.where(F.col("level") < least)
    if least > 2:
        return (h[order], weight[order]), rest.drop("level"), None
    one = rest.select("idf").first()
    return (h[order], weight[order]), None, one["idf"] if one else 0.0


def _weighed(base: DataFrame, sent, key: str) -> DataFrame:
    """key, total, term, rest: of every row of base that holds a known word the sum of the weights
    of its words, the known ones, by place, and the words whose weight is still to be added.
    sent: frequent words and their weights, known words, weight of every other word or None."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, idf, known, single = sent.value
        names = np.union1d(frequent, known)
        look = _lookup(names)
        weight, place = np.full(len(names), np.nan if single is None else single), np.full(len(names), -1, np.int32)
        weight[np.searchsorted(names, frequent)] = idf
        place[np.searchsorted(names, known)] = np.arange(len(known))
        if not len(known):
            return
        for batch in batches:
            for own in pieces(batch, "h"):
                row, h = _flat(own.column("h"))
                at = look(h)
                met = names[at] == h
                term = np.where(met, place[at], -1)
                found = np.bincount(row[term >= 0], minlength=own.num_rows) > 0
                adds = np.where(met, weight[at], np.nan if single is None else single)
                open_ = np.isnan(adds) & found[row]
                total = np.bincount(row, np.nan_to_num(adds), own.num_rows)
                lists = [_lists(row[ok], values[ok], own.num_rows, kind) for ok, values, kind in ((term >= 0, term, pa.int32()), (open_, h, pa.int64()))]
                yield pa.RecordBatch.from_arrays([own.column(key), pa.array(total), *lists], names=[key, "total", "term", "rest"]).filter(pa.array(found))

    return base.mapInArrow(weighed, f"{key} long, total double, term array<int>, rest array<long>")


def _lookup(names: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from hashes to their places in names (hashes in order, one at least), or to any
    other place: the first bits of a hash name a short run."""
    bits = max(1, min(24, len(names).bit_length()))
    starts = np.searchsorted(names >> (64 - bits), np.arange(-(1 << bits - 1), 1 << bits - 1))

    def look(h: np.ndarray) -> np.ndarray:
        at = np.minimum(starts[(h >> (64 - bits)) + (1 << bits - 1)], len(names) - 1)
        short = np.flatnonzero(names[at] < h)
        while len(short):
            short = short[at[short] < len(names) - 1]
            at[short] += 1
            short = short[names[at[short]] < h[short]]
        return at

    return look


def _lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each of so many rows, of values that stand in the order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


class _Overlaps:
    """A block of chunks that meets documents: only words that a document holds are added up."""

    def __init__(self, of: np.ndarray, term: np.ndarray, idf: np.ndarray, chunks: int, n: int):
        """of, term: for each word of a chunk the chunk and the word, whose weight is in idf."""
        order = np.argsort(term, kind="stable")
        self.of, self.idf, self.chunks, self.best = of[order], idf, chunks, Best(chunks, n)
        self.terms, self.first, self.held = np.unique(term[order], return_index=True, return_counts=True)
        self.sizes, self.sums = np.bincount(of, minlength=chunks)[:, None], np.bincount(of, idf[term], chunks)[:, None]

    def add(self, row: np.ndarray, which: np.ndarray, total: np.ndarray, keys: np.ndarray) -> None:
        """Documents by place: of each of their words the document (in order) and the word; their
        sums of weights and keys. They are taken in portions of about _OVERLAPS sums."""
        at = np.minimum(np.searchsorted(self.terms, which), max(0, len(self.terms) - 1))
        ok = self.terms[at] == which if len(self.terms) else np.zeros(len(which), bool)
        row, which, at = row[ok], which[ok], at[ok]
        docs, first = np.unique(row, return_index=True)
        ends = np.append(first[1:], len(row))
        cost = np.cumsum(self.held[at])[ends - 1] + self.chunks * np.arange(1, len(docs) + 1)
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + _OVERLAPS, "right")))
            own, part = docs[lo:hi], slice(first[lo], ends[hi - 1])
            run, place = _runs(self.held[at[part]])
            cell = self.of[self.first[at[part]][run] + place] * len(own) + np.repeat(np.arange(len(own)), ends[lo:hi] - first[lo:hi])[run]
            size = self.chunks * len(own)
            shared = np.bincount(cell, minlength=size).reshape(self.chunks, -1)
            both = np.bincount(cell, self.idf[which[part]][run], size).reshape(self.chunks, -1)
            union = total[own] + self.sums - both
            scores = 0.5 * np.divide(both, union, out=np.zeros_like(both), where=union != 0) + 0.5 * shared / self.sizes
            self.best.add(np.where(shared > 0, np.round(scores, 9), -np.inf), keys[own])
            lo = hi
