"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.expansion import expand
from corpusloom.operators import retrieval as r
from corpusloom.plans.standins import PAPERS, papers
from corpusloom.registry import query
from corpusloom.session import table

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_POSTINGS = f"""
words AS (SELECT doc_id, {TOKENS.format("text")} AS terms FROM documents),
exploded AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM words),
postings AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM exploded GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS DOUBLE) / greatest(count(*), 1) AS avg_dl FROM words)"""
_BM25 = f"""{_POSTINGS},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY query_id, term),
bm AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
  FROM postings JOIN dfs USING (term) JOIN asked USING (term) CROSS JOIN stats GROUP BY query_id, doc_id),
bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20)"""
_SIMS = """
sims AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
  FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"""
_WEIGHT = "[1.5, 1.4, 1.3, 1.2, 1.15, 1.05, 1.0][CAST(vec_id % 7 + 1 AS INTEGER)]"
_BOOST = "(CASE WHEN tier = 1 THEN 0.9 ELSE 0.8 END) * (CASE WHEN citations > 0 THEN least(1 + 0.1 * log10(citations + 1), 1.3) ELSE 1.0 END)"


def _asked(spark, sf_dir):
    """Every hundredth vector as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _items(spark, sf_dir):
    """Every benchmark item as a query, with the vector of its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")


@query("doc_frequency", f"WITH {_POSTINGS} SELECT term, df FROM dfs")
def doc_frequency(spark, sf_dir):
    return r.document_frequency(r.postings(table(spark, sf_dir, "documents")))


@query("corpus_stats", f"WITH {_POSTINGS} SELECT n, round(avg_dl, 6) AS avg_dl FROM stats")
def corpus_stats(spark, sf_dir):
    return r.corpus_stats(table(spark, sf_dir, "documents")).select("n", F.round("avg_dl", 6).alias("avg_dl"))


@query("idf_table", f"WITH {_POSTINGS} SELECT term, round(ln(CAST(n AS DOUBLE) / (df + 1)), 6) AS idf FROM dfs CROSS JOIN stats")
def idf_table(spark, sf_dir):
    return r.idf_table(table(spark, sf_dir, "documents")).select("term", F.round("idf", 6).alias("idf"))


@query("bm25_search", f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm_top")
def bm25_search(spark, sf_dir):
    found = r.bm25(table(spark, sf_dir, "documents"), _items(spark, sf_dir), 20)
    return r.ranked(found, "query_id", "score", "doc_id", 20).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("vector_knn", f"WITH {_SIMS} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 10")
def vector_knn(spark, sf_dir):
    return r.nearest(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("vector_knn_journal_boost", f"""WITH {_SIMS},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM sims) WHERE r <= 30),
scored AS (SELECT *, similarity * {_WEIGHT} AS score FROM pool)
SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""")
def vector_knn_journal_boost(spark, sf_dir):
    pool = r.nearest(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 30).withColumn("journal_rank", F.col("vec_id") % 7 + 1)
    return r.journal_search(pool, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


_S2 = f"""WITH {PAPERS}, {_SIMS},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM sims JOIN papers ON vec_id = doc_id) WHERE r <= {{k}}),
boosted AS (SELECT *, similarity * {_BOOST} AS boosted FROM pool),
shared AS (SELECT *, CASE WHEN max(boosted) OVER (PARTITION BY query_id) > 0 THEN boosted / max(boosted) OVER (PARTITION BY query_id) ELSE boosted END AS score FROM boosted)"""


@query("s2_search", _S2.format(k=10) + " SELECT query_id, doc_id, source, tier, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM shared")
def s2_search(spark, sf_dir):
    facts = papers(spark, sf_dir).select("doc_id", "source", "tier", "citations")
    known = table(spark, sf_dir, "embeddings").join(facts.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    pool = r.nearest(known, _asked(spark, sf_dir), 10).drop("rank").join(facts, F.col("vec_id") == F.col("doc_id"))
    return r.boosted_search(pool, 10, key="doc_id").select("query_id", "doc_id", "source", "tier", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("two_collection_search", _S2.format(k=20) + """,
own AS (SELECT query_id, vec_id AS doc_id, 0 AS second, similarity AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM sims) WHERE r <= 10),
both_ AS (SELECT * FROM own UNION ALL SELECT query_id, doc_id, 1 AS second, score * 0.85 AS score FROM shared)
SELECT query_id, doc_id, second, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, second, doc_id) AS rank FROM both_) WHERE rank <= 10""")
def two_collection_search(spark, sf_dir):
    facts = papers(spark, sf_dir).select("doc_id", "source", "tier", "citations")
    vectors = table(spark, sf_dir, "embeddings")
    own = r.nearest(vectors, _asked(spark, sf_dir), 10).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("second"), F.col("similarity").alias("score"))
    known = vectors.join(facts.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    pool = r.nearest(known, _asked(spark, sf_dir), 20).drop("rank").join(facts, F.col("vec_id") == F.col("doc_id"))
    second = r.boosted_search(pool, 20, key="doc_id").select("query_id", "doc_id", F.lit(1).alias("second"), (F.col("score") * 0.85).alias("score"))
    both = own.unionByName(second).withColumn("tie", F.struct("second", "doc_id"))
    return r.ranked(both, "query_id", "score", "tie", 10).select("query_id", "doc_id", "second", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("hybrid_search", f"""WITH {PAPERS}, {_BM25},
asked_vectors AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id),
pool AS (SELECT * FROM (SELECT q.query_id, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity,
    row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS r
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id CROSS JOIN asked_vectors q) WHERE r <= 20),
boosted AS (SELECT query_id, source, similarity * {_BOOST} AS score FROM pool JOIN papers ON vec_id = doc_id),
sem AS (SELECT query_id, source, max(score) AS score FROM boosted GROUP BY query_id, source),
sem_n AS (SELECT query_id, source, score / max(score) OVER (PARTITION BY query_id) AS semantic FROM sem),
kw AS (SELECT query_id, source, max(score) AS score FROM bm_top JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY query_id, source),
kw_n AS (SELECT query_id, source, score / max(score) OVER (PARTITION BY query_id) AS keyword FROM kw),
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.source, b.source) AS source,
    coalesce(semantic, 0) AS semantic, coalesce(keyword, 0) AS keyword, coalesce(semantic, 0) * 0.7 + coalesce(keyword, 0) * 0.3 AS score
  FROM sem_n a FULL OUTER JOIN kw_n b ON a.query_id = b.query_id AND a.source = b.source)
SELECT query_id, source, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(score, 6) AS score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank FROM fused) WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    found = r.hybrid(papers(spark, sf_dir), table(spark, sf_dir, "embeddings"), _items(spark, sf_dir), 10, texts=table(spark, sf_dir, "documents"))
    return found.select("query_id", "source", *(F.round(c, 6).alias(c) for c in ("semantic", "keyword", "score")), F.col("rank").cast("long").alias("rank"))


@query("idf_overlap_top3", f"""WITH {_POSTINGS},
idf AS (SELECT term, ln(CAST(n AS DOUBLE) / (df + 1)) AS idf FROM dfs CROSS JOIN stats),
mine AS (SELECT doc_id, term, idf FROM postings JOIN idf USING (term)),
other AS (SELECT chunk_id, t.term, coalesce(idf, 1.0) AS idf FROM (SELECT DISTINCT item_id AS chunk_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) t LEFT JOIN idf ON t.term = idf.term),
total AS (SELECT doc_id, sum(idf) AS doc_sum FROM mine GROUP BY doc_id),
asked AS (SELECT chunk_id, sum(idf) AS chunk_sum, count(*) AS chunk_terms FROM other GROUP BY chunk_id),
shared AS (SELECT chunk_id, doc_id, sum(mine.idf) AS both_, count(*) AS n_both FROM mine JOIN other ON mine.term = other.term GROUP BY chunk_id, doc_id),
scored AS (SELECT chunk_id, doc_id, 0.5 * CASE WHEN doc_sum + chunk_sum - both_ <> 0 THEN both_ / (doc_sum + chunk_sum - both_) ELSE 0 END + 0.5 * n_both / chunk_terms AS score
  FROM shared JOIN total USING (doc_id) JOIN asked USING (chunk_id))
SELECT chunk_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 3""")
def idf_overlap_top3(spark, sf_dir):
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    found = r.overlap_passages(table(spark, sf_dir, "documents"), chunks)
    return found.select("chunk_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("norm_check", """SELECT count(*) AS n, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm, round(avg(norm), 6) AS avg_norm
FROM (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)""")
def norm_check(spark, sf_dir):
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    rows = table(spark, sf_dir, "embeddings").select(norm.alias("norm"))
    return rows.agg(F.count("*").alias("n"), F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"), F.round(F.avg("norm"), 6).alias("avg_norm"))


@query("query_expansion")
def query_expansion(spark, sf_dir):
    return expand(table(spark, sf_dir, "benchmark"), "item_id", "text")
