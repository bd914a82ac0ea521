"""Queries of the library's verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.registry import embed_stub
from corpusloom.operators import chunking
from corpusloom.operators import composites as v
from corpusloom.plans.answers import _answers
from corpusloom.plans.ranking import _POOL, DIVERSE, _pool
from corpusloom.plans.retrieval import _POSTINGS, TOKENS, _items
from corpusloom.plans.standins import papers
from corpusloom.registry import query
from corpusloom.session import table


@query("expanded_search")
def expanded_search(spark, sf_dir):
    found = v.search(papers(spark, sf_dir), table(spark, sf_dir, "embeddings"), _items(spark, sf_dir), 10, year_min=2012)
    return found.select("query_id", "source", F.round("score", 6).alias("score"), "rank")


@query("corpus_curation")
def corpus_curation(spark, sf_dir):
    return v.curate(papers(spark, sf_dir)).select("doc_id", "doi", "citations", "tier", "venue_normalized")


@query("chunks_with_vectors")
def chunks_with_vectors(spark, sf_dir):
    return v.chunk_and_embed(table(spark, sf_dir, "documents").select("doc_id", "text"), embed_stub())


_FIXED = "SELECT doc_id, CAST(idx AS INTEGER) AS idx, substring(text, CAST(idx * 400 + 1 AS INTEGER), 500) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS idx FROM {} WHERE length(text) > 0)"


@query("incremental_update", f"""WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 2), new AS (SELECT doc_id, 'new ' || text AS text FROM documents WHERE doc_id % 5 = 0)
{_FIXED.format("old")} WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL {_FIXED.format("new")}""")
def incremental_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    existing = chunking.fixed(docs.where("doc_id % 3 <> 2"))
    return v.update(existing, docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), "text")), chunking.fixed)


@query("highlight_passages", f"""WITH paras AS (SELECT doc_id * 10000 + i AS doc_id, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE length(ls[i]) >= 50),
{_POSTINGS.replace("FROM documents", "FROM paras")},
idf AS (SELECT term, ln(CAST(n AS DOUBLE) / (df + 1)) AS idf FROM dfs CROSS JOIN stats),
mine AS (SELECT doc_id, term, idf FROM postings JOIN idf USING (term)),
other AS (SELECT chunk_id, t.term, coalesce(idf, 1.0) AS idf FROM (SELECT DISTINCT item_id AS chunk_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) t LEFT JOIN idf ON t.term = idf.term),
total AS (SELECT doc_id, sum(idf) AS doc_sum FROM mine GROUP BY doc_id),
asked AS (SELECT chunk_id, sum(idf) AS chunk_sum, count(*) AS chunk_terms FROM other GROUP BY chunk_id),
shared AS (SELECT chunk_id, doc_id, sum(mine.idf) AS both_, count(*) AS n_both FROM mine JOIN other ON mine.term = other.term GROUP BY chunk_id, doc_id),
scored AS (SELECT chunk_id, doc_id, round(0.5 * CASE WHEN doc_sum + chunk_sum - both_ <> 0 THEN both_ / (doc_sum + chunk_sum - both_) ELSE 0 END + 0.5 * n_both / chunk_terms, 9) AS score
  FROM shared JOIN total USING (doc_id) JOIN asked USING (chunk_id))
SELECT chunk_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 3 AND score > 0.06""")
def highlight_passages(spark, sf_dir):
    """Lines of documents as paragraphs, benchmark items as chunks."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where("length(text) >= 50")
    paragraphs = lines.select((F.col("doc_id") * 10_000 + F.col("i") + 1).alias("doc_id"), "text")
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    return v.highlights(paragraphs, chunks).select("chunk_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("follow_up_pick", _POOL.replace("WITH papers", "WITH RECURSIVE papers", 1) + ", scored AS (SELECT p.item_id, p.id, d.venue AS journal, round(p.overlap * 5 + p.data * 3, 6) AS score FROM pool p JOIN papers d ON p.id = d.doc_id WHERE p.id % 4 <> 0)" + DIVERSE)
def follow_up_pick(spark, sf_dir):
    pool = _pool(spark, sf_dir).withColumn("score", F.round(F.col("overlap") * 5 + F.col("data") * 3, 6)).withColumn("is_read", F.col("id") % 4 == 0)
    return v.follow_up(pool, "item_id")


@query("checked_answers")
def checked_answers(spark, sf_dir):
    return v.checked_answers(_answers(spark, sf_dir)).select("conv_id", "turn", "answer", "n_cited", "suggestions")
