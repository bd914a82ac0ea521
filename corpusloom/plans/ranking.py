"""Queries of rankings, selections, windows and session history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import classify as c
from corpusloom.functions import text as t
from corpusloom.functions import vocabulary as v
from corpusloom.operators import ranking as r
from corpusloom.plans.standins import PAPERS, papers, sql_list
from corpusloom.plans.texts import _KW, _OVERLAP
from corpusloom.registry import query
from corpusloom.session import table


@query("per_group_topn", f"WITH {PAPERS} SELECT source, doc_id, citations, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY citations DESC, doc_id) AS place FROM papers) WHERE place <= 10")
def per_group_topn(spark, sf_dir):
    return r.top_per_group(papers(spark, sf_dir), "source", [F.col("citations").desc(), F.col("doc_id")], 10).select("source", "doc_id", "citations", F.col("place").cast("long").alias("place"))


@query("best_per_group", f"WITH {PAPERS} SELECT venue, max(citations) AS citations, arg_max(doc_id, CAST(citations AS BIGINT) * 1000000000 - doc_id) AS doc_id, count(*) AS n FROM papers GROUP BY venue")
def best_per_group(spark, sf_dir):
    return papers(spark, sf_dir).groupBy("venue").agg(F.max("citations").alias("citations"), F.max_by("doc_id", F.struct("citations", -F.col("doc_id"))).alias("doc_id"), F.count("*").alias("n"))


@query("rank_histogram", f"WITH {PAPERS} SELECT journal_rank, count(*) AS n, round(avg(citations), 6) AS avg_citations FROM papers GROUP BY journal_rank")
def rank_histogram(spark, sf_dir):
    return papers(spark, sf_dir).groupBy("journal_rank").agg(F.count("*").alias("n"), F.round(F.avg("citations"), 6).alias("avg_citations"))


@query("catalogue_page", f"""WITH {PAPERS}, sources AS (SELECT source, lang, count(*) AS chunks, max(year) AS year, arg_min(substring(text, 1, 150), doc_id) AS preview FROM papers WHERE length(text) > 20 GROUP BY source, lang),
kept AS (SELECT * FROM sources WHERE lang = 'en' AND year >= 2015)
SELECT source, chunks, year, preview, (SELECT count(*) FROM kept) AS total, CAST(ceil((SELECT count(*) FROM kept) / 5.0) AS BIGINT) AS total_pages FROM kept ORDER BY year DESC, source LIMIT 5 OFFSET 5""")
def catalogue_page(spark, sf_dir):
    sources = papers(spark, sf_dir).where("length(text) > 20").groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.max("year").alias("year"), F.min_by(F.substring("text", 1, 150), "doc_id").alias("preview"))
    return r.page(sources.where("lang = 'en' and year >= 2015"), [F.col("year").desc(), F.col("source")], 2, 5).drop("lang")


def _pool(spark, sf_dir):
    """Every document with one of the benchmark's questions: its own by number."""
    docs = papers(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("question"))
    n = items.agg((F.max("item_id") + 1).alias("n_items"))
    joined = docs.crossJoin(n).withColumn("item_id", F.col("doc_id") % F.col("n_items")).join(items, "item_id")
    overlap = F.round(t.keyword_overlap(F.col("question"), F.col("text")), 9)
    return joined.select("item_id", F.col("doc_id").alias("id"), F.col("venue").alias("journal"), c.paper_type(F.col("source"), F.col("venue"), F.col("title")).alias("kind"), (11 - F.col("journal_rank")).alias("journal_score"), overlap.alias("overlap"), t.data_content_score(F.col("text")).alias("data"))


_POOL = f"""WITH {PAPERS}, n AS (SELECT max(item_id) + 1 AS n_items FROM benchmark),
asked AS (SELECT p.*, b.item_id, b.text AS question FROM papers p CROSS JOIN n JOIN benchmark b ON b.item_id = p.doc_id % n.n_items),
sets AS (SELECT *, {_KW.format("question")} AS a, {_KW.format("text")} AS b FROM asked),
pool AS (SELECT item_id, doc_id AS id, 11 - journal_rank AS journal_score, round({_OVERLAP}, 9) AS overlap,
  least(len(list_filter({sql_list([w.lower() for w in v.DATA_CONTENT])}, lambda w: contains(lower(text), w))) / 10.0, 1.0) AS data,
  CASE WHEN len(list_filter({sql_list([w.lower() for w in v.REVIEW])}, lambda w: contains(lower(venue || ' ' || title || ' ' || source), w))) > 0 THEN 'review' ELSE 'experimental' END AS kind FROM sets)"""


@query("pool_scores", _POOL + " SELECT item_id, id, round(overlap * 5 + journal_score * 0.5 + data * 2, 6) AS broad, round(overlap * 5 + journal_score * 0.3 + data * 3, 6) AS specific FROM pool")
def pool_scores(spark, sf_dir):
    o, j, d = F.col("overlap"), F.col("journal_score"), F.col("data")
    return _pool(spark, sf_dir).select("item_id", "id", F.round(o * 5 + j * 0.5 + d * 2, 6).alias("broad"), F.round(o * 5 + j * 0.3 + d * 3, 6).alias("specific"))


@query("reviews_then_experiments", _POOL + """, placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY CASE WHEN kind = 'review' THEN journal_score ELSE round(overlap * 5 + journal_score * 0.5, 6) END DESC, id) AS p FROM pool),
chosen AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN kind = 'review' THEN 0 ELSE 1 END, p) AS place FROM placed WHERE kind <> 'review' OR p <= 2)
SELECT item_id, id, kind, place FROM chosen WHERE place <= 3""")
def reviews_then_experiments(spark, sf_dir):
    pool = _pool(spark, sf_dir).withColumn("score", F.round(F.col("overlap") * 5 + F.col("journal_score") * 0.5, 6))
    return r.reviews_first(pool, "item_id", 3).select("item_id", "id", "kind", F.col("place").cast("long").alias("place"))


# The choice as it is described: one after the other, of a journal not chosen yet, or the next of all if one place is left.
DIVERSE = """, ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS o FROM scored),
picks AS (SELECT item_id, 1 AS place, id, o, [journal] AS journals FROM ordered WHERE o = 1
  UNION ALL SELECT p.item_id, p.place + 1, n.id, n.o, list_append(p.journals, n.journal) FROM picks p, LATERAL (
    SELECT id, o, journal FROM ordered r WHERE r.item_id = p.item_id AND r.o > p.o AND (p.place = 3 OR NOT list_contains(p.journals, r.journal)) ORDER BY r.o LIMIT 1) n WHERE p.place < 4)
SELECT item_id, id, CAST(place AS INTEGER) AS place FROM picks"""


@query("diverse_pick", _POOL.replace("WITH papers", "WITH RECURSIVE papers", 1) + ", scored AS (SELECT p.item_id, p.id, d.venue AS journal, round(p.overlap * 5, 6) AS score FROM pool p JOIN papers d ON p.id = d.doc_id)" + DIVERSE)
def diverse_pick(spark, sf_dir):
    return r.diverse(_pool(spark, sf_dir).withColumn("score", F.round(F.col("overlap") * 5, 6)), "item_id", 4)


@query("islands_empty_bins", """WITH xs AS (SELECT DISTINCT user_id, CAST(floor(value / 5.0) AS INTEGER) AS bin FROM events),
bins AS (SELECT user_id, unnest(range(6, 14)) AS bin FROM (SELECT DISTINCT user_id FROM xs)),
empty_ AS (SELECT b.user_id, b.bin, b.bin - row_number() OVER (PARTITION BY b.user_id ORDER BY b.bin) AS island FROM bins b LEFT JOIN xs ON b.user_id = xs.user_id AND b.bin = xs.bin WHERE xs.bin IS NULL)
SELECT user_id, CAST(min(bin) AS INTEGER) AS first_bin, count(*) AS n_bins FROM empty_ GROUP BY user_id, island HAVING count(*) >= 2""")
def islands_empty_bins(spark, sf_dir):
    return r.empty_islands(table(spark, sf_dir, "events"), "user_id", "value", 100.0)


@query("adjacency_merge", """WITH marked AS (SELECT user_id, event_id, value, CASE WHEN lag(value) OVER w IS NULL OR abs(value - lag(value) OVER w) >= 15 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS paragraph FROM marked)
SELECT user_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM numbered GROUP BY user_id, paragraph""")
def adjacency_merge(spark, sf_dir):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = r.merged_neighbours(table(spark, sf_dir, "events"), "user_id", "event_id", F.abs(F.col("value") - before) >= 15)
    return rows.groupBy("user_id", "paragraph").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("last_n_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def last_n_history(spark, sf_dir):
    return r.top_per_group(table(spark, sf_dir, "conversations"), "conv_id", [F.col("turn").desc()], 10).select("conv_id", "turn", "role")


@query("session_titles", "SELECT conv_id, CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '......' ELSE t END AS title, n FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS t, count(*) AS n FROM conversations GROUP BY conv_id)")
def session_titles(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t"), F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    title = F.when(F.col("u") > 0, F.col("t"))
    return first.select("conv_id", F.when(F.length(title) > 40, F.concat(F.substring(title, 1, 40), F.lit("......"))).otherwise(title).alias("title"), "n")


@query("token_estimate", "SELECT conv_id, CAST(floor(sum(length(text)) / 4.0) AS BIGINT) AS tokens, CAST(floor(sum(length(text)) / 4.0) AS BIGINT) >= 500 AS compress FROM conversations GROUP BY conv_id")
def token_estimate(spark, sf_dir):
    tokens = F.floor(F.sum(F.length("text")) / 4)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tokens.alias("tokens"), (tokens >= 500).alias("compress"))
