"""Queries of scans, plans of harvests, logs and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.registry import Tool, Tools, embed_stub, register_split
from corpusloom.operators.ranking import numbered
from corpusloom.plans.standins import PAPERS, papers, sql_list
from corpusloom.registry import query
from corpusloom.session import table
from corpusloom.sources import records as s


@query("keyed_scan", f"WITH {PAPERS} SELECT lower(trim(doi)) AS key, max(doc_id) AS doc_id, arg_max(venue, doc_id) AS venue FROM papers WHERE doi IS NOT NULL GROUP BY 1")
def keyed_scan(spark, sf_dir):
    return s.keyed(papers(spark, sf_dir).select("doc_id", "doi", "venue"), F.col("doi"), "doc_id").select("key", "doc_id", "venue")


_TOPIC = ("the", "Tion", "für", "ción")


@query("topic_filter", f"WITH {PAPERS} SELECT doc_id, year, citations FROM papers WHERE len(list_filter({sql_list([w.lower() for w in _TOPIC])}, lambda w: contains(lower(title || ' ' || venue), w))) > 0 AND citations >= CASE WHEN year >= 2025 THEN 0 ELSE 20 END")
def topic_filter(spark, sf_dir):
    rows = papers(spark, sf_dir)
    return rows.where(s.on_topic(F.col("title"), F.col("venue"), _TOPIC) & s.cited_enough(F.col("year"), F.col("citations"), least=20)).select("doc_id", "year", "citations")


@query("harvest_plan", f"WITH {PAPERS} SELECT source AS query, y AS year FROM (SELECT DISTINCT source FROM papers) CROSS JOIN (SELECT CAST(unnest(range(2009, 2027)) AS INTEGER) AS y) WHERE source || ':' || CAST(y AS VARCHAR) NOT IN (SELECT source || ':' || CAST(year AS VARCHAR) FROM papers WHERE tier = 1)")
def harvest_plan(spark, sf_dir):
    rows = papers(spark, sf_dir)
    return s.harvest_plan(rows.select(F.col("source").alias("query")).distinct(), list(range(2009, 2027)), rows.where("tier = 1").select(F.col("source").alias("query"), "year").distinct())


_LINE = "CASE event_type WHEN 'view' THEN 'SCF Done:  E(RB3LYP) =  -' || CAST(event_id AS VARCHAR) || '.25' WHEN 'error' THEN 'Error termination' WHEN 'purchase' THEN 'Dipole moment (Debye):' || chr(10) || ' X= 1 Tot= ' || CAST(event_id AS VARCHAR) || '.5' ELSE 'step' END"


@query("log_scan", f"""WITH l AS (SELECT user_id, event_id, event_type, {_LINE} AS line FROM events)
SELECT user_id, CAST(arg_max(-event_id - 0.25, event_id) FILTER (WHERE event_type = 'view') AS DOUBLE) AS energy, CAST(min(event_id) FILTER (WHERE event_type = 'purchase') + 0.5 AS DOUBLE) AS dipole, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'failed' ELSE 'running' END AS status FROM l GROUP BY user_id""")
def log_scan(spark, sf_dir):
    line = F.expr(_LINE.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    logs = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return logs.select("user_id", s.run_log(F.col("text")).alias("r")).select("user_id", "r.*")


@query("udtf_split")
def udtf_split(spark, sf_dir):
    register_split(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_to_split")
    return spark.sql("SELECT doc_id, idx, content FROM documents_to_split, LATERAL split_text(text)")


@query("embed_documents")
def embed_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embed_stub()("text").alias("embedding"))


@query("tool_dispatch", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE CAST(turn * 2 AS VARCHAR) END AS result, CASE WHEN turn % 3 = 2 THEN 'unknown tool: other' END AS error FROM conversations")
def tool_dispatch(spark, sf_dir):
    tools = Tools()
    tools.add(Tool("double", "twice a number", {"type": "object", "properties": {"n": {"type": "integer"}}}, lambda n: 2 * n))
    name = F.when(F.col("turn") % 3 == 2, "other").otherwise("double")
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), F.to_json(F.struct(F.col("turn").alias("n"))).alias("arguments"))
    return tools.apply(calls).select("conv_id", "turn", "result", "error")


@query("chunk_rows", f"""WITH {PAPERS} SELECT row_number() OVER (ORDER BY year DESC, doc_id) - 1 AS id, doc_id, substring(text, 1, 600) AS content, venue AS journal, year, tier FROM papers WHERE length(text) >= 300""")
def chunk_rows(spark, sf_dir):
    """Chunks with dense numbers in order of year."""
    rows = papers(spark, sf_dir).where("length(text) >= 300").select("doc_id", F.substring("text", 1, 600).alias("content"), F.col("venue").alias("journal"), "year", "tier")
    return numbered(rows, [F.col("year").desc(), F.col("doc_id")])
