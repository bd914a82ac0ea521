"""Queries of sources that take predicates, versioned tables, identity and remembered calls."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from corpusloom.functions import identity, remembered
from corpusloom.operators import curation, entities
from corpusloom.plans.standins import PAPERS, papers
from corpusloom.registry import query
from corpusloom.session import shared_folder, table
from corpusloom.sources import paged, versions

_YEARS = list(range(2009, 2027))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("paged_search", f"""WITH {PAPERS}, served AS (SELECT *, row_number() OVER (PARTITION BY lang, year, source ORDER BY doc_id) AS place FROM papers WHERE lang IN ('de', 'en', 'es', 'fr'))
SELECT lang AS query, year, doc_id, source AS field, title FROM served WHERE year BETWEEN 2012 AND 2015 AND lang <> 'de' AND source = 'src3' AND place <= 1000 AND NOT (lang = 'en' AND year = 2013)""")
def paged_search(spark, sf_dir):
    """Documents served as pages by language and year; years and the field are asked for."""
    rows = papers(spark, sf_dir).select(F.col("lang").alias("query"), "year", "doc_id", F.col("source").alias("field"), "title")
    fetch = paged.serve(rows.where("query is not null"), _folder(spark, "served"), "doc_id", "field", "title")
    paged.register(spark, paged.paged_source("served_papers", "doc_id long, field string, title string", fetch))
    read = spark.read.format("served_papers").option("queries", "de;en;es;fr").option("years", ";".join(map(str, _YEARS))).option("done", json.dumps([["en", 2013]]))
    return read.load().where("year >= 2012 and year <= 2015 and query in ('en', 'es', 'fr') and field = 'src3'")


@query("versioned_rewrite", f"""WITH {PAPERS} SELECT 1 AS version, venue, count(*) AS n FROM papers GROUP BY venue
UNION ALL SELECT 2, CASE WHEN venue IN ('Unknown', '') THEN 'Journal of ' || lang ELSE venue END AS v, count(*) FROM papers GROUP BY v
UNION ALL SELECT 3, venue, count(*) FROM papers GROUP BY venue""")
def versioned_rewrite(spark, sf_dir):
    """A table, its venues filled in place, and the change taken back; all versions are there."""
    at = _folder(spark, "versions")
    versions.commit(papers(spark, sf_dir).select("doc_id", "lang", "venue"), at)
    versions.rewrite(spark, at, lambda df: df.withColumn("venue", F.when(F.col("venue").isin("Unknown", ""), F.concat(F.lit("Journal of "), "lang")).otherwise(F.col("venue"))))
    versions.rollback(spark, at, 1)
    counted = [versions.read(spark, at, v).groupBy("venue").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "venue", "n") for v in versions.versions(spark, at)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


_DOI = "'10.1234/abcdefgh' || doc_id"


@query("doi_evidence", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE {_DOI} END AS doi,
  CASE doc_id % 7 WHEN 0 THEN '/prism:doi' WHEN 1 THEN '/Subject' WHEN 2 THEN 'first pages' WHEN 3 THEN 'first pages' WHEN 4 THEN 'last page' WHEN 5 THEN '/DOI' END AS origin FROM documents""")
def doi_evidence(spark, sf_dir):
    """Identifiers from metadata and pages: broken over lines, set apart, too short, or none."""
    i, none = F.col("doc_id") % 7, F.lit(None).cast("string")
    doi = F.concat(F.lit("10.1234/abcdefgh"), F.col("doc_id").cast("string"))
    apart = F.array_join(F.split(doi, ""), " ")
    meta = F.create_map(
        F.lit("/prism:doi"), F.when(i == 0, F.concat(F.lit("doi:"), doi, F.lit("."))).otherwise(""), F.lit("/doi"), F.when(i.isin(0, 2, 5), "10.1000/x"), F.lit("/Subject"), F.when(i == 1, F.concat(F.lit("Energy, see "), doi, F.lit(", 3"))),
        F.lit("/DOI"), F.when(i == 5, doi).otherwise(none),
    )
    first = F.when(i == 2, F.concat(F.lit("A title\n10.1234/\n"), F.substring(doi, 9, 99), F.lit(" and more"))).when(i == 3, F.concat(F.lit("Title  "), apart, F.lit("  more words"))).otherwise("nothing")
    pages = F.array(F.lit("front"), first, F.lit("body"), F.when(i == 4, F.concat(F.lit("end DOI: "), doi)).otherwise("end"))
    found = identity.doi_by_evidence(meta, pages)
    return table(spark, sf_dir, "documents").select("doc_id", found["doi"].alias("doi"), found["origin"].alias("origin"))


_RECORDS = """records AS (SELECT doc_id AS record, CASE WHEN doc_id % 3 = 0 THEN 'p' || (doc_id // 6) END AS paper_id, CASE WHEN doc_id % 4 = 1 THEN 'd' || (doc_id // 10) WHEN doc_id % 12 = 0 THEN 'd' || (doc_id // 10) END AS doi,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE 't' || (doc_id % 97) END AS title FROM documents WHERE doc_id IS NOT NULL),
links AS (SELECT min(record) OVER (PARTITION BY paper_id) AS a, record AS b FROM records WHERE paper_id IS NOT NULL UNION SELECT min(record) OVER (PARTITION BY doi), record FROM records WHERE doi IS NOT NULL
  UNION SELECT a, record FROM (SELECT record, paper_id IS NULL AND doi IS NULL AS bare, first_value(record) OVER (PARTITION BY title ORDER BY paper_id IS NULL AND doi IS NULL, record) AS a FROM records WHERE title <> '') WHERE bare),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT record AS node, record AS seen FROM records UNION SELECT b, seen FROM reach JOIN both_ ON node = a),
members AS (SELECT node AS record, min(seen) AS entity FROM reach GROUP BY node)"""


def _records(spark, sf_dir):
    i = F.col("doc_id")
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(
        i.alias("record"), F.when(i % 3 == 0, name("p", F.floor(i / 6))).alias("paper_id"), F.when((i % 4 == 1) | (i % 12 == 0), name("d", F.floor(i / 10))).alias("doi"),
        F.when(i % 11 == 0, "").otherwise(name("t", i % 97)).alias("title"),
    )


@query("entity_merge", f"""WITH RECURSIVE {_RECORDS} SELECT entity, count(*) AS records, arg_min(paper_id, record) FILTER (WHERE paper_id IS NOT NULL) AS paper_id, arg_min(doi, record) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(title, record) AS title
FROM records JOIN members USING (record) GROUP BY entity""")
def entity_merge(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return entities.merged(rows, entities.resolve(rows, "record", ("paper_id", "doi"), "title"), "record")


@query("entity_edges", f"WITH RECURSIVE {_RECORDS} SELECT DISTINCT s.entity AS src, d.entity AS dst FROM (SELECT record AS a, record // 2 AS b FROM records) e JOIN members s ON a = s.record JOIN members d ON b = d.record WHERE s.entity <> d.entity")
def entity_edges(spark, sf_dir):
    """Citations of records as citations of works."""
    rows = _records(spark, sf_dir)
    edges = rows.select(F.col("record").alias("src"), F.floor(F.col("record") / 2).cast("long").alias("dst"))
    return entities.between(edges, entities.resolve(rows, "record", ("paper_id", "doi"), "title"), "record")


@query("tier_classify", f"WITH {PAPERS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 1 THEN 1 ELSE 2 END AS tier FROM papers")
def tier_classify(spark, sf_dir):
    i = F.col("doc_id")
    url, arxiv = F.when(i % 5 == 0, F.concat(F.lit("http://x/"), i.cast("string"))).when(i % 5 == 1, ""), F.when(i % 7 == 1, "2401.1").when(i % 7 == 2, "")
    return papers(spark, sf_dir).select("doc_id", curation.tier(url, arxiv).alias("tier"))


def _relevant(texts: list[str]) -> list[str]:
    """Stands in for a model: fails on some texts."""
    if any(len(t) % 11 == 0 for t in texts):
        raise ValueError("no answer")
    return ["RELEVANT" if "er" in t else "SKIP" for t in texts]


@query("remembered_gate", """SELECT doc_id, length(text) % 11 = 0 AS failed, length(text) % 11 = 0 OR contains(text, 'er') AS kept,
  CAST((SELECT count(DISTINCT text) FROM documents WHERE length(text) % 11 = 0) AS BIGINT) AS asked_again FROM documents WHERE text IS NOT NULL""")
def remembered_gate(spark, sf_dir):
    """A relevance gate asked twice: the second run asks about what failed alone. What fails stays."""
    docs, store = table(spark, sf_dir, "documents"), _folder(spark, "answers")
    remembered.remembered(docs, "text", _relevant, store)
    held, again = remembered.remembered(docs, "text", _relevant, store)
    rows = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash")).join(held, "hash")
    failed = F.col("error").isNotNull()
    return rows.select("doc_id", failed.alias("failed"), (failed | (F.col("answer") == "RELEVANT")).alias("kept"), F.lit(again).cast("long").alias("asked_again"))
