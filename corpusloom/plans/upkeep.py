"""Queries of upserts, backfills, lookups and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import identity as i
from corpusloom.operators import upkeep as u
from corpusloom.plans.records import _PUB
from corpusloom.plans.standins import PAPERS, papers
from corpusloom.registry import query
from corpusloom.session import table


@query("upsert_replace_new", f"""WITH {PAPERS}, old AS (SELECT doc_id, doi, 0 AS version FROM papers WHERE doc_id % 3 <> 2), new AS (SELECT doc_id, doi, 1 AS version FROM papers WHERE doc_id % 5 = 0)
SELECT *, 'keep' AS action FROM old WHERE doi IS NULL OR doi NOT IN (SELECT doi FROM new WHERE doi IS NOT NULL)
UNION ALL SELECT *, CASE WHEN doi IN (SELECT doi FROM old WHERE doi IS NOT NULL) THEN 'replace' ELSE 'new' END FROM new""")
def upsert_replace_new(spark, sf_dir):
    rows = papers(spark, sf_dir)
    old = rows.where("doc_id % 3 <> 2").select("doc_id", "doi", F.lit(0).alias("version"))
    new = rows.where("doc_id % 5 = 0").select("doc_id", "doi", F.lit(1).alias("version"))
    return u.upsert(old, new, "doi")


@query("missing_embeddings", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf_dir):
    return u.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), "doc_id", "vec_id").select("doc_id", "source")


_UNKNOWN = "venue IS NULL OR venue IN ('', 'Unknown')"


@query("backfill_left_join", f"""WITH {PAPERS}, known AS (SELECT DISTINCT doi, 'Journal ' || doi AS name FROM papers WHERE doi IS NOT NULL AND doc_id % 2 = 0)
SELECT doc_id, p.doi, CASE WHEN {_UNKNOWN} THEN coalesce(name, venue) ELSE venue END AS venue FROM papers p LEFT JOIN known k ON p.doi = k.doi""")
def backfill_left_join(spark, sf_dir):
    rows = papers(spark, sf_dir).select("doc_id", "doi", "venue")
    known = rows.where("doi is not null and doc_id % 2 = 0").select("doi", F.concat(F.lit("Journal "), "doi").alias("venue")).distinct()
    return u.backfill(rows, known, "doi", "venue")


@query("missing_journal_report", f"WITH {PAPERS} SELECT coalesce(nullif(venue, ''), '(empty)') AS label, doi IS NOT NULL AS has_doi, count(*) AS n, count(DISTINCT doi) AS dois FROM papers WHERE {_UNKNOWN} GROUP BY 1, 2")
def missing_journal_report(spark, sf_dir):
    rows = papers(spark, sf_dir).where(u.is_unknown("venue"))
    return rows.groupBy(F.coalesce(F.nullif("venue", F.lit("")), F.lit("(empty)")).alias("label"), F.col("doi").isNotNull().alias("has_doi")).agg(F.count("*").alias("n"), F.countDistinct("doi").alias("dois"))


@query("tiered_lookup", f"""WITH {PAPERS}, idx AS (SELECT replace(doi, '/', '_') AS name, min(doc_id) AS path FROM papers WHERE doi IS NOT NULL AND doc_id % 2 = 1 GROUP BY 1 UNION ALL SELECT DISTINCT source, -1 FROM papers WHERE source LIKE '%1'),
tried AS (SELECT doc_id, 0 AS tier, source AS name FROM papers UNION ALL SELECT doc_id, 1, substring(source, 4) FROM papers UNION ALL SELECT doc_id, 2, replace(doi, '/', '_') FROM papers UNION ALL SELECT doc_id, 3, lower(replace(doi, '/', '_')) FROM papers),
best AS (SELECT doc_id, tier, path, row_number() OVER (PARTITION BY doc_id ORDER BY tier, path) AS r FROM tried JOIN idx USING (name))
SELECT p.doc_id, CAST(path AS BIGINT) AS path, b.tier FROM papers p LEFT JOIN best b ON p.doc_id = b.doc_id AND r = 1""")
def tiered_lookup(spark, sf_dir):
    rows = papers(spark, sf_dir)
    file = F.translate("doi", "/", "_")
    index = rows.where("doi is not null and doc_id % 2 = 1").groupBy(file.alias("name")).agg(F.min("doc_id").alias("path")).unionByName(rows.where("source like '%1'").select(F.col("source").alias("name"), F.lit(-1).cast("long").alias("path")).distinct())
    return u.tiered_lookup(rows, index, [F.col("source"), F.substring("source", 4, 99), file, F.lower(file)], "doc_id", "name", "path")


@query("checkpoint_merge", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 'done' ELSE l.status END AS status FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL OUTER JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'pending' END AS status FROM labels) l ON d.doc_id = l.doc_id")
def checkpoint_merge(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("pending").alias("status"))
    return u.merge_checkpoints(table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), old, "doc_id")


@query("fallback_union", "WITH first_ AS (SELECT doc_id FROM documents WHERE n_chars > 15000) SELECT doc_id FROM first_ UNION ALL SELECT doc_id FROM documents WHERE n_chars > 9000 AND (SELECT count(*) FROM first_) < 1000000 AND doc_id NOT IN (SELECT doc_id FROM first_)")
def fallback_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return u.union_if_few(docs.where("n_chars > 15000").select("doc_id"), docs.where("n_chars > 9000").select("doc_id"), "doc_id", 1_000_000)


@query("pending_work", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) AND d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_work(spark, sf_dir):
    left = u.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return u.missing(left, table(spark, sf_dir, "embeddings"), "doc_id", "vec_id").select("doc_id")


@query("longest_prefix_match", f"""WITH {PAPERS}, long_ AS (SELECT doc_id, doi || '.suppl-' || CAST(doc_id AS VARCHAR) AS t FROM papers WHERE doi IS NOT NULL),
cuts AS (SELECT DISTINCT doc_id, rtrim(substring(t, 1, CAST(n AS INTEGER)), './-') AS name FROM (SELECT doc_id, t, unnest(range(8, length(t) + 1)) AS n FROM long_)),
best AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC) AS r FROM cuts WHERE length(name) >= 8 AND name IN (SELECT doi FROM papers WHERE doc_id % 2 = 1 AND doi IS NOT NULL))
SELECT l.doc_id, b.name AS matched FROM long_ l LEFT JOIN best b ON l.doc_id = b.doc_id AND r = 1""")
def longest_prefix_match(spark, sf_dir):
    rows = papers(spark, sf_dir).where("doi is not null")
    long = rows.select("doc_id", F.concat("doi", F.lit(".suppl-"), F.col("doc_id").cast("string")).alias("t"))
    return u.longest_prefix(long, rows.where("doc_id % 2 = 1").select(F.col("doi").alias("name")), "doc_id", "t", "name", least=8)


_FILES = "files AS (SELECT 'a ' || replace(doi, '/', CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '.' END) || 'zz (1).PDF' AS file FROM papers WHERE doi IS NOT NULL), dois AS (SELECT DISTINCT doi || 'zz' AS doi FROM papers WHERE doi IS NOT NULL)"


@query("filename_theta_join", rf"""WITH {PAPERS}, {_FILES}, f AS (SELECT DISTINCT file, replace(regexp_replace(lower(file), '\s*\(\d+\)', '', 'g'), '.pdf', '') AS c FROM files)
SELECT file, doi FROM f JOIN dois ON contains(c, split_part(doi, '/', 2)) OR contains(c, replace(doi, '/', '_')) OR contains(c, replace(doi, '/', '.'))""")
def filename_theta_join(spark, sf_dir):
    return u.contained_names(*_named(spark, sf_dir), "file", "doi")


def _named(spark, sf_dir):
    rows = papers(spark, sf_dir).where("doi is not null")
    name = F.concat(F.lit("a "), F.when(F.col("doc_id") % 2 == 0, F.translate("doi", "/", "_")).otherwise(F.translate("doi", "/", ".")), F.lit("zz (1).PDF"))
    return rows.select(name.alias("file")).distinct(), rows.select(F.concat("doi", F.lit("zz")).alias("doi")).distinct()


@query("filename_matching")
def filename_matching(spark, sf_dir):
    return u.one_to_one(u.contained_names(*_named(spark, sf_dir), "file", "doi"), "doi", "file")


@query("audit_confusion", f"""WITH {PAPERS} SELECT publisher, filed, n, example FROM (SELECT *, row_number() OVER (ORDER BY n DESC, filed, publisher) AS r FROM (
  SELECT {_PUB} AS publisher, CASE WHEN doc_id % 4 = 0 THEN 'nature' ELSE {_PUB} END AS filed, count(*) AS n, min(doc_id) AS example FROM papers GROUP BY 1, 2) WHERE publisher <> filed) WHERE r <= 30""")
def audit_confusion(spark, sf_dir):
    right = i.publisher(F.col("publisher_doi"))
    rows = papers(spark, sf_dir).select("doc_id", right.alias("publisher"), F.when(F.col("doc_id") % 4 == 0, "nature").otherwise(right).alias("filed"))
    return u.confusion(rows, "filed", "publisher", "doc_id")


@query("publisher_progress", f"""WITH {PAPERS} SELECT publisher, CAST(sum(d) AS BIGINT) AS done, count(*) AS total, round(sum(d) * 100.0 / count(*), 4) AS percent FROM (
  SELECT {_PUB} AS publisher, CASE WHEN tier = 1 THEN 1 ELSE 0 END AS d FROM papers) GROUP BY ROLLUP (publisher)""")
def publisher_progress(spark, sf_dir):
    rows = papers(spark, sf_dir).select(i.publisher(F.col("publisher_doi")).alias("publisher"), "tier")
    return u.progress(rows, "publisher", F.col("tier") == 1)


@query("file_merge_plan", "SELECT a.doc_id AS name, CASE WHEN b.doc_id IS NULL THEN 'move' WHEN b.size = a.n_chars THEN 'drop' ELSE 'replace' END AS action FROM documents a LEFT JOIN (SELECT doc_id, n_chars + doc_id % 3 AS size FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id")
def file_merge_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    there = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("name"), (F.col("n_chars") + F.col("doc_id") % 3).alias("size"))
    return u.file_merge(docs.select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size")), there)


