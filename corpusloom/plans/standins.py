"""Columns of literature records, derived from the given tables, in Spark and in SQL.

The tables hold no citations, venues or identifiers; these stand-ins give every operator
that needs them the same values on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vocabulary
from corpusloom.session import table

VENUES = (
    "Nature", "Nature Energy", "Adv. Mater.", "Advanced Science", "Science", "J. Am. Chem. Soc.", "Energy & Environmental Science",
    "Angewandte Chemie International Edition", "ACS Energy Lett.", "Unknown", "", "Journal of Materials Chemistry A (Print)", "Nano Letters",
)

PUBLISHERS = tuple(vocabulary.PUBLISHERS)


def pick(values: tuple[str, ...], index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with title, journal_rank, citations, year, tier, doi, publisher_doi, venue."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    group = F.floor(F.col("doc_id") / 3).cast("long")
    # before the join, so that a text goes through it only where it is asked for
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.substring("text", 1, 80).alias("title"),
        (F.col("doc_id") % 7 + 1).cast("int").alias("journal_rank"),
        (F.col("n_chars") % 50).cast("int").alias("citations"),
        (F.col("doc_id") % 18 + 2009).cast("int").alias("year"),
        F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("10."), (group % 16 + 1000).cast("string"), F.lit("/x"), group.cast("string"))).alias("doi"),
        F.when(F.col("doc_id") % 10 != 0, F.concat(pick(PUBLISHERS, group % 16), F.lit("/x"), group.cast("string"))).alias("publisher_doi"),
        pick(VENUES, F.col("doc_id") % len(VENUES)).alias("venue"),
    )
    tier = F.when(F.col("quality") == 1, 1).otherwise(2).alias("tier")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "title", "journal_rank", "citations", "year", tier, "doi", "publisher_doi", "venue")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


PAPERS = f"""papers AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, substring(d.text, 1, 80) AS title,
    CAST(d.doc_id % 7 + 1 AS INTEGER) AS journal_rank, CAST(d.n_chars % 50 AS INTEGER) AS citations,
    CAST(d.doc_id % 18 + 2009 AS INTEGER) AS year, CASE WHEN l.quality = 1 THEN 1 ELSE 2 END AS tier,
    CASE WHEN d.doc_id % 10 <> 0 THEN '10.' || CAST((d.doc_id // 3) % 16 + 1000 AS VARCHAR) || '/x' || CAST(d.doc_id // 3 AS VARCHAR) END AS doi,
    CASE WHEN d.doc_id % 10 <> 0 THEN {sql_list(PUBLISHERS)}[CAST((d.doc_id // 3) % 16 + 1 AS INTEGER)] || '/x' || CAST(d.doc_id // 3 AS VARCHAR) END AS publisher_doi,
    {sql_list(VENUES)}[CAST(d.doc_id % {len(VENUES)} + 1 AS INTEGER)] AS venue
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
