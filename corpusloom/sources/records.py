"""Scans and sinks of records: JSON Lines, keyed scans, files, logs, split and versioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Raw metadata of a paper, as harvested.
RAW_PAPER = (
    "paperId string, title string, abstract string, authors array<string>, year int, venue string, citationCount int, doi string, arxivId string,"
    " fieldsOfStudy array<string>, openAccessUrl string, _query_source string, _harvested_at timestamp"
)
#: A chunk, the unit of retrieval, with its vector on the row.
CHUNK = (
    "id long, idx long, content string, source string, journal string, journal_rank int, _s2_citation_count int, _s2_year int, _s2_paper_id string,"
    " _s2_tier int, _s2_doi string, _extract_method string, _paper_type string, embedding array<float>"
)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a fixed schema; blank lines are none, broken ones are null rows."""
    return spark.read.schema(schema).json(path)


def keyed(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The last row of each key (trimmed, in lower case); rows without one are left out."""
    named = rows.withColumn("_key", F.lower(F.trim(key))).where(F.length("_key") > 0)
    best = named.groupBy("_key").agg(F.max_by(F.struct(*rows.columns), order).alias("_"))
    return best.select(F.col("_key").alias("key"), "_.*")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, length, year of all files below a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("name"), "length", F.regexp_extract("path", r"/(\d{4})/", 1).alias("year"))


def first_by_name(listed: DataFrame) -> DataFrame:
    return listed.groupBy("name").agg(F.min_by(F.struct("path", "length"), "path").alias("_")).select("name", "_.*")


def is_document(content: Column, length: Column, least: int = 1_000) -> Column:
    """Large enough, and begins as a PDF does."""
    return (length > least) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def run_log(text: Column) -> Column:
    """Struct of the last energy, the first dipole and the status of a calculation's log."""
    energies = F.regexp_extract_all(text, F.lit(r"SCF Done:\s+E\([^)]*\)\s*=\s*(-?\d+\.\d+)"), F.lit(1))
    dipole = F.regexp_extract(text, r"Dipole moment[^\n]*\n[^\n]*Tot=\s*(-?\d+\.\d+)", 1)
    status = F.when(F.contains(text, F.lit("Normal termination")), "done").when(F.contains(text, F.lit("Error termination")), "failed").otherwise("running")
    return F.struct(F.get(energies, F.size(energies) - 1).cast("double").alias("energy"), F.nullif(dipole, F.lit("")).cast("double").alias("dipole"), status.alias("status"))


def harvest_plan(queries: DataFrame, years: list[int], done: DataFrame) -> DataFrame:
    """(query, year) still to fetch: the product of two short lists less what is done."""
    wanted = queries.select("query", F.explode(F.array(*map(F.lit, years))).alias("year"))
    return wanted.join(done.select("query", "year"), ["query", "year"], "left_anti")


def on_topic(title: Column, abstract: Column, words: tuple[str, ...]) -> Column:
    """Any of the words in the title or abstract, whatever the case."""
    text = F.lower(F.concat_ws(" ", title, abstract))
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w))


def cited_enough(year: Column, citations: Column, fresh: int = 2025, least: int = 50) -> Column:
    return F.coalesce(citations, F.lit(0)) >= F.when(year >= fresh, 0).otherwise(least)


def write_split(rows: DataFrame, path: str, *by: str) -> None:
    """One folder for each value of the columns `by`."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key is not there yet, one of each key (the least by all columns);
    the number of them. Rows without a key are left out, as nothing would know them again."""
    spark = rows.sparkSession
    there = spark.read.schema(rows.schema).parquet(path).select(key)
    kept = [c for c in rows.columns if c != key]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*kept)).alias("_")).select(key, "_.*").select(*rows.columns)
    fresh = cut(one.join(there, key, "left_anti"))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def file_away(listed: DataFrame, there: DataFrame, month: str, this_year: str) -> DataFrame:
    """name, year, month of files (name) that no folder has yet: the year is the first 20xx
    of the name, else this one. there: name, year, month."""
    found = F.regexp_extract("name", r"(20\d{2})", 1)
    rows = listed.select("name", F.when(found == "", F.lit(this_year)).otherwise(found).alias("year"), F.lit(month).alias("month")).distinct()
    return rows.join(there.select("name", "year", "month"), ["name", "year", "month"], "left_anti")
