"""The library's verbs, assembled from its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.answers import cited, marked, suggestions, unverified, without_suggestions
from corpusloom.functions.expansion import expand
from corpusloom.operators import chunking, curation, ranking, retrieval, upkeep


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, expanded: bool = True, journal: str | None = None, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Hybrid search of every query and its variants; of a source the best score counts.
    docs: doc_id, text, source, tier, citations, venue, year; filters apply before ranking.
    Variants of a query share its vector."""
    if journal is not None:
        docs = docs.where(curation.normalize_venue(F.col("venue")) == journal)
    if year_min is not None:
        docs = docs.where(F.col("year") >= year_min)
    if year_max is not None:
        docs = docs.where(F.col("year") <= year_max)
    asked = queries
    if expanded:
        variants = expand(queries, "query_id", "query_text").select("query_id", "variant_no", "variant")
        asked = variants.join(queries.select("query_id", "query_vector"), "query_id").select((F.col("query_id") * 100 + F.col("variant_no")).alias("query_id"), F.col("variant").alias("query_text"), "query_vector")
    found = retrieval.hybrid(docs, vectors, asked, 2 * k)
    if expanded:
        found = found.withColumn("query_id", F.floor(F.col("query_id") / 100).cast("long"))
    best = found.groupBy("query_id", "source").agg(F.max(F.round("score", 9)).alias("score"))
    return retrieval.ranked(best, "query_id", "score", "source", k)


def curate(papers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Good records, one of each identifier, one of each title, by citations."""
    good = papers.where(curation.is_good(F.col("citations"), F.col("year"), F.col("venue")))
    one = curation.one_per_identifier(good, order=key)
    kept = curation.greedy_titles(one, key, "title", "citations").where("kept").select(key)
    named = one.join(kept, key, "left_semi").withColumn("venue_normalized", curation.normalize_venue(F.col("venue")))
    return named.orderBy(F.coalesce("citations", F.lit(0)).desc(), key)


def chunk_and_embed(texts: DataFrame, embed: Callable, least: int = chunking.LEAST) -> DataFrame:
    """doc_id, idx, content, embedding: packed chunks with the vectors a model gives them,
    on the row, so that they can't come apart."""
    return chunking.packed(texts).where(F.length("content") >= least).withColumn("embedding", embed("content"))


def update(chunks: DataFrame, incoming: DataFrame, make: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """A corpus of chunks after documents came in: those of the same key are replaced.
    Running it again with the same documents changes nothing."""
    fresh = make(incoming)
    return upkeep.upsert(chunks, fresh, key).select(*chunks.columns)


def follow_up(pool: DataFrame, by: str, n: int = 4) -> DataFrame:
    """Unread papers for a follow-up question, by overlap, and of different journals."""
    return ranking.diverse(pool.where("not is_read"), by, n)


def highlights(paragraphs: DataFrame, chunks: DataFrame, n: int = 3, least: float = 0.06) -> DataFrame:
    """For every chunk the paragraphs (doc_id, text) that say it: chunk_id, doc_id, score."""
    return retrieval.overlap_passages(paragraphs, chunks, n).where(F.col("score") > least).select("chunk_id", "doc_id", "score", "rank")


def checked_answers(answers: DataFrame, validated: str = "validated", text: str = "answer") -> DataFrame:
    """answers with citations of unverified documents marked, suggestions taken out, and the
    numbers of both."""
    fake = unverified(F.col(text), F.col(validated))
    rows = answers.withColumn("fake", fake).withColumn("n_cited", F.size(cited(F.col(text)))).withColumn("suggestions", suggestions(F.col(text)))
    return rows.withColumn(text, without_suggestions(marked(F.col(text), F.col("fake"))))
