"""Queries of the operators of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, hard_negatives, language, lexical, line_dedup, media, mixing, near_dup, passages, quality, secrets, tool_calls, toxicity
from corpusloom.session import table


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


def op2_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents and within one."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.inspect(media.pack(table(spark, sf_dir, "documents"))))


def op6_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grades put together from the labels quality and toxic (see `quality.graded`)."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels"))))


def op8_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.derived(table(spark, sf_dir, "conversations")), tool_calls.TOOLS)


def op9_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_hard_negative_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50."""
    rows = hard_negatives.shifted(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(rows, rows.where("vec_id % 50 = 0"))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical.search(lexical.build(docs), docs, table(spark, sf_dir, "benchmark"))


def op13_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


_QUERIES = (
    op1_simhash_decontamination,
    op2_collinear_passages,
    op3_minmax_near_dup,
    op4_line_templates,
    op5_media_signatures,
    op6_toxicity_lexicon,
    op7_ordinal_quality,
    op8_tool_call_links,
    op9_fair_queue_mix,
    op10_secret_ownership,
    op11_hard_negative_slots,
    op12_bit_sliced_search,
    op13_string_kernel_language,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_simhash_decontamination": decontaminate.SQL, "op3_minmax_near_dup": near_dup.SQL, "op4_line_templates": line_dedup.SQL, "op8_tool_call_links": tool_calls.SQL,
        "op9_fair_queue_mix": mixing.SQL, "op10_secret_ownership": secrets.SQL, "op11_hard_negative_slots": hard_negatives.SQL, "op12_bit_sliced_search": lexical.SQL,
    }
