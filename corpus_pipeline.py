"""The corpus pipeline: documents in, a decontaminated and weighted training mix out.

Every stage works on all rows that its predecessor kept, and its result is written as
Parquet before the next stage reads it. Columns beyond those of documents are carried along
by every stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.decontaminate import without_matches
from corpusloom.llm.line_dedup import drop_recurring
from corpusloom.llm.mixing import mix_documents
from corpusloom.llm.near_dup import keep_one
from corpusloom.llm.quality import select_good
from corpusloom.session import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, keeps. Null texts and texts without
    words go; repeated rows, and rows without doc_id, are judged by their text."""
    return select_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates, which the carrier with the smallest
    doc_id keeps. Every row stays, those with null or emptied texts as well."""
    return drop_recurring(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that with the smallest doc_id, and one of
    repeated rows of a doc_id; rows without doc_id, and each text without words, stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`; null and empty texts hold none, and repeated
    rows stay or go together."""
    return without_matches(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words that it takes of each row: repeated rows, and rows
    without doc_id, are documents each; texts without words have none to take and go."""
    return mix_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier is trained, templates and signatures are hashes: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
