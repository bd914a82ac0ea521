"""Variants of a query: without stop words, with synonyms, and shortened."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vocabulary import STOP_WORDS, SYNONYMS


def _replaced(words: list[str]) -> Iterator[str]:
    """Phrases of three and two words first, then single words in turn, each with its first
    synonym before any has its second."""
    for n in (3, 2):
        for i in range(len(words) - n + 1):
            for synonym in SYNONYMS.get(" ".join(words[i : i + n]), ())[:1]:
                yield " ".join([*words[:i], synonym, *words[i + n :]])
    for turn in (0, 1):
        for i, word in enumerate(words):
            for synonym in SYNONYMS.get(word, ())[turn : turn + 1]:
                yield " ".join([*words[:i], synonym, *words[i + 1 :]])


def variants(query: str | None, synonyms: int = 2, short: int = 5, long: int = 6) -> list[str]:
    """The query itself, then its distinct variants: its keywords (if three or more are left
    and fewer than all words), `synonyms` of the versions with a synonym, and the first
    `short` words if there are more than `long`."""
    query = query or ""
    words = query.lower().split()
    keywords = [w for w in words if w not in STOP_WORDS]
    bare = [" ".join(keywords)] if 3 <= len(keywords) < len(words) else []
    others = dict.fromkeys(v for v in _replaced(keywords) if v != query.lower())
    brief = [" ".join(words[:short])] if len(words) > long else []
    return [v for v in dict.fromkeys(x.strip() for x in chain([query], bare, islice(others, synonyms), brief)) if v]


def expand(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, variant_no (from 0), variant: a row for each variant of each query."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([variants(x) for x in batch.column("query").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), found], names=["key", "variants"])

    rows = queries.select(F.col(key).cast("long").alias("key"), F.col(text).alias("query")).mapInArrow(made, "key long, variants array<string>")
    return rows.select(F.col("key").alias(key), F.posexplode("variants").alias("variant_no", "variant"))
