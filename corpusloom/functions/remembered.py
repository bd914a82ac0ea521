"""Calls of a model that are kept: a text is asked about once, however often it comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

KEPT = "hash string, answer string, error string"


def remembered(rows: DataFrame, text: str, model: Callable[[list[str]], list[str]], store: str, batch: int = 20) -> tuple[DataFrame, int]:
    """hash, answer, error for each distinct text of rows, and the number of texts asked about.

    Texts are known by their SHA-256. What the Parquet table `store` holds is taken from there;
    the rest goes to the model (a list of texts to a list of answers) in batches, and what it
    says is added to the store. If a batch fails its texts are asked about one by one; an
    exception is the text's error, which is a value here and asked again the next time. A null
    text is not asked about. Texts come to tasks as they are, so none gathers more than its own."""
    spark = rows.sparkSession
    spark.createDataFrame([], KEPT).write.mode("append").parquet(store)
    keyed = rows.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("hash"), F.col(text).alias("text")).dropDuplicates(["hash"])
    there = spark.read.schema(KEPT).parquet(store).where("error is null").select("hash").distinct()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                answers, errors = _asked(model, part["text"].tolist())
                yield pd.DataFrame({"hash": part["hash"], "answer": answers, "error": errors})

    fresh = cut(keyed.join(there, "hash", "left_anti").mapInPandas(ask, KEPT))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(store)
    held = spark.read.schema(KEPT).parquet(store).groupBy("hash").agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "answer", "error")).alias("_")).select("hash", "_.answer", "_.error")
    return held.join(keyed.select("hash"), "hash", "left_semi"), n


def _asked(model: Callable[[list[str]], list[str]], texts: list[str]) -> tuple[list, list]:
    try:
        answers = model(texts)
        if len(answers) == len(texts):
            return answers, [None] * len(texts)
    except Exception:  # noqa: BLE001  one by one
        pass
    found = []
    for t in texts:
        try:
            found.append((model([t])[0], None))
        except Exception as e:  # noqa: BLE001  a text's error is its value
            found.append((None, f"{type(e).__name__}: {e}"))
    return [a for a, _ in found], [e for _, e in found]


def chunked(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[str]], store: str, fallback: Callable[[str], list[str]], mark: str = "\n---\n", least: int = 300, most: int = 2_000) -> DataFrame:
    """key, chunk_no, content, by_model: chunks that a model separates by `mark`, stripped, of
    `least` characters or more, cut to `most`; those of `fallback` where the model fails or no
    chunk of it is long enough."""
    held, _ = remembered(rows, text, model, store)
    parts = F.filter(F.transform(F.split("answer", mark), lambda c: F.trim(c)), lambda c: F.length(c) >= least)
    good = held.select("hash", F.transform(parts, lambda c: F.substring(c, 1, most)).alias("chunks"))
    packed = F.udf(fallback, "array<string>")
    out = rows.select(key, text, F.sha2(text, 256).alias("hash")).join(good, "hash", "left").withColumn("by_model", F.coalesce(F.size("chunks") > 0, F.lit(False)))
    own = out.where("by_model").select(key, "chunks", "by_model")
    other = out.where(~F.col("by_model") & F.col(text).isNotNull()).select(key, packed(text).alias("chunks"), "by_model")
    return own.unionByName(other).select(key, F.posexplode("chunks").alias("chunk_no", "content"), "by_model")
