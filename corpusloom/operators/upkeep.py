"""Keeping a corpus current: upserts, backfills, lookups in tiers, merges and audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing without the keys that come in, and all that comes in; `action` says keep,
    replace or new. Rows without a key are kept, or new."""
    old, new = existing.select(key).where(F.col(key).isNotNull()).distinct(), incoming.select(key).where(F.col(key).isNotNull()).distinct()
    kept = existing.join(new, key, "left_anti").withColumn("action", F.lit("keep"))
    known = incoming.join(old.withColumn("_old", F.lit(True)), key, "left")
    added = known.withColumn("action", F.when(F.col("_old"), "replace").otherwise("new")).drop("_old")
    return kept.unionByName(added.select(*kept.columns))


def missing(rows: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(F.col(done_key or key).alias(key)).distinct(), key, "left_anti")


def is_unknown(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).isin("", "Unknown")


def backfill(rows: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """Fills unknown values of a column from a table (key, column); others stay."""
    names = known.select(key, F.col(column).alias("_known")).where(F.col("_known").isNotNull()).dropDuplicates([key])
    joined = rows.join(names, key, "left")
    return joined.withColumn(column, F.when(is_unknown(column), F.coalesce("_known", column)).otherwise(F.col(column))).drop("_known").select(*rows.columns)


def tiered_lookup(rows: DataFrame, index: DataFrame, candidates: list[Column], key: str, name: str, value: str) -> DataFrame:
    """key, value, tier: the value in the index (name, value) of the first candidate that is
    there. All candidates meet the index in one join."""
    tried = rows.select(key, F.posexplode(F.array(*candidates)).alias("tier", name)).where(F.col(name).isNotNull())
    found = tried.join(index, name).groupBy(key).agg(F.min(F.struct("tier", F.col(value).alias("v"))).alias("best"))
    return rows.select(key).join(found, key, "left").select(key, F.col("best.v").alias(value), F.col("best.tier").alias("tier"))


def merge_checkpoints(disk: DataFrame, old: DataFrame, key: str, status: str = "status") -> DataFrame:
    """All keys of both; what is on disk is done, whatever the old checkpoint says."""
    both = disk.select(key).distinct().withColumn("_disk", F.lit("done")).join(old.select(key, F.col(status).alias("_old")), key, "full_outer")
    return both.select(key, F.coalesce("_disk", "_old").alias(status))


def union_if_few(first: DataFrame, second: DataFrame, key: str, least: int) -> DataFrame:
    """first, and where it has fewer than `least` rows the rest of second too; decided in
    the plan, from a count of one row."""
    few = first.agg((F.count("*") < least).alias("_few"))
    more = second.join(first.select(key).distinct(), key, "left_anti").crossJoin(few).where("_few").drop("_few")
    return first.unionByName(more.select(*first.columns))


def longest_prefix(rows: DataFrame, index: DataFrame, key: str, text: str, name: str, least: int = 15) -> DataFrame:
    """key, matched: the longest prefix of the text (of `least` characters or more, closing
    `.`, `/` and `-` stripped) that the index has. Prefixes are looked up by equality."""
    cuts = F.transform(F.sequence(F.length(text), F.lit(least), F.lit(-1)), lambda n: F.rtrim(F.substring(F.col(text), F.lit(1), n), F.lit("./-")))
    tried = rows.where(F.length(text) >= least).select(key, F.explode(F.array_distinct(F.filter(cuts, lambda c: F.length(c) >= least))).alias(name))
    best = tried.join(index.select(name).distinct(), name, "left_semi").groupBy(key).agg(F.max_by(name, F.length(name)).alias("matched"))
    return rows.select(key).join(best, key, "left")


def contained_names(files: DataFrame, dois: DataFrame, file: str, doi: str) -> DataFrame:
    """Pairs in which a file name contains an identifier: by its suffix, by all of it with
    underscores or full stops for slashes, or by the last part of its suffix. Both sides
    meet at the runs of letters and digits that they hold, then the rules decide."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(file), r"\s*\(\d+\)", ""), ".pdf", "")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    names = files.select(file, clean.alias("_f")).select(file, "_f", F.explode(words(F.col("_f"))).alias("_w"))
    suffix = F.regexp_extract(F.lower(doi), "^[^/]+/(.*)$", 1)
    ids = dois.select(doi, F.lower(doi).alias("_d"), suffix.alias("_s")).where("_s <> ''").select("*", F.element_at(F.filter(F.split("_s", r"[^a-z0-9]+"), lambda w: F.length(w) >= 4), -1).alias("_w"))
    last = F.regexp_extract("_s", r"\.([^.]+)$", 1)
    rule = (
        F.contains("_f", "_s") | F.contains(F.col("_f"), F.replace(F.col("_d"), F.lit("/"), F.lit("_"))) | F.contains(F.col("_f"), F.replace(F.col("_d"), F.lit("/"), F.lit(".")))
        | ((F.length(last) > 4) & F.contains(F.col("_f"), last))
    )
    return names.join(ids, "_w").where(rule).select(file, doi).distinct()


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs by component, order and partner: each order with its first free partner."""
    component, given, last, names = None, set(), None, None
    for batch in batches:
        names = batch.schema.names[1:]
        taken = []
        for comp, one, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if comp != component:
                component, given, last = comp, set(), None
            if one != last and other not in given:
                given.add(other)
                taken.append((one, other))
                last = one
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in taken], batch.schema.field(1 + i).type) for i in (0, 1)], names=names)


def one_to_one(pairs: DataFrame, order: str, other: str, rounds: int = 12) -> DataFrame:
    """A greedy matching: in their order, each row of `order` takes its least partner that no
    earlier one has taken; null ends take no part.

    In a round every pair is decided whose ends are the least of each other: no earlier row can
    take that partner, and there is none that the row would rather have. Their ends go, and with
    them most pairs, wherever they stand; equal ends never gather, only their minimum does.
    What a long chain of rows that wait for each other leaves after `rounds` passes through a
    task for each component, in order."""
    from corpusloom.operators.graph import connected

    rest = cut(pairs.select(order, other).where(F.col(order).isNotNull() & F.col(other).isNotNull()).distinct())
    found = rest.limit(0)
    for _ in range(rounds):
        least = rest.groupBy(order).agg(F.min(other).alias(other)).join(rest.groupBy(other).agg(F.min(order).alias(order)), [order, other])
        taken = cut(least.select(order, other))
        if taken.isEmpty():
            return found
        found = found.unionByName(taken)
        rest = cut(rest.join(taken.select(order), order, "left_anti").join(taken.select(other), other, "left_anti").select(order, other))
    if rest.isEmpty():
        return found
    named = rest.select(*(F.concat(F.lit(n), F.col(c).cast("string")).alias(a) for n, c, a in (("1", order, "a"), ("2", other, "b"))), order, other)
    groups = connected(named.select("a", "b"))
    told = named.join(groups, named.a == groups.node).select("component", order, other)
    told = told.repartition("component").sortWithinPartitions("component", order, other)
    return found.unionByName(told.mapInArrow(_first_free, rest.schema))


def confusion(rows: DataFrame, have: str, should: str, example: str, most: int = 30) -> DataFrame:
    """Counts of (have, should) that differ, with the least example; the `most` largest."""
    wrong = rows.where(F.col(have) != F.col(should)).groupBy(have, should).agg(F.count("*").alias("n"), F.min(example).alias("example"))
    return wrong.orderBy(F.col("n").desc(), have, should).limit(most)


def progress(rows: DataFrame, by: str, done: Column) -> DataFrame:
    """done, total, percent for every value of `by`, and over all (by is null)."""
    out = rows.rollup(by).agg(F.sum(done.cast("long")).alias("done"), F.count("*").alias("total"))
    return out.withColumn("percent", F.round(F.col("done") * 100.0 / F.nullif("total", F.lit(0)), 4))


def pace(done: Column, total: Column, seconds: Column) -> Column:
    """Struct of percent (whole), per_minute and minutes left (0 where nothing is done)."""
    rate = done / F.nullif(seconds, F.lit(0)) * 60
    return F.struct(F.floor(done * 100 / F.nullif(total, F.lit(0))).alias("percent"), F.round(rate, 4).alias("per_minute"), F.when(rate > 0, F.round((total - done) / rate, 4)).otherwise(0.0).alias("minutes_left"))


def file_merge(source: DataFrame, target: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """name, action for every file of the source: drop (same size there), replace (another
    size there; the old one is renamed), move (not there)."""
    there = target.select(name, F.col(size).alias("_there"))
    joined = source.join(there, name, "left")
    return joined.select(name, F.when(F.col("_there").isNull(), "move").when(F.col("_there") == F.col(size), "drop").otherwise("replace").alias("action"))
