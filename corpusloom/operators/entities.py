"""Records of one thing brought together by any of several keys, and edges between things."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import connected
from corpusloom.session import cut


def resolve(records: DataFrame, record: str, strong: tuple[str, ...], weak: str) -> DataFrame:
    """record, entity (its smallest record), for every record.

    Records that share a value of a strong key are one. The weak key (a title) decides only
    for records that have no strong one, as two works may have one title: such a record joins
    the first record of its title that has a strong key, or else the first of all. Every value
    links its records to one of them, so links grow with records, whatever a value's share.
    Null and empty values link nothing."""
    named = records.select(F.col(record).alias("r"), *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*strong, weak)))
    bare = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in strong))

    def links(key: str, order, wanted) -> DataFrame:
        known = named.where(F.col(key).isNotNull()).withColumn("bare", bare)
        first = known.groupBy(key).agg(F.min(order).alias("_f")).select(key, F.col("_f.r").alias("a"))
        return known.where(wanted).join(first, key).select("a", F.col("r").alias("b")).where("a <> b")

    found = [links(c, F.struct("r"), F.lit(True)) for c in strong] + [links(weak, F.struct("bare", "r"), F.col("bare"))]
    groups = connected(cut(reduce(DataFrame.unionByName, found).distinct()))
    return named.select("r").join(groups, named.r == groups.node, "left").select(F.col("r").alias(record), F.coalesce("component", "r").alias("entity"))


def merged(records: DataFrame, members: DataFrame, record: str) -> DataFrame:
    """A row for each entity: of every column the first value, by record, that isn't null, and
    the number of its records."""
    rows = records.join(members, record)
    columns = [c for c in records.columns if c != record]
    return rows.groupBy("entity").agg(F.count("*").alias("records"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(record))).alias(c) for c in columns))


def between(edges: DataFrame, members: DataFrame, record: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of records as edges of entities, each once; those within an entity go."""
    side = lambda n: members.select(F.col(record).alias(n), F.col("entity").alias(f"_{n}"))
    rows = edges.select(src, dst).join(side(src), src).join(side(dst), dst)
    return rows.where(F.col(f"_{src}") != F.col(f"_{dst}")).select(F.col(f"_{src}").alias(src), F.col(f"_{dst}").alias(dst)).distinct()
