"""Connected components of pairs a, b by hooking and shortening paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut


def connected(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node). Every round takes the least label around each
    node, then follows labels one step further; rounds end when nothing changes."""
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")))
    while True:
        around = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        hooked = labels.join(around, "u").select("u", F.least("l", "m").alias("n"), "l")
        further = hooked.select(F.col("u").alias("at"), F.col("n").alias("n2"))
        new = cut(hooked.join(further, hooked.n == further.at, "left").select("u", F.least("n", F.coalesce("n2", "n")).alias("l"), F.col("l").alias("old")))
        labels = new.select("u", "l")
        if new.where("l <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
