"""Rankings within groups, selections, islands and merges of neighbours, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


def top_per_group(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def numbered(rows: DataFrame, order: list[Column], name: str = "id", part_rows: int = 100_000) -> DataFrame:
    """rows with dense numbers from 0 in a global order: rows are range-sorted, each partition
    numbers its own, and the sizes of the partitions before say where it starts."""
    n = max(1, -(-rows.count() // part_rows))
    placed = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_at")).alias(name), *rows.columns)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (from 1) of at most 100 rows, with the totals."""
    size = min(max(size, 1), 100)
    total = rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("total_pages"))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size).crossJoin(total)


def reviews_first(pool: DataFrame, by: str, n: int, most_reviews: int = 2) -> DataFrame:
    """Per `by`, at most two reviews by journal_score, then experiments by score, n in all.
    pool: by, id, kind, journal_score, score."""
    review = F.col("kind") == "review"
    value = F.when(review, F.col("journal_score")).otherwise(F.col("score"))
    within = Window.partitionBy(by, "kind").orderBy(value.desc(), "id")
    rows = pool.withColumn("_place", F.row_number().over(within)).where(~review | (F.col("_place") <= most_reviews)).where(F.col("_place") <= n)
    chosen = F.row_number().over(Window.partitionBy(by).orderBy(F.when(review, 0).otherwise(1), "_place"))
    return rows.withColumn("place", chosen).where(F.col("place") <= n).drop("_place")


def diverse(pool: DataFrame, by: str, n: int) -> DataFrame:
    """Per `by`, in order of score, those of a journal not chosen yet, or any when one place
    is left; n in all. The choices before the last place are the n - 1 journals whose best
    rows come first, each by its best row; the last place takes the row that comes next."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    own = Window.partitionBy(by, "journal").orderBy(F.col("score").desc(), "id")
    rows = pool.withColumn("_order", F.row_number().over(order)).withColumn("_first", F.row_number().over(own) == 1)
    rows = rows.withColumn("_n", F.when(F.col("_first"), F.row_number().over(Window.partitionBy(by, "_first").orderBy("_order"))))
    upto = F.max(F.when(F.col("_n") == n - 1, F.col("_order"))).over(Window.partitionBy(by)) if n > 1 else F.lit(0)
    rows = rows.withColumn("place", F.when(F.col("_n") < n, F.col("_n")).when(F.col("_order") == upto + 1, n))
    return rows.where("place is not null").select(F.col(by).cast("long").alias(by), F.col("id").cast("long").alias("id"), F.col("place").cast("int").alias("place"))


def empty_islands(rows: DataFrame, by: str, position: str, width: float, least: int = 2) -> DataFrame:
    """Runs of at least `least` empty bins (a twentieth of the width each) between 30 % and
    70 % of the width: by, first_bin, n_bins."""
    step = width * 0.05
    used = rows.select(by, F.floor(F.col(position) / step).cast("int").alias("bin")).distinct()
    bins = rows.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(6), F.lit(13))))
    empty = bins.join(used, [by, "bin"], "left_anti")
    island = F.col("bin") - F.row_number().over(Window.partitionBy(by).orderBy("bin"))
    return empty.withColumn("_island", island).groupBy(by, "_island").agg(F.min("bin").alias("first_bin"), F.count("*").alias("n_bins")).where(F.col("n_bins") >= least).drop("_island")


def merged_neighbours(rows: DataFrame, by: str, order: str, starts: Column) -> DataFrame:
    """rows with `paragraph`, which grows wherever `starts` (of `lag`-like columns) is true."""
    along = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("paragraph", F.sum("_start").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_start")
