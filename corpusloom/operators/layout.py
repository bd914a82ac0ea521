"""Page layout: paragraphs of blocks, columns, and passages found on pages.

Blocks are rows (doc, page, block, x0, y0, x1, y1, text) that an extractor gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(blocks: DataFrame, page_width: float) -> DataFrame:
    """blocks with `paragraph`: a new one begins where the gap above is at least twice the
    height (15 at least) or the middle moves by 0.4 of the width or more."""
    along = Window.partitionBy("doc", "page").orderBy("y0", "block")
    gap = F.abs(F.col("y0") - F.lag("y1").over(along))
    middle = (F.col("x0") + F.col("x1")) / 2
    shift = F.abs(middle - F.lag(middle).over(along))
    starts = F.coalesce((gap >= F.greatest((F.col("y1") - F.col("y0")) * 2, F.lit(15.0))) | (shift >= 0.4 * page_width), F.lit(True))
    marked = blocks.withColumn("_s", starts.cast("int"))
    return marked.withColumn("paragraph", F.sum("_s").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def boxes(rows: DataFrame) -> DataFrame:
    """A row for each paragraph: its box and its text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "block", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy("doc", "page", "paragraph").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"), F.count("*").alias("n_blocks"))


def columns(blocks: DataFrame, page_width: float) -> DataFrame:
    """doc, page, boundary between two columns (null for one): pages of five blocks or more
    with middles on both sides, 8 % of the width apart."""
    middle = (F.col("x0") + F.col("x1")) / 2
    half = page_width / 2
    sides = blocks.groupBy("doc", "page").agg(F.count("*").alias("n"), F.max(F.when(middle < half, middle)).alias("l"), F.min(F.when(middle >= half, middle)).alias("r"))
    return sides.select("doc", "page", F.when((F.col("n") >= 5) & (F.col("r") - F.col("l") > 0.08 * page_width), (F.col("l") + F.col("r")) / 2).alias("boundary"))


def lines_within(blocks: DataFrame, found: DataFrame, margin: float = 2.0) -> DataFrame:
    """Blocks of a page that lie within a paragraph's height: joined on the page, then by
    containment."""
    p = found.select("doc", "page", "paragraph", F.col("y0").alias("_a"), F.col("y1").alias("_b"))
    return blocks.join(p, ["doc", "page"]).where((F.col("y0") >= F.col("_a") - margin) & (F.col("y1") <= F.col("_b") + margin)).drop("_a", "_b")
