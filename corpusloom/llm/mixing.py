"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that serves its documents in a shuffled order, again and again
up to its limit of passes. A document's virtual finish time is the number of words that
its source has served with it, divided by the source's target. All passes of all documents
are sorted by it over the whole cluster, and the running total of their words is cut at
the budget. A document that is under way when virtual time 1 comes claims the words that
its source's target still allows, so that a source of few long documents comes near its
target as well; what its claim gets is up to the running total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._words import Words, by_text
from corpusloom.session import cut

WEIGHTS = (5, 2, 1)
#: Documents of a source in one of the runs that running sums are made of, about.
RUN_ROWS = 20_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [x for x in batch.schema.names if x != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in kept), pa.array(np.diff(words.first), pa.int64())], names=[*kept, "size"])

    return by_text(batches, "text", make)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, shuffled (the place in its source) and the number of words of every row."""
    return docs.select(*_columns()).mapInArrow(_counted, "doc_id long, source string, shuffled string, size long")


def _columns() -> list[Column]:
    text = F.col("text").cast("string")
    order = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text, F.lit("")))))
    return [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.md5(order).alias("shuffled"), text]


def running(rows: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """rows with `upto_x`, the running total of the (long) column x over all rows in order, for
    every x of sums. Rows are range-sorted; each partition adds up its own, and the totals
    of the partitions, few numbers each, say where it starts. Only rows that tie in order
    stand in any order. The result is cut from its lineage, as ranges are sampled."""
    n = max(1, -(-rows.count() // RUN_ROWS))
    kept = [*rows.columns, *(f"upto_{x}" for x in sums)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"upto_{x} long" for x in sums])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(sums, 0)
        for batch in batches:
            if batch.num_rows:
                upto = {x: np.cumsum(batch.column(x).to_numpy(zero_copy_only=False)) + total[x] for x in sums}
                total = {x: int(v[-1]) for x, v in upto.items()}
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(upto[x], pa.int64()) for x in sums)], names=kept)

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(added, schema)
    placed = cut(dealt.withColumn("part", F.spark_partition_id()))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(*(F.max(f"upto_{x}").alias(f"all_{x}") for x in sums))
    before = before.select("part", *(F.coalesce(F.sum(f"all_{x}").over(along), F.lit(0)).alias(f"before_{x}") for x in sums))
    joined = placed.join(F.broadcast(before), "part")
    return joined.select(*rows.columns, *((F.col(f"upto_{x}") + F.col(f"before_{x}")).alias(f"upto_{x}") for x in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = 150, passes: int = 2) -> DataFrame:
    """source, source_size, n_rows, target: a share by weight of `budget_percent` of all
    words, but `passes` times the source's own size at most; what that leaves over goes
    to the others by weight, until none is above. Sources by code point (null last) get
    the weights in turn.

    With sources ordered by limit over weight, those above their share come first, so one
    pass with running sums finds the level at which the rest is shared.
    """
    sums = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    cycle = F.array(*map(F.lit, weights))
    named = running(sums.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one").drop("one")
    named = named.withColumn("weight", F.element_at(cycle, F.pmod(F.col("upto_one") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")).drop("upto_one")
    named = named.withColumn("limit_", F.col("source_size") * passes).withColumn("ratio", F.col("limit_") / F.col("weight"))
    summed = running(named, [F.col("ratio"), F.col("source").asc_nulls_last()], "limit_", "weight")
    total = sums.agg(F.sum("source_size").alias("words")).crossJoin(named.agg(F.sum("weight").alias("weights")))
    share = (F.col("words") * F.lit(budget_percent) / F.lit(100) - (F.col("upto_limit_") - F.col("limit_"))) / (F.col("weights") - F.col("upto_weight") + F.col("weight"))
    level = summed.crossJoin(F.broadcast(total)).withColumn("share", share)
    fits = level.where("share <= ratio").agg(F.min(F.struct("ratio", "share"))["share"].alias("level"))
    return level.crossJoin(F.broadcast(fits)).select(
        "source", "source_size", "n_rows", F.least(F.col("limit_").cast("double"), F.coalesce(F.col("level"), F.col("ratio")) * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = 150, passes: int = 2) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words that the
    mix takes, over all passes), virtual_finish (of the first pass), in its order.

    The shuffled order of a source is by the MD5 of doc_id, so reruns agree. Running sums
    within a source are taken in runs of bounded length, cut by the leading digits of the
    MD5 (more digits for larger inputs), and the sums of the runs are then added up; a
    source with a third of all rows is dealt out like any other.

    Null texts have size 0; a null source is a source; rows without doc_id are dealt out by
    the MD5 of their texts; repeated rows are documents each. Sources of no words have
    target 0. Ties in MD5 (repeated rows) stand in order of size; rows that tie in that as
    well are alike. An empty table gives an empty result.
    """
    sizes = cut(sized(docs))
    return _mixed(sizes, sizes, weights, budget_percent, passes).orderBy("virtual_finish", "doc_id")


def _mixed(sizes: DataFrame, rows: DataFrame, weights: tuple[int, ...], budget_percent: int, passes: int) -> DataFrame:
    """The mix of rows, which are those of sizes and may have further columns: these are carried along."""
    shares = cut(targets(sizes, weights, budget_percent, passes))
    seen = shares.agg(F.max("n_rows"), F.sum("source_size")).first()
    budget = min((seen[1] or 0) * budget_percent // 100, (seen[1] or 0) * passes)
    digits = 1
    while (seen[0] or 0) > RUN_ROWS * 16**digits:
        digits += 1
    keyed = lambda d: d.withColumn("run", F.substring("shuffled", 1, digits))
    runs = keyed(sizes).groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    up_to = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("served", F.coalesce(F.sum("run_size").over(up_to), F.lit(0)))
    share = shares.select(F.col("source").alias("of"), "source_size", "target")
    runs = cut(runs.join(share, runs.source.eqNullSafe(share.of)).select(F.col("source").alias("of"), F.col("run").alias("of_run"), "served", "source_size", "target"))

    def placed(some: DataFrame, *ties: str) -> DataFrame:
        """The words that the source has served before each row, and what is known of the source."""
        within = Window.partitionBy("source", "run").orderBy("shuffled", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = keyed(some).withColumn("upto", F.sum("size").over(within))
        joined = ranked.join(runs, ranked.source.eqNullSafe(runs.of) & (ranked.run == runs.of_run))
        return joined.withColumn("start", F.col("served") + F.col("upto") - F.col("size"))

    # all passes of all documents in order of virtual finish, cut where their words reach the budget
    served = placed(sizes).withColumn("start", F.explode(F.array(*(F.col("start") + F.col("source_size") * p for p in range(passes)))))
    whole_words, last_word = F.floor(F.round("target", 6)), F.ceil(F.round("target", 6))
    claim = F.greatest(F.lit(0), F.least(F.col("size"), whole_words - F.col("start"))).cast("long")
    # of a target that ends within a word, the word is claimed by itself
    odd = ((last_word > whole_words) & (F.col("start") <= whole_words) & (whole_words < F.col("start") + F.col("size"))).cast("long")
    claims = F.array(F.struct(F.col("start"), claim.alias("claim")), F.struct(whole_words.cast("long").alias("start"), odd.alias("claim")))
    items = served.select("source", "shuffled", "target", F.inline(claims)).where("claim > 0").withColumn("finish", (F.col("start") + F.col("claim")) / F.col("target"))
    total = running(cut(items.drop("target")), [F.col("finish"), F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("start")], "claim")
    got = F.greatest(F.lit(0), F.least(F.col("claim"), F.lit(budget) - F.col("upto_claim") + F.col("claim")))
    taken_of = cut(total.groupBy("source").agg(F.sum(got).alias("source_taken"))).withColumnRenamed("source", "by")

    further = [c for c in rows.columns if c not in sizes.columns]
    whole = placed(rows, *further[:1])
    whole = whole.join(taken_of, whole.source.eqNullSafe(taken_of.by), "left").withColumn("source_taken", F.coalesce("source_taken", F.lit(0)))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.col("source_taken") - F.col("start") - F.col("source_size") * p)) for p in range(passes)), F.lit(0))
    return whole.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        ((F.col("start") + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))).alias("virtual_finish"), *further,
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with their columns, size, source_size,
    target and taken. Every row goes through the mix with its columns, so repeated rows of
    one doc_id, and rows without one, have the words that were taken of each. Null texts, and
    texts without words, have none to take and are left out; of documents that tie in the
    shuffled order the smaller doc_id, then the hash of the text, comes first; a null source is
    one of its kind, after all others; an empty table gives no rows."""
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    # the first further column orders ties
    whole = docs.select(*_columns(), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.struct(*kept).alias("row"))
    schema = T.StructType([*(T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("source", T.StringType()), ("shuffled", T.StringType()), ("tie", T.LongType()))), T.StructField("row", whole.schema["row"].dataType), T.StructField("size", T.LongType())])
    mixed = _mixed(cut(sized(docs)), whole.mapInArrow(_counted, schema), WEIGHTS, 150, 2).where("taken > 0")
    return mixed.select(*(F.col("row")[c].alias(c) for c in kept), "size", "source_size", "target", "taken")


SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(length(regexp_replace(' ' || coalesce(text, ''), '[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]', chr(1), 'g'))
    - length(replace(regexp_replace(' ' || coalesce(text, ''), '[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]', chr(1), 'g'), chr(1), '')) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, sum(size) AS source_size FROM sizes GROUP BY source),
named AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
rated AS (SELECT *, 2 * source_size AS lim, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM named),
levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM sums) * 150 AS DOUBLE) / 100
    - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM rated),
level AS (SELECT share FROM levels WHERE share <= ratio ORDER BY ratio, share LIMIT 1),
shares AS (SELECT source, source_size, least(CAST(lim AS DOUBLE), coalesce((SELECT share FROM level), ratio) * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, md5(coalesce(CAST(s.doc_id AS VARCHAR), '~' || md5(s.text))) AS shuffled,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '~' || md5(s.text))), s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start_
  FROM sizes s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT source, shuffled, size, target, start_ + pass * source_size AS begin_, floor(round(target, 6)) AS whole_, ceil(round(target, 6)) AS last_ FROM placed, (SELECT unnest([0, 1]) AS pass)),
claims AS (
  SELECT source, shuffled, target, begin_, greatest(0, least(size, whole_ - begin_)) AS claim FROM passes
  UNION ALL SELECT source, shuffled, target, whole_, 1 FROM passes WHERE last_ > whole_ AND begin_ <= whole_ AND whole_ < begin_ + size),
items AS (SELECT *, (begin_ + claim) / target AS finish FROM claims WHERE claim > 0),
total AS (SELECT *, sum(claim) OVER (ORDER BY finish, source NULLS LAST, shuffled, begin_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM items),
got AS (SELECT source, sum(greatest(0, least(claim, (SELECT sum(source_size) FROM sums) * 150 // 100 - upto + claim))) AS got FROM total GROUP BY source)
SELECT doc_id, p.source, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(size, coalesce(got, 0) - start_)) + greatest(0, least(size, coalesce(got, 0) - start_ - source_size)) AS BIGINT) AS taken,
  (start_ + size) / nullif(target, 0) AS virtual_finish
FROM placed p LEFT JOIN got g ON p.source IS NOT DISTINCT FROM g.source
"""
