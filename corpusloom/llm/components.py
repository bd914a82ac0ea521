"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

HELD = 1 << 16  # nodes that a task joins at a time, about


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as others that join the same nodes: of each node with the smallest that
    it reaches over them, in blocks of bounded size."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) >= HELD:
            yield made()
            root.clear()
    yield made()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node with a link.

    Every round hangs the neighbours of each node under the smallest of them, first the
    larger neighbours, then the smaller ones; paths shrink by half or better in a round.
    Before, every task joins the links at hand, so that few of them need no further rounds.
    A node with very many neighbours is a minimum that partial sums reduce, and, as the
    minima are cut off from their edges, a join whose large side Spark can split; nothing
    gathers at one place. Null ends and links
    of a node with itself are left out; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = cut(edges.mapInArrow(_forests, "u long, v long").distinct())
    before = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        hung = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = cut(hung.groupBy("u").agg(F.min("v").alias("m")))
        joined = hung.join(lowest, "u")
        edges = cut(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
