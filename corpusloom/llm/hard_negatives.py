"""Hard-negative mining by slots of scores.

An anchor's positives each open a window of scores for negatives; windows overlap. Their
upper limits cut the scores into disjoint slots. A task keeps the best few rows of every
slot and gives these alone; what tasks give is cut to the best few of a slot again; and
from the lowest slot up, the best of "this slot and all below" are those of the slot
followed by those of the slots below, cut to as many. A window takes these from its own
slot on, down to its lower limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import Best
from corpusloom.session import cut

#: Components of the anchors of a block, and scores that a task holds at once.
BLOCK = 1 << 21
_SCORES = 1 << 20
_EXACT = 2.0**53


def usable(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, label, v: rows with a key, a label and a vector of finite components."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), v.alias("v"), odd.alias("odd"))
    return rows.where("key is not null and label is not null and v is not null and not odd").drop("odd")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact and within +-2 ** 62."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < _EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -(2**62), 2**62)


class Anchors:
    """The anchors of a block by the length of their vectors."""

    def __init__(self, found: pa.Table, scale: float):
        self.key = found.column("key").to_numpy()
        self.label = found.column("label").to_numpy()
        vectors = [np.floor(scale * np.asarray(v, np.float64)) for v in found.column("v").to_pylist()]
        sizes = np.array([len(v) for v in vectors], np.int64)
        self.by_size = {int(s): (np.flatnonzero(sizes == s), np.stack([v for v in vectors if len(v) == s])) for s in np.unique(sizes)}

    def pairs(self, batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of the rows against the anchors of vectors as long: the anchors' numbers,
        scores (a row for each of them), and the rows' keys and labels."""
        for batch in batches:
            bounds = batch.column("v").offsets.to_numpy()
            flat, sizes = batch.column("v").values.to_numpy(zero_copy_only=False), np.diff(bounds)
            keys, labels = batch.column("key").to_numpy(), batch.column("label").to_numpy()
            for size in np.unique(sizes).tolist():
                which, mine = self.by_size.get(size, (None, None))
                rows = np.flatnonzero(sizes == size) if which is not None else ()
                step = max(1, _SCORES // max(1, len(self.key)))
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    m = np.floor(scale * flat[bounds[at][:, None] + np.arange(size)[None, :]])
                    yield which, products(mine, m), keys[at], labels[at]


class Slots:
    """The best rows of every anchor's slots. limits: upper limits by anchor, descending;
    slot j holds scores above limit j + 1 up to limit j, from the least of use on."""

    def __init__(self, limits: np.ndarray, least: np.ndarray, k: int):
        self.limits, self.least = np.column_stack([limits, np.full(len(limits), -np.inf)]), least
        self.best = [Best(len(limits), k) for _ in range(limits.shape[1])]

    def add(self, which: np.ndarray, scores: np.ndarray, keys: np.ndarray, fits: np.ndarray) -> None:
        fits = fits & (scores >= self.least[which, None]) & (scores <= self.limits[which, :1])
        for j, best in enumerate(self.best):
            mine = fits & (scores <= self.limits[which, j, None]) & (scores > self.limits[which, j + 1, None])
            if mine.any():
                _add(best, which, np.where(mine, scores.astype(np.float64), -np.inf), keys)


def _add(best: Best, which: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
    """Adds scores of the anchors `which` only."""
    if len(which) == len(best.scores):
        return best.add(scores, keys)
    part = Best(len(which), best.k)
    part.scores, part.keys = best.scores[which], best.keys[which]
    part.add(scores, keys)
    best.scores[which], best.keys[which] = part.scores, part.keys


def _first(df: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The k rows of the highest score, the smaller key first, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "key"))).where(F.col(name) <= k)


def _limit(share: int, score: Column, up: bool) -> Column:
    """The largest (smallest) score s with 100 s <= (>=) share * score."""
    part = score.cast("decimal(20, 0)") * share / 100
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of vectors of floor(scale * x); higher ones come first, the
    smaller key on ties. An anchor's positives are the first `positives` other rows of its
    label; of each of them the first `negatives` rows of other labels count whose score is
    between `low` and `high` per cent of the positive's (none if that is below 0).

    `anchors` are the queries, with the columns of rows: they go to the tasks in blocks of
    2 M components and meet all rows where these stand, twice for each block, in matrix
    products. A task gives at most the best few of each slot of an anchor.

    Rows and anchors without key, label or vector, or with a component that is null or not
    finite, take no part. Vectors meet those of the same length only. Of anchors that repeat
    a key the one with the smallest label and vector counts, and rows with the anchor's key
    are the anchor itself; other rows that repeat a key are rows each. Scores beyond 2 ** 53
    are compared as the nearest doubles, within +-2 ** 62. Empty tables give no rows."""
    sent_rows = usable(rows, key, label, vector)
    asked = usable(anchors, key, label, vector).groupBy("key").agg(F.min(F.struct("label", "v")).alias("of")).select("key", "of.*")
    asked = cut(asked)
    components = asked.agg(F.coalesce(F.sum(F.size("v") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-components // BLOCK))
    sc, found = rows.sparkSession.sparkContext, None
    shape = "anchor long, slot int, key long, score double"
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        sent = sc.broadcast(own.orderBy("key").toArrow())

        def alike(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of = Anchors(sent.value, scale)
            best = Best(len(of.key), positives)
            for which, scores, keys, labels in of.pairs(batches, scale) if len(of.key) else ():
                fits = (of.label[which, None] == labels[None, :]) & (of.key[which, None] != keys[None, :])
                if fits.any():
                    _add(best, which, np.where(fits, scores.astype(np.float64), -np.inf), keys)
            yield _rows(of.key, 0, best)

        near = _first(sent_rows.mapInArrow(alike, shape), ["anchor"], positives, "place").withColumn("score", F.col("score").cast("long"))
        near = near.select("anchor", "place", F.col("key").alias("positive"), "score", _limit(high, F.col("score"), False).alias("upper"), _limit(low, F.col("score"), True).alias("lower"))
        near = cut(near.where("upper >= lower"))
        limits = sc.broadcast(near.select("anchor", "place", "upper", "lower").toArrow())

        def unlike(batches: Iterator[pa.RecordBatch], sent=sent, limits=limits) -> Iterator[pa.RecordBatch]:
            of = Anchors(sent.value, scale)
            at = np.searchsorted(of.key, limits.value.column("anchor").to_numpy())
            upper = np.full((len(of.key), positives), -np.inf)
            upper[at, limits.value.column("place").to_numpy() - 1] = limits.value.column("upper").to_numpy()
            least = np.full(len(of.key), np.inf)
            np.minimum.at(least, at, limits.value.column("lower").to_numpy())
            slots = Slots(upper, least, negatives)
            for which, scores, keys, labels in of.pairs(batches, scale) if len(of.key) else ():
                slots.add(which, scores, keys, of.label[which, None] != labels[None, :])
            for j, best in enumerate(slots.best):
                yield _rows(of.key, j, best)

        tops = _first(sent_rows.mapInArrow(unlike, shape), ["anchor", "slot"], negatives, "n")
        lists = tops.groupBy("anchor").agg(*(F.sort_array(F.collect_list(F.when(F.col("slot") == j, F.struct("n", "key", F.col("score").cast("long").alias("score"))))).alias(f"slot{j}") for j in range(positives)))
        below, merged = None, []
        for j in reversed(range(positives)):  # from the lowest slot up
            below = F.col(f"slot{j}") if below is None else F.slice(F.concat(f"slot{j}", below), 1, negatives)
            merged.insert(0, below)
        got = near.join(lists.select("anchor", F.array(*merged).alias("from_slot")), "anchor")
        got = got.select("anchor", "positive", "score", F.posexplode(F.filter(F.element_at("from_slot", F.col("place")), lambda x: x["score"] >= F.col("lower"))).alias("pos", "of"))
        out = got.select(
            F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("of.key").alias("negative_id"), F.col("score").alias("positive_score"), F.col("of.score").alias("negative_score")
        )
        found = out if found is None else found.unionByName(out)
    return found


def _rows(keys: np.ndarray, slot: int, best: Best) -> pa.RecordBatch:
    which, at = np.nonzero(np.isfinite(best.scores))
    names = ["anchor", "slot", "key", "score"]
    return pa.RecordBatch.from_arrays([pa.array(keys[which]), pa.array(np.full(len(which), slot, np.int32)), pa.array(best.keys[which, at]), pa.array(best.scores[which, at])], names=names)


def shifted(embeddings: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 under the next of ten labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return embeddings.withColumn("label", moved)


SQL = """WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3"""
