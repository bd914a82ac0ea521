"""Near-duplicate documents by min-max hashing.

Each document is the set of its distinct runs of five words. Every permutation of the
hash space gives two values of a set, its minimum and its maximum, so that 64
evaluations fill a signature of 128. Two sets agree in each value with the chance of
their Jaccard similarity. Bands of two permutations (four values) bring likely pairs
together; a sketch of the signature (a byte of each value) clears away unlikely ones;
full sets decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._filters import filter_of, id_hash, passes
from corpusloom.llm._words import Words, by_text, mix
from corpusloom.llm.components import components
from corpusloom.session import cut

PERMUTATIONS = 64
BANDS = 32  # of two permutations each: a pair at 0.75 misses all with a chance of 5e-6
#: Sketches of a pair at 0.75 agree in 96 of 128 bytes; in 75 or fewer about once in 5e4 pairs.
LEAST_AGREED = 75
#: Hubs that a member of buckets is tried with.
HUBS = 3
#: Members of a bucket are compared between blocks of about so many, by sketches and then by full sets.
BLOCK, SET_BLOCK = 4096, 256
_CHUNK = 4096


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:PERMUTATIONS, None] | np.uint64(1), drawn[PERMUTATIONS:, None]


def signature(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of a set of hashes (not empty) under every permutation."""
    a, b = _coefficients()
    low = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), _CHUNK):
        turned = a * values[None, at : at + _CHUNK] + b
        np.minimum(low, turned.min(axis=1), out=low)
        np.maximum(high, turned.max(axis=1), out=high)
    return low, high


def summary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands, and the sketch, of a set of hashes (not empty)."""
    low, high = signature(values)
    row = mix(low[::2]) ^ mix(low[1::2] + np.uint64(1)) * np.uint64(3) ^ mix(high[::2] + np.uint64(2)) * np.uint64(5) ^ mix(high[1::2] + np.uint64(3)) * np.uint64(7)
    bands = mix(row + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return bands.view(np.int64), mix(np.concatenate([low, high])).astype(np.uint8)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = words.shingles(k)
        sizes, ids, bands, sketches = [], [], [], []
        for d in range(hi - lo):
            found = np.unique(hashes[first[d] : first[d + 1]])
            sizes.append(len(found))
            if not len(found):
                ids.append(None), bands.append(None), sketches.append(None)
                continue
            own, sketch = summary(found)
            ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            bands.append(own)
            sketches.append(sketch.tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    return by_text(batches, "text", make)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets), bands, sketch of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _signed(batches, k), "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary"
    )


def _agreed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one == other).sum(axis=1)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree well enough."""
    for batch in batches:
        if batch.num_rows:
            good = _agreed(_sketches(batch.column("sketch_a")), _sketches(batch.column("sketch_b"))) > LEAST_AGREED
            yield batch.select(["a", "b"]).filter(pa.array(good))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, so that no cell is cut between batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        other = pc.not_equal(rows.column("cell"), rows.column("cell")[rows.num_rows - 1]).to_numpy(zero_copy_only=False)
        done = rows.num_rows - int(np.argmax(other[::-1])) if other.any() else 0
        held = rows.slice(done)
        if done:
            yield rows.slice(0, done)
    if held is not None:
        yield held


def _candidates(rows: pa.RecordBatch, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within a cell: of unlike components, alike in size and sketch, and in
    the first of the bands that the two share, so that each pair comes up once in all.
    Rows of a cell stand by part; those of a part from 0 up meet the other part alone."""
    cell, part, comp, n, number = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "part", "component", "n", "number"))
    sketch = _sketches(rows.column("sketch"))
    bands = rows.column("bands").flatten().to_numpy().reshape(-1, BANDS)
    ends = lambda *columns: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]), [True]]))
    of_cell, of_part = ends(cell), ends(cell, part)
    last = np.repeat(of_cell[1:], np.diff(of_cell))
    next_part = np.repeat(of_part[1:], np.diff(of_part))
    first = np.where(part < 0, np.arange(len(cell)) + 1, next_part)
    others = last - first
    at = 0
    while at < len(cell):  # so many first members that their pairs stay within bounds
        to = at + max(1, int(np.searchsorted(np.cumsum(others[at:]), 200_000)))
        i = np.repeat(np.arange(at, to), others[at:to])
        j = np.repeat(first[at:to], others[at:to]) + np.arange(len(i)) - np.repeat(np.cumsum(others[at:to]) - others[at:to], others[at:to])
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        good = (comp[i] != comp[j]) & (100 * small >= percent * large)
        i, j = i[good], j[good]
        if len(i):
            good = _agreed(sketch[i], sketch[j]) > LEAST_AGREED
            i, j = i[good], j[good]
        if len(i):
            good = (bands[i] == bands[j]).argmax(axis=1) == number[i]
            yield i[good], j[good]
        at = to


def _in_question(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members that some pair of their cell is to be decided for."""
    for rows in _whole_cells(batches):
        found = [np.concatenate(pair) for pair in _candidates(rows, percent)]
        if found:
            yield pa.RecordBatch.from_arrays([rows.column("rep").take(pa.array(np.unique(np.concatenate(found))))], names=["rep"])


def _linked_within(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components that full sets of a cell's members confirm. Pairs that links
    of the cell join already are passed over, so a cell gives fewer links than it has members."""
    for rows in _whole_cells(batches):
        held = rows.column("held").to_pylist()
        sets: dict[int, np.ndarray] = {}
        root = {}

        def find(x: int, root: dict = root) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        links: list[tuple[int, int]] = []
        comp = rows.column("component").to_numpy()
        cell = rows.column("cell").to_numpy()
        for first, second in _candidates(rows, percent):
            for i, j in zip(first.tolist(), second.tolist(), strict=True):
                x, y = find((cell[i], comp[i])), find((cell[j], comp[j]))
                if x == y:
                    continue
                for at in (i, j):
                    if at not in sets:
                        sets[at] = np.frombuffer(held[at], np.uint64)
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[y] = x
                    links.append((min(comp[i], comp[j]), max(comp[i], comp[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose full sets reach the similarity."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            sets = []
            for side in ("text_a", "text_b"):
                sets.append([])
                column = part.column(side)
                seen: dict = {}
                for v in column.to_pylist():
                    if v not in seen:
                        raw = np.frombuffer(v.encode(), np.uint8)
                        seen[v] = np.unique(Words(raw, np.array([0, len(raw)])).shingles(k)[0])
                    sets[-1].append(seen[v])
            good = []
            for one, other in zip(*sets, strict=True):
                both = len(np.intersect1d(one, other, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(other) - both))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _passing(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = passes(bits, batch.column("key").to_numpy(zero_copy_only=False))
        yield batch.select(["doc_id", "text"]).filter(pa.array(good))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the given doc_ids. Only texts that a filter lets pass are shuffled:
    about those asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(ids.select(id_hash("doc_id").alias("key")), "key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.withColumn("key", id_hash("doc_id")).mapInArrow(lambda batches: _passing(batches, sent.value), "doc_id long, text string")
    return texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs a < b, those that full sets confirm."""
    texts = cut(_texts(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInArrow(lambda batches: _confirmed(batches, k, percent), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = words.shingles(k)
        held = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(held, pa.binary())], names=["rep", "held"])

    return by_text(batches, "text", make)


def cells(members: DataFrame, block: int) -> DataFrame:
    """Members of buckets (band, m, top, n_top, component and more) at cells that hold every
    pair of unlike components of a bucket once, sorted by cell and part.

    The bucket's largest component meets the other members alone, in blocks of both; only
    the others meet each other as well. So a large group with few strangers makes rows in
    proportion to its members."""
    main = F.col("component") == F.col("top")
    places = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    placed = members.select("*", main.alias("main"), places(F.col("n_top")).alias("g"), places(F.col("m") - F.col("n_top")).alias("h"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("g")).otherwise(F.col("h"))).cast("int"))
    cell = lambda kind, a, b, part: F.struct(F.xxhash64("band", F.lit(kind), a, b).alias("cell"), F.lit(part).alias("part"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.transform(upto("h"), lambda b: cell(0, F.col("own"), b, 0))
    other = F.transform(upto("g"), lambda a: cell(0, a, F.col("own"), 1))
    # blocks of the others: with themselves, and two with each other
    within = F.transform(upto("h"), lambda b: F.struct(F.xxhash64("band", F.lit(1), F.least("own", b), F.greatest("own", b)).alias("cell"), F.when(F.col("own") == b, -1).when(F.col("own") < b, 0).otherwise(1).alias("part")))
    at = F.when(F.col("main"), across).otherwise(F.concat(other, within))
    kept = [c for c in members.columns if c not in ("band", "m", "top", "n_top")]
    return placed.select(*kept, F.explode(at).alias("_at")).select("_at.cell", "_at.part", *kept).repartition("cell").sortWithinPartitions("cell", "part")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents joined by links of Jaccard similarity of at least `percent` / 100.

    Returns per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable
    over links), kept (doc_id = component_id), class_id (smallest doc_id of an equal set).

    1. Equal sets form classes; from here on a class is its smallest doc_id, so copies
       cost no pairs.
    2. Every band's bucket has hubs (its smallest and largest member and another); a member
       is tried with the three hubs that it shares most bands with: linear in the members.
       Sketches and then full sets confirm links.
    3. Members of a bucket that these links don't join yet are compared with each other
       in blocks of bounded size: sketches first, then full sets, which are sent to the
       blocks for the members in question alone. Every such pair is decided, unless links
       of its block join the two already, and only links between components leave the
       block, fewer than it has members. These are contracted at the end.

    Nulls and empties: a null or wordless text has no shingles and links with nothing;
    rows with a null doc_id take part in no group, have null component_id and class_id,
    and are kept. Repeated rows of one doc_id must have equal text; each gets the same
    result. An empty table gives an empty result. Other columns are ignored.
    """
    signed = cut(signatures(docs, k))
    usable = signed.where("set_id is not null and doc_id is not null")
    # tables of totals are cut, so that a join with them is dealt anew and a hot key can be split
    classes = cut(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep")))
    reps = cut(
        signed.join(classes.select(F.col("rep").alias("doc_id"), F.col("set_id").alias("of")), "doc_id").where("set_id = of").dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch")
    )
    banded = reps.select("rep", F.posexplode("bands").alias("number", "band"))
    flip = F.lit(0x5555555555555555)
    buckets = cut(banded.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("h0"), F.max("rep").alias("h1"), F.min(F.col("rep").bitwiseXOR(flip)).alias("h2")).where("m > 1"))
    members = cut(banded.join(buckets, "band"))
    hubs = F.array("h0", "h1", F.col("h2").bitwiseXOR(flip))
    tried = members.select("rep", F.explode(hubs).alias("hub")).where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = tried.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("n"), "hub"))), 1, HUBS).alias("best")).select("rep", F.explode("best.hub").alias("hub"))
    pairs = best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = cut(likely.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely, "a long, b long"))
    links = cut(_confirm(likely, docs, k, percent))

    base = cut(components(links))
    rows = members.select("band", "number", "rep", "m").join(base, members.rep == base.node, "left").select("band", "number", "rep", "m", F.coalesce("component", "rep").alias("component"))
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    mixed = cut(sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("_"), F.first("m").alias("m")).where("_.n < m").select("band", F.col("_.component").alias("top"), F.col("_.n").alias("n_top")))
    left = cut(rows.join(mixed, "band"))

    asked = cut(cells(left.join(reps, "rep"), BLOCK).mapInArrow(lambda batches: _in_question(batches, percent), "rep long").distinct())
    sets = cut(_texts(docs, asked.withColumnRenamed("rep", "doc_id")).mapInArrow(lambda batches: _sets(batches, k), "rep long, held binary"))
    known = cut(reps.join(sets, "rep"))  # of members in question alone
    further = cut(cells(left.join(known, "rep"), SET_BLOCK).mapInArrow(lambda batches: _linked_within(batches, percent), "a long, b long"))
    joined = cut(components(further).select(F.col("node").alias("of"), F.col("component").alias("joined")))
    # a component may be that of a text without links so far
    labels = base.join(joined, base.component == joined.of, "left").select("node", F.coalesce("joined", "component").alias("component"))
    labels = labels.unionByName(joined.join(base, joined.of == base.node, "left_anti").select(F.col("of").alias("node"), F.col("joined").alias("component")))

    named = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    return named.join(labels, named.rep == labels.node, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "rep", "doc_id"))).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that `near_duplicates` keeps: one document of every group.
    Of repeated rows of one doc_id one stays; rows without doc_id stay, as do null texts and
    those without words, which are linked with nothing; an empty table gives an empty result."""
    kept = near_duplicates(docs, k, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def recall_miss(similarity: float) -> float:
    """Chance that a pair of this similarity shares no band."""
    return math.pow(1 - similarity**4, BANDS)


#: The same in DuckDB's SQL, by comparing all sets that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b, p.n = x.n AND p.n = y.n AS equal_ FROM pairs p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b AS node, r.root FROM reach r JOIN both_ e ON r.node = e.a),
lowest AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
classes AS (SELECT b AS node, min(a) AS class_id FROM links WHERE equal_ GROUP BY b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept, coalesce(c.class_id, d.doc_id) AS class_id
FROM documents d JOIN lowest l ON d.doc_id = l.node LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN classes c ON d.doc_id = c.node
"""
