"""Record curation: quality filter, duplicates by identifier and by title, venues."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.batches import pieces
from corpusloom.functions import vocabulary as v
from corpusloom.functions.text import normalize_title
from corpusloom.session import cut, spread


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def normalize_venue(venue: Column) -> Column:
    """Trimmed; short forms spelled out (a full stop at the end makes no difference)."""
    name = F.trim(F.coalesce(venue, F.lit("")))
    return F.coalesce(F.element_at(literal_map(v.VENUE_FORMS), F.rtrim(F.lower(name), F.lit("."))), name)


def is_good(citations: Column, year: Column, venue: Column, least: int = 5, fresh: int = 2026) -> Column:
    """Cited enough, or new, or in a good journal."""
    return (F.coalesce(citations, F.lit(0)) >= least) | F.coalesce(year >= fresh, F.lit(False)) | normalize_venue(venue).isin(*v.GOOD_VENUES)


def one_per_identifier(papers: DataFrame, doi: str = "doi", citations: str = "citations", order: str = "doc_id") -> DataFrame:
    """Of rows that share an identifier (trimmed, in lower case) the most cited one, the first
    on ties; rows without one all stay. Each row is compared within its own group, in one
    shuffle of keys that partial maxima reduce."""
    key = F.lower(F.trim(F.col(doi)))
    named = papers.where(F.length(key) > 0)
    best = named.groupBy(key.alias("_key")).agg(F.max(F.struct(F.coalesce(citations, F.lit(0)).alias("c"), (-F.col(order)).alias("o"))).alias("_best"))
    kept = named.withColumn("_key", key).join(best, "_key").where(-F.col(order) == F.col("_best.o")).drop("_key", "_best")
    return kept.unionByName(papers.where(F.coalesce(F.length(key), F.lit(0)) == 0).select(*kept.columns))


def _titles(records: DataFrame, key: str, title: str) -> DataFrame:
    """id, t: records with a title, normalised."""
    return records.select(F.col(key).alias("id"), normalize_title(F.col(title)).alias("t")).where("length(t) > 0")


#: Titles that meet in a part are compared one with the next up to so many, more of them as a matrix.
_MEET = 64
#: Of more titles than about so many that meet in a part, each two blocks meet by themselves.
_BLOCK = 1 << 14
_SLOTS = 1 << 16
#: Pairs that are looked at in one go.
_PAIRS = 1 << 18
_MIX, _MIX_AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _stirred(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    return h ^ (h >> np.uint64(29))


def _classes(percent: int) -> np.ndarray:
    """Least sizes of classes: sets that similar are of one class or of two that adjoin."""
    least = [1]
    while least[-1] < 1 << 31:
        least.append(least[-1] * 100 // percent + 1)
    return np.array(least, np.int64)


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n characters, and the texts that they are of."""
    words = texts.to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    runs = np.maximum(sizes - n + 1, 0)
    row = np.repeat(np.arange(len(words)), runs)
    at = np.arange(len(row)) + (_begins(sizes)[:-1] - _begins(runs)[:-1])[row]
    h = np.zeros(len(row), np.uint64)
    for k in range(n):
        h = _stirred(h, _MIX) ^ flat[at + k]
    return _stirred(_stirred(h, _MIX), _MIX_AGAIN), row


def _gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in order, one text after the other, and where they begin."""
    h, row = _grams(texts, n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], _begins(np.bincount(row[first], minlength=len(texts)))


def _sketches(texts: pa.Array, n: int) -> np.ndarray:
    """256 bits of each text's grams: texts differ in as many grams as bits at least."""
    out = [np.zeros((0, 4), np.uint64)]
    for own in pieces(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
        h, row = _grams(own.column(0), n)
        bits = np.zeros((own.num_rows, 256), bool)
        bits[row, (h >> np.uint64(56)).astype(np.int64)] = True
        out.append(np.packbits(bits, axis=1).view(np.uint64))
    return np.concatenate(out)


def _parts(g: np.ndarray, at: np.ndarray, level: np.ndarray, percent: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the parts into which sets of grams (of g from at on) are dealt at levels of
    classes, and where a set's keys begin. Sets of a level's class and of the one above, if
    similar, differ in fewer grams than there are parts, so that one part at least is equal."""
    n = 2 * (classes[level + 2] - 1) * (100 - percent) // (100 + percent) + 1
    begin = _begins(n)
    row = np.repeat(np.arange(len(n)), np.diff(at))
    sums = np.zeros(begin[-1], np.uint64)
    np.add.at(sums, begin[row] + (_stirred(g, _MIX) % n.astype(np.uint64)[row]).astype(np.int64), _stirred(g, _MIX_AGAIN))
    numbers = (np.arange(1, begin[-1] + 1) - np.repeat(begin[:-1], n)).astype(np.uint64)
    numbers += np.repeat(_stirred(level.astype(np.uint64), _MIX_AGAIN), n)
    return _stirred(sums + _stirred(numbers, _MIX), _MIX_AGAIN), begin


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)


def _split(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of pieces of batches: the rows' numbers, their keys, and 8 x the part's number, 4 more if the set is of the lower of two classes."""
    classes = _classes(percent)
    for batch in (own for whole in batches for own in pieces(whole, "g", 1 << 17)):
        held = batch.column("g")
        g, at = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy().astype(np.int64)
        g, at = g[at[0] : at[-1]], at - at[0]
        own = np.searchsorted(classes, np.diff(at), "right") - 1
        found = []
        for level in (own, own - 1):
            there = np.flatnonzero(level >= 0)
            sizes = np.diff(at)[there]
            begin = _begins(sizes)
            keys, begins = _parts(g[np.arange(begin[-1]) + np.repeat(at[there] - begin[:-1], sizes)], begin, level[there], percent, classes)
            n = np.diff(begins)
            part = np.arange(len(keys)) - np.repeat(begins[:-1], n)
            found.append((np.repeat(there, n), keys, part * 8 + (level is own) * 4))
        yield batch, *(np.concatenate(x) for x in zip(*found, strict=True))


def _crowds(grams: DataFrame, percent: int) -> dict[int, int]:
    """Slots of keys that more than _BLOCK titles meet in, and how many: few, however many titles there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(_SLOTS, np.int64)
        for _, _, keys, _ in _split(batches, percent):
            count += np.bincount(_slots(keys), minlength=_SLOTS)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(count[there])], names=["slot", "n"])

    found = grams.select("g").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > _BLOCK)
    return {r.slot: r.n for r in found.collect()}


def _meetings(grams: DataFrame, percent: int, crowds: dict[int, int] | None = None) -> DataFrame:
    """The columns besides g (the grams of a title), key, at: the parts of every title. Where a
    crowd meets, its titles are dealt into blocks and a key stands for two of them; at holds,
    besides what _split gives, 1 or 2 for titles of two blocks, which meet those of the other only."""
    carried = [c for c in grams.columns if c != "g"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.ones(_SLOTS, np.int64)
        for slot, n in (crowds or {}).items():
            blocks[slot] = -(-n // _BLOCK)
        for batch, row, keys, at in _split(batches, percent):
            n = blocks[_slots(keys)]
            if n.max(initial=1) > 1:
                copy = np.repeat(np.arange(len(keys)), n)
                other = np.arange(len(copy)) - np.repeat(_begins(n)[:-1], n)
                row, keys, at, n = row[copy], keys[copy], at[copy], n[copy]
                rep = batch.column("rep").to_numpy().astype(np.int64).view(np.uint64)[row]
                mine = (_stirred(_stirred(rep, _MIX_AGAIN), _MIX) % n.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                keys = np.where(n > 1, _stirred(keys + (low * n + high + 1).astype(np.uint64) * _MIX, _MIX_AGAIN), keys)
                at = at + np.where(low == high, 0, np.where(mine == low, 1, 2))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in carried), pa.array(keys.view(np.int64)), pa.array(at.astype(np.int32))], names=[*carried, "key", "at"])

    return grams.mapInArrow(met, T.StructType([*grams.select(carried).schema.fields, T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType())]))


class _Meeting:
    """Rows (rep, t, m, key, at) of whole keys, one key after the other: pairs that are similar."""

    def __init__(self, rows: pa.Table, percent: int, n: int, classes: np.ndarray):
        key = rows.column("key").to_numpy()
        again = key[1:] == key[:-1]
        alone = ~(np.append(again, False) | np.insert(again, 0, False))
        rows = (rows.filter(pa.array(~alone)) if alone.any() else rows).combine_chunks()
        self.key, self.rep, self.m, at = (rows.column(c).to_numpy() for c in ("key", "rep", "m", "at"))
        self.t = pa.concat_arrays(rows.column("t").chunks) if rows.num_rows else pa.array([], pa.string())
        self.m = self.m.astype(np.int64)
        self.part, self.low, self.side = at >> 3, at & 4 > 0, at & 3
        self.bits, self.percent, self.n, self.classes = _sketches(self.t, n), percent, n, classes

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """a < b, similarity: every pair that first meets here."""
        held, size = [], 0
        for i, j in self._close():
            held.append((i, j))
            size += len(i)
            if size >= _PAIRS:
                yield from self._decided(held)
                held, size = [], 0
        if size:
            yield from self._decided(held)

    def _close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose sizes and bits don't rule them out."""
        begin = np.flatnonzero(np.insert(self.key[1:] != self.key[:-1], 0, True)) if len(self.key) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(self.key))
        few = end - begin <= _MEET
        i = np.flatnonzero(np.repeat(few, end - begin))
        upto = np.repeat(end[few], (end - begin)[few])
        for step in range(1, _MEET):
            i, upto = i[i + step < upto], upto[i + step < upto]
            if not len(i):
                break
            unlike = np.bitwise_count(self.bits[i] ^ self.bits[i + step]).sum(axis=1, dtype=np.int64)
            yield self._not_ruled_out(i, i + step, unlike)
        for lo, hi in zip(begin[~few].tolist(), end[~few].tolist(), strict=True):
            two = self.side[lo:hi] == 2
            yield from self._matrix(lo + np.flatnonzero(~two), lo + np.flatnonzero(two)) if two.any() else self._matrix(np.arange(lo, hi))

    def _matrix(self, rows: np.ndarray, others: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = rows[np.argsort(self.m[rows], kind="stable")]
        others = rows if others is None else others[np.argsort(self.m[others], kind="stable")]
        theirs, sizes = np.ascontiguousarray(self.bits[others].T), self.m[others]
        for at in range(0, len(rows), 128):
            own = rows[at : at + 128]
            first = np.searchsorted(sizes, -(-self.m[own[0]] * self.percent // 100))
            last = np.searchsorted(sizes, self.m[own[-1]] * 100 // self.percent, "right")
            for lo in range(max(first, at) if others is rows else first, last, 2048):
                hi = min(last, lo + 2048)
                unlike = np.zeros((len(own), hi - lo), np.uint16)
                for w in range(4):
                    unlike += np.bitwise_count(self.bits[own, w][:, None] ^ theirs[w, lo:hi])
                i, j = np.nonzero(unlike <= (self.m[own] + sizes[hi - 1])[:, None] * (100 - self.percent) // (100 + self.percent))
                if others is rows:
                    i, j = i[at + i < lo + j], j[at + i < lo + j]
                if len(i):
                    yield self._not_ruled_out(own[i], others[lo + j], unlike[i, j].astype(np.int64))

    def _not_ruled_out(self, i: np.ndarray, j: np.ndarray, unlike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mi, mj = self.m[i], self.m[j]
        # two of the upper class meet in their own, too
        ok = (self.low[i] | self.low[j]) & (unlike * (100 + self.percent) <= (mi + mj) * (100 - self.percent)) & (np.minimum(mi, mj) * 100 >= np.maximum(mi, mj) * self.percent)
        ok &= ((self.side[i] == 0) | (self.side[i] != self.side[j])) & (self.rep[i] != self.rep[j])
        return i[ok], j[ok]

    def _decided(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pairs that meet in no part before this one: those that share enough grams."""
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(self.m[i], kind="stable")
        rows, both = np.unique(np.concatenate([i[order], j[order]]), return_inverse=True)
        i, j = both[: len(i)], both[len(i) :]
        g, at = _gram_sets(self.t.take(pa.array(rows)), self.n)
        m, part, rep = np.diff(at), self.part[rows], self.rep[rows]
        level = np.searchsorted(self.classes, m, "right") - 1 - ~self.low[rows]
        keys, begin = _parts(g, at, level, self.percent, self.classes)
        done = 0
        while done < len(i):
            x, y = i[done : done + 4096], j[done : done + 4096]
            most = max(1, (1 << 20) // int(max(m[x].max(), m[y].max())))
            x, y = x[:most], y[:most]
            done += len(x)
            before = np.arange(part[x].max())
            inside = before < part[x][:, None]
            equal = (keys[np.where(inside, begin[x][:, None] + before, 0)] == keys[np.where(inside, begin[y][:, None] + before, 0)]) & inside
            x, y = x[~equal.any(axis=1)], y[~equal.any(axis=1)]
            if len(x):
                shared = _shared(g, at, x, y)
                similarity = shared / (m[x] + m[y] - shared)
                ok = similarity * 100 >= self.percent
                x, y, similarity = rep[x[ok]], rep[y[ok]], similarity[ok]
                yield np.minimum(x, y), np.maximum(x, y), similarity


def _shared(g: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements sets x and y (of g from at on) have in common, pair by pair."""
    size = np.diff(at)
    width = int(max(size[x].max(), size[y].max()))
    places = np.arange(width)
    rows, surplus = [], 0
    for which, filled in ((x, np.uint64(0xFFFFFFFFFFFFFFFF)), (y, np.uint64(0xFFFFFFFFFFFFFFFE))):
        inside = places < size[which][:, None]
        rows.append(np.where(inside, g[np.where(inside, at[which][:, None] + places, 0)], filled))
        surplus = surplus + np.maximum(width - size[which] - 1, 0)
    both = np.sort(np.concatenate(rows, axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(axis=1) - surplus


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by a key, of whole keys at a time."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last or held[-1].column(key)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """a, b, n: pairs that join what these join, each group's least with its others; n add up to the number of pairs."""
    top, pairs = {}, {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    a, b = a.tolist(), b.tolist()
    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        top[max(x, y)] = min(x, y)
    for x in a:
        r = find(x)
        pairs[r] = pairs.get(r, 0) + 1
    ends = [(find(x), x) for x in list(top)]
    ends = [(r, x) for r, x in ends if r != x]
    return [r for r, _ in ends], [x for _, x in ends], [pairs.pop(r, 0) for r, _ in ends]


def _similar_titles(same: DataFrame, percent: int, n: int, linked: bool = False) -> DataFrame:
    """a < b, similarity of distinct titles (rep, t), by their n-grams as 64-bit hashes. If
    linked: a, b, n: fewer pairs that join the same titles, whose n add up to as many as there are.

    Grams are dealt into parts by their hash, more parts than similar titles differ in grams,
    and titles meet where a part is equal. There 256 bits of each title's grams tell how many
    grams they differ in at least, and pairs that this leaves are compared by all their grams
    in the first of the parts that they share. Titles meet by chance as well, so that
    comparisons of bits, though not what is sent or held, grow with the square of a crowd."""
    sets = spread(same, "rep").select(F.col("rep").cast("long").alias("rep"), "t")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (own for whole in batches for own in pieces(whole, "t", 1 << 17)):
            g, at = _gram_sets(batch.column("t"), n)
            held = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("t"), pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)))], names=["rep", "t", "m", "g"])
            yield held.filter(pa.array(np.diff(at) > 0))

    grams = sets.mapInArrow(gathered, "rep long, t string, m int, g array<long>")
    met = spread(_meetings(grams, percent, _crowds(grams, percent)), "key").sortWithinPartitions("key")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes(percent)
        for rows in _by_key(batches, "key"):
            for a, b, similarity in _Meeting(rows, percent, n, classes).pairs():
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(a, b)], names=["a", "b", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(similarity)], names=["a", "b", "similarity"])

    return met.mapInArrow(compared, f"a long, b long, {'n long' if linked else 'similarity double'}")


def title_pairs(records: DataFrame, key: str, title: str, percent: int = 85, n: int = 3) -> DataFrame:
    """a < b, similarity: records whose titles share at least `percent` of their n-grams.
    Distinct titles are compared; equal ones are put back as links to the first of them."""
    named = cut(_titles(records, key, title))
    same = cut(named.groupBy("t").agg(F.min("id").alias("rep")))
    equal = named.join(same, "t").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return _similar_titles(same, percent, n).unionByName(equal)


class _Kept:
    """Kept titles of a component, each in its place, and where titles were found to belong.
    What is held grows with the titles, not with the pairs of them that are alike."""

    def __init__(self, percent: int):
        self.percent, self.slots, self.grams = percent, [], []
        self.bits, self.sizes = np.zeros((16, 4), np.uint64), np.zeros(16, np.int64)
        self.found, self.changed = {}, []  # title: place, and how many places had changed by then

    def known(self, rep: int) -> int | None:
        """The title's place, if no place up to it has changed since it was looked for."""
        place, then = self.found.get(rep, (None, 0))
        if place is None or then == len(self.changed):
            return place
        if len(self.changed) - then > 64 or min(self.changed[then:]) <= place:
            return None
        self.found[rep] = place, len(self.changed)
        return place

    def look(self, rep: int, g: np.ndarray, bits: np.ndarray) -> int | None:
        """The first place whose title is like this one."""
        n, found = len(self.slots), None
        unlike = np.bitwise_count(self.bits[:n] ^ bits).sum(axis=1, dtype=np.int64)
        for place in np.flatnonzero(unlike * (100 + self.percent) <= (self.sizes[:n] + len(g)) * (100 - self.percent)).tolist():
            other = self.grams[place]
            shared = int((other[np.minimum(np.searchsorted(other, g), len(other) - 1)] == g).sum())
            if shared / (len(g) + len(other) - shared) * 100 >= self.percent:
                found = place
                break
        if found is not None:
            self.found[rep] = found, len(self.changed)
        return found

    def keep(self, place: int | None, rep: int, record: tuple[int, int], g: np.ndarray, bits: np.ndarray) -> None:
        """A record in the place of another, or, if None, in a new one."""
        if place is None:
            place = len(self.slots)
            self.slots.append(record)
            self.grams.append(g)
            if place == len(self.bits):
                self.bits, self.sizes = np.concatenate([self.bits, np.zeros_like(self.bits)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        else:
            self.slots[place], self.grams[place] = record, g
            self.changed.append(place)
        self.bits[place], self.sizes[place] = bits, len(g)
        self.found[rep] = place, len(self.changed)


def _replayed(batches: Iterator[pa.RecordBatch], percent: int, n: int) -> Iterator[pa.RecordBatch]:
    """Records kept of components that come one after the other, each in the order of its ids."""
    component, kept = None, _Kept(percent)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept.slots], pa.int64())], names=["kept_id"])
    for batch in (own for whole in batches for own in pieces(whole, "t")):
        reps, first = np.unique(batch.column("rep").to_numpy(), return_index=True)
        texts = batch.column("t").take(pa.array(first))
        (g, at), bits, which = _gram_sets(texts, n), _sketches(texts, n), {rep: x for x, rep in enumerate(reps.tolist())}
        for comp, i, c, rep in zip(*(batch.column(x).to_pylist() for x in ("component", "id", "c", "rep")), strict=True):
            if comp != component:
                if kept.slots:
                    yield out()
                component, kept = comp, _Kept(percent)
            place, x = kept.known(rep), which[rep]
            if place is None:
                place = kept.look(rep, g[at[x] : at[x + 1]], bits[x])
            if place is None or c > kept.slots[place][1]:
                kept.keep(place, rep, (i, c), g[at[x] : at[x + 1]].copy(), bits[x])
    if kept.slots:
        yield out()


def greedy_titles(records: DataFrame, key: str, title: str, citations: str, percent: int = 85, n: int = 3) -> DataFrame:
    """key, kept: in the order of keys each title is compared with those kept so far; a
    similar one with more citations takes the place of the kept one, else it goes.

    Similar titles lie in one component of the pairs of distinct titles, for which pairs that
    join the same titles do. If all titles of a component are like each other (as those of a
    title without any other like it are), the most cited record stays, the first on ties:
    partial maxima find it, however many records share the title. Records of other components
    pass through a task in order, which compares them with the titles kept and holds these.
    Records without a title stay."""
    from corpusloom.operators.graph import connected

    told = records.select(F.col(key).alias("id"), normalize_title(F.col(title)).alias("t"), F.coalesce(citations, F.lit(0)).cast("long").alias("c"))
    told = cut(told.withColumn("t", F.when(F.length("t") > 0, F.col("t"))))
    named = told.where("t is not null")
    same = cut(named.groupBy("t").agg(F.min("id").alias("rep")))
    links = cut(_similar_titles(same, percent, n, linked=True).groupBy("a", "b").agg(F.sum("n").alias("n")))
    groups = connected(links.select("a", "b"))
    titles = groups.groupBy("component").agg(F.count("*").alias("titles"))
    pairs = links.join(groups, links.a == groups.node).groupBy("component").agg(F.sum("n").alias("pairs"))
    whole = pairs.join(titles, "component").where("2 * pairs = titles * (titles - 1)").select(F.col("component").alias("whole"))
    of = groups.join(whole, groups.component == F.col("whole"), "left")
    rows = cut(named.join(same, "t").join(of, F.col("rep") == F.col("node"), "left").select("id", "c", "t", "rep", "component", "whole"))
    alike = rows.where("component is null or whole is not null").groupBy(F.coalesce("component", "rep").alias("of")).agg(F.max(F.struct("c", (-F.col("id")).alias("i"))).alias("_"))
    drift = rows.where("component is not null and whole is null").select("component", "id", "c", "rep", "t")
    replayed = spread(drift, "component").sortWithinPartitions("component", "id").mapInArrow(lambda batches: _replayed(batches, percent, n), "kept_id long")
    chosen = alike.select((-F.col("_.i")).alias("kept_id")).unionByName(replayed)
    kept = chosen.unionByName(told.where("t is null").select(F.col("id").alias("kept_id"))).withColumn("_k", F.lit(True))
    return told.select("id").join(kept, F.col("id") == F.col("kept_id"), "left").select(F.col("id").alias(key), F.coalesce("_k", F.lit(False)).alias("kept"))


def tier(url: Column, arxiv_id: Column) -> Column:
    """1 if there is an open copy or a preprint, else 2."""
    there = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    return F.when(there(url) | there(arxiv_id), 1).otherwise(2)


def safe_name(venue: Column, most: int = 60) -> Column:
    """Letters, digits and hyphens, blanks as underscores; Unknown if none is left."""
    plain = F.regexp_replace(F.regexp_replace(venue, r"[^\p{L}\p{N}_\s-]", ""), r"[\s_]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, most), F.lit("")), F.lit("Unknown"))


@F.pandas_udf(T.StringType())
def _unescaped(names: pd.Series) -> pd.Series:
    return names.map(html.unescape, na_action="ignore")


def clean_venue(venue: Column) -> Column:
    """Without entities of HTML, (Print), publishers and towns in brackets, and spare blanks."""
    name = F.regexp_replace(_unescaped(F.trim(F.coalesce(venue, F.lit("")))), r"\s*\(Print\)\s*", " ")
    for words in (v.VENUE_PUBLISHERS, v.VENUE_TOWNS):
        name = F.regexp_replace(name, rf"(?i)\s*\((?:{'|'.join(words)})[^)]*\)", "")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def spelled_out(venue: Column) -> Column:
    """A clean venue in lower case with abbreviations spelled out, without brackets."""
    name = F.lower(venue)
    for short in sorted(v.VENUE_ABBREVIATIONS, key=lambda x: -len(x)):
        name = F.replace(name, F.lit(short), F.lit(v.VENUE_ABBREVIATIONS[short]))
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)", ""), r"\s+", " "))


def _longest_key(names: DataFrame, keys: DataFrame) -> DataFrame:
    """id, value, of the longest key (k, value) that stands in a name (id, v) as whole words,
    wherever it does. Both meet at words: a key is looked up by its first one."""
    words = names.select("id", "v", F.explode(F.array_distinct(F.filter(F.split("v", r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("w"))
    first = keys.withColumn("w", F.regexp_extract("k", r"[\p{L}\p{N}]+", 0))
    quoted = F.concat(F.lit(r"(^|[^\p{L}\p{N}])\Q"), "k", F.lit(r"\E([^\p{L}\p{N}]|$)"))
    met = words.join(first, "w").where(F.contains("v", "k")).where(F.rlike("v", quoted))
    return met.groupBy("id").agg(F.max_by("value", F.struct(F.length("k"), "k")).alias("value"))


def by_longest_key(venues: DataFrame, keys: DataFrame, venue: str = "venue") -> DataFrame:
    """venue, matched: of the keys (key, value) that stand in the venue as whole words, the
    value of the longest; null if none does. Keys are a dictionary of any size."""
    distinct = venues.select(venue).distinct()
    names = distinct.select(F.col(venue).alias("id"), F.lower(clean_venue(F.col(venue))).alias("v"))
    best = _longest_key(names, keys.select(F.lower("key").alias("k"), "value")).select(F.col("id").alias(venue), F.col("value").alias("matched"))
    return distinct.join(best, venue, "left")


def classify_venues(venues: DataFrame, keys: DataFrame, venue: str = "venue") -> DataFrame:
    """venue, folder, rule for every distinct venue, by the first rule that applies: the whole
    name is a key (as it is, clean, or without brackets; in any case), the longest key in it,
    the same with abbreviations spelled out, a safe form of the name. Empty venues, and what
    is empty once clean, are Unknown. keys: key, value."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    named = venues.select(venue).distinct().withColumn("clean", clean_venue(F.col(venue))).withColumn("long", spelled_out(F.col("clean")))
    lowered = keys.select(F.lower("key").alias("k"), "value").groupBy("k").agg(F.min("value").alias("value"))
    whole = lambda *names: named.select(F.col(venue).alias("id"), F.posexplode(F.array(*(F.lower(F.trim(n)) for n in names))).alias("turn", "k"))
    exact = lambda *names: whole(*names).join(lowered, "k").groupBy("id").agg(F.min_by("value", "turn").alias("value"))
    inside = lambda name: _longest_key(named.select(F.col(venue).alias("id"), F.lower(name).alias("v")), lowered)
    found = None
    rules = (("exact", exact(F.col(venue), F.col("clean"), bare(F.col("clean")))), ("longest", inside(F.col("clean"))), ("exact_long", exact(F.col("long"))), ("longest_long", inside(F.col("long"))))
    for turn, (_, rule) in enumerate(rules):
        part = rule.withColumn("turn", F.lit(turn))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min(F.struct("turn", "value")).alias("_")).select("id", F.element_at(F.array(*(F.lit(name) for name, _ in rules)), F.col("_.turn") + 1).alias("by"), "_.value")
    out = named.join(best, named[venue].eqNullSafe(best.id), "left")
    empty = F.coalesce(F.length("clean"), F.lit(0)) == 0
    return out.select(venue, F.when(empty, "Unknown").otherwise(F.coalesce("value", safe_name(F.col("clean")))).alias("folder"), F.when(empty, "empty").otherwise(F.coalesce("by", F.lit("safe"))).alias("rule"))


def by_first_key(venue: Column, ranks: tuple[tuple[str, int], ...], default: int) -> Column:
    """The rank of the first listed name that occurs in the venue."""
    v_ = F.lower(venue)
    return F.coalesce(*(F.when(F.contains(v_, F.lit(k.lower())), r) for k, r in ranks), F.lit(default))


def report(papers: DataFrame) -> DataFrame:
    """Counts by tier, venue and year in one pass: kind, value, n."""
    rows = papers.select(F.col("tier").cast("string").alias("tier"), F.when(F.col("venue") == "", "(unknown)").otherwise(F.col("venue")).alias("venue"), F.col("year").cast("string").alias("year"))
    sets = rows.groupingSets([["tier"], ["venue"], ["year"]], "tier", "venue", "year").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "venue").otherwise("year")
    out = sets.select(kind.alias("kind"), F.coalesce("tier", "venue", "year").alias("value"), "n").where("value is not null")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "value"))
    return out.withColumn("place", place).where((F.col("kind") != "venue") | (F.col("place") <= 20)).drop("place")
