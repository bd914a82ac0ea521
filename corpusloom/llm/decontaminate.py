"""Benchmark decontamination by SimHash windows and a multi-index Hamming search.

Windows of the size of an item slide over documents; those where the text holds one of the
rarest runs of five words of some item are fingerprinted by SimHash and looked up in a
multi-index of the items' fingerprints. The index cuts fingerprints into blocks, and two
within the radius differ in few enough bits of one block at least, so none within it is
missed. What it finds are the candidates, and exact similarity of weighted shingles (runs
of five words, weighted by how often they occur) decides over these.

Runs say where windows lie, not which item they are compared with. A window that reaches
the similarity holds one of the item's rarest runs, so no other window need be looked at;
a run which very many items share (a prompt that they begin with) makes as many windows as
these items have different sizes and places for it, not as many as there are items.

An item cut at its edges differs from its window in more bits than an index can be asked
for, so every item is entered several times: whole, without the most words that it may lose
at its begin, and at its end; for texts shorter than the item in three places at the least
size that they may have. Whatever of these a document holds in full is at distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._words import Words, by_text

#: Of 64 bits. A window at the similarity of 0.75 differs in about 5 of them, in 8 if it is short.
RADIUS = 11
#: Items are held in tasks in blocks of about so many bytes of text.
BLOCK_BYTES = 8 << 20
_BITMAP = 22
_PIECE = 1 << 16


def _runs(a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges a .. a + size: the number of each range, and all their members."""
    which = np.repeat(np.arange(len(a)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a[which]


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to the limit at most; a larger one goes alone."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield at, to
        at = to


def _votes(hashes: np.ndarray) -> np.ndarray:
    """64 votes of each word: 1 or -1."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of the words start .. start + size (some), by votes of each word's bits."""
    found = [np.zeros(0, np.uint64)]
    for a, b in _pieces(size, _PIECE):
        if size[a] > _PIECE:  # one long window, a piece at a time
            sums = sum(_votes(hashes[at : min(at + _PIECE, start[a] + size[a])]).sum(axis=0, dtype=np.int64) for at in range(start[a], start[a] + size[a], _PIECE))[None, :]
        else:
            sums = np.add.reduceat(_votes(hashes[_runs(start[a:b], size[a:b])[1]]), np.cumsum(size[a:b]) - size[a:b], axis=0, dtype=np.int32)
        found.append(np.packbits(sums > 0, axis=1).reshape(-1).view(np.uint64))
    return np.concatenate(found)


class Hamming:
    """A multi-index: fingerprints by the value of each of some blocks of their bits.

    Of m blocks two fingerprints within the radius differ in radius // m bits or fewer in
    one at least, so the entries within that distance of each block's value hold them all.
    There are as many blocks as make lookups and expected candidates fewest."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius

        def cost(m: int) -> float:
            width, near = 64 // m, radius // m
            lookups = m * sum(len(list(combinations(range(width), j))) for j in range(near + 1))
            return lookups + len(prints) * lookups / 2**width

        m = min((m for m in range(1, radius + 2) if radius // m <= 2), key=cost)
        edges = np.linspace(0, 64, m + 1).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            value = self._block(prints, lo, hi)
            order = np.argsort(value, kind="stable")
            masks = [sum(1 << b for b in bits) for j in range(radius // m + 1) for bits in combinations(range(hi - lo), j)]
            self.blocks.append((lo, hi, value[order], order, np.array(masks, np.uint64)))

    @staticmethod
    def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return prints >> np.uint64(lo) & np.uint64((1 << int(hi - lo)) - 1)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in prints, entry) that are near in a block, in pieces of bounded size."""
        for lo, hi, values, order, masks in self.blocks:
            for at in range(0, len(prints), max(1, _PIECE // len(masks))):
                own = (self._block(prints[at : at + max(1, _PIECE // len(masks))], lo, hi)[:, None] ^ masks[None, :]).ravel()
                a, b = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
                for x, y in _pieces(b - a, _PIECE):
                    which, entry = _runs(a[x:y], (b - a)[x:y])
                    yield at + (x + which) // len(masks), order[entry]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, entry) within the radius."""
        found = [np.zeros((0, 2), np.int64)]
        for which, entry in self.candidates(prints):
            close = np.bitwise_count(prints[which] ^ self.prints[entry]) <= self.radius
            found.append(np.column_stack([which[close], entry[close]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


class Runs:
    """Rarest runs of the items of one run length: hashes in order; for each the windows around
    it (words before it, size), however many items they are of; and for each item its runs."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, place: np.ndarray, index: "Index", in_short: bool):
        self.hashes, number = np.unique(hashes, return_inverse=True)
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
        order, bounds = index.entries_of
        which, at = _runs(bounds[item], bounds[item + 1] - bounds[item])
        entry = order[at]
        right = (index.entry_short[entry] == 1) | (index.entry_size[entry] == index.sizes[index.entry_item[entry]]) if in_short else index.entry_short[entry] == 0
        which, entry = which[right], entry[right]
        around = np.unique(np.column_stack([number[which], place[which] - index.entry_at[entry], index.entry_size[entry], index.sizes[index.entry_item[entry]] if in_short else 0 * entry]), axis=0)
        self.before, self.size, self.full = around[:, 1], around[:, 2], around[:, 3]
        self.bounds = np.searchsorted(around[:, 0], np.arange(len(self.hashes) + 1))
        own = np.unique(np.column_stack([item, number]), axis=0)
        self.own, self.own_bounds = own[:, 1], np.searchsorted(own[:, 0], np.arange(len(index.sizes) + 1))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and the number of the run that stands there."""
        maybe = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), max(0, len(self.hashes) - 1))
        same = self.hashes[at] == hashes[maybe] if len(self.hashes) else np.zeros(len(maybe), bool)
        return maybe[same], at[same]

    def held(self, text: np.ndarray, item: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Which of the pairs have a run of the item in the text; seen: sorted text * runs + run."""
        out = np.zeros(len(text), bool)
        sizes = self.own_bounds[item + 1] - self.own_bounds[item]
        for a, b in _pieces(sizes, 1 << 20):
            which, at = _runs(self.own_bounds[item[a:b]], sizes[a:b])
            key = text[a:b][which] * len(self.hashes) + self.own[at]
            place = np.minimum(np.searchsorted(seen, key), max(0, len(seen) - 1))
            out[a + which[seen[place] == key] if len(seen) else []] = True
        return out


class Index:
    """Items of one block (their identifiers and their text): rarest shingles by hash,
    shingle weights, and the multi-index of the fingerprints of their entries."""

    def __init__(self, items: list[tuple[list, str]], k: int, percent: int, radius: int):
        items = [(ids, text.encode()) for ids, text in items]
        words = Words(np.frombuffer(b"".join(t for _, t in items), np.uint8), np.cumsum([0, *(len(t) for _, t in items)]))
        some = np.flatnonzero(np.diff(words.first))
        self.k, self.percent = k, percent
        self.ids, self.sizes = [items[i][0] for i in some.tolist()], np.diff(words.first)[some]
        self.length = np.minimum(self.sizes, k)
        hashes, first = words.shingles(k)
        self.made = np.diff(first)[some]  # shingles, repeats counted
        # what a window may lack: of the item's size, and in a text that is shorter
        lack = self.made - -(-2 * percent * self.made // (100 + percent))
        short = self.made - -(-percent * self.made // 100)
        self.prints_of = fingerprints(words.hash, words.first[some], self.sizes)
        self._enter(words.hash, words.first[some], lack, short, radius)
        item = np.repeat(np.arange(len(some)), self.made)
        place = np.arange(len(hashes)) - np.repeat(first[some], self.made)
        # weights: distinct shingles of each item by hash
        order = np.lexsort((hashes, item))
        new = np.ones(len(order), bool)
        new[1:] = (item[order][1:] != item[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        at = np.flatnonzero(new)
        self.shingle, self.of, self.weight = hashes[order][at], item[order][at], np.diff(np.append(at, len(order)))
        self.bounds = np.searchsorted(self.of, np.arange(len(some) + 1))
        # of an item the rarest shingles, so many that a window without any can't be alike enough
        _, which, often = np.unique(self.shingle, return_inverse=True, return_counts=True)
        by_rarity = np.lexsort((self.shingle, often[which], self.of))
        before = np.cumsum(self.weight[by_rarity]) - self.weight[by_rarity]
        before -= np.repeat(before[self.bounds[:-1]], np.diff(self.bounds))
        self.tables = {}
        for n in np.unique(self.length).tolist():
            for in_short, most in ((False, lack), (True, short)):
                rare = np.zeros(len(self.shingle), bool)
                rare[by_rarity] = before <= most[self.of[by_rarity]]
                rare &= self.length[self.of] == n
                seed = np.empty(len(order), bool)
                seed[order] = rare[np.cumsum(new) - 1]
                self.tables[n, in_short] = Runs(hashes[seed], item[seed], place[seed], self, in_short)

    def _enter(self, hashes: np.ndarray, first: np.ndarray, lack: np.ndarray, short: np.ndarray, radius: int) -> None:
        """Entries of the index: item, its first word in the item, words; for short texts or not."""
        n, every = self.sizes, np.arange(len(self.sizes))
        parts = [(every, 0 * n, n, 0 * n)]
        parts += [(every, at, n - lack, 0 * n) for at in (0 * n, lack)]
        parts += [(every, at, n - short, 0 * n + 1) for at in (0 * n, short // 2, short)]
        entries = np.concatenate([np.column_stack(p)[(p[2] > 0) & ((lack > 0) | (i != 1) & (i != 2)) & ((short > lack) | (i < 3))] for i, p in enumerate(parts)])
        self.entry_item, self.entry_at, self.entry_size, self.entry_short = entries.T if len(entries) else np.zeros((4, 0), np.int64)
        order = np.argsort(self.entry_item, kind="stable")
        self.entries_of = order, np.searchsorted(self.entry_item[order], np.arange(len(n) + 1))
        prints, whole = fingerprints(hashes, first[self.entry_item] + self.entry_at, self.entry_size), self.entry_size == n[self.entry_item]
        of = {False: np.flatnonzero(self.entry_short == 0), True: np.flatnonzero((self.entry_short == 1) | whole)}
        self.hamming = {in_short: (Hamming(prints[own], radius), own) for in_short, own in of.items()}

    def best(self, hashes: np.ndarray, item: int, low: int, high: int, m: int) -> tuple[float, int] | None:
        """Of windows of m shingles that begin at low .. high the first of the most alike:
        similarity (sum of the smaller over sum of the larger weights) and start."""
        known, weight = (x[self.bounds[item] : self.bounds[item + 1]] for x in (self.shingle, self.weight.tolist()))
        span = hashes[low : high + m]
        at = np.minimum(np.searchsorted(known, span), len(known) - 1)
        ours = known[at] == span
        total = int(self.made[item])
        if 100 * int(ours.sum()) < self.percent * total:
            return None
        held, both, found = [0] * len(known), 0, None
        slots = np.where(ours, at, -1).tolist()
        for j, x in enumerate(slots):
            if x >= 0:
                held[x] += 1
                both += held[x] <= weight[x]
            if j >= m and (gone := slots[j - m]) >= 0:
                both -= held[gone] <= weight[gone]
                held[gone] -= 1
            if j >= m - 1 and 100 * both >= self.percent * (m + total - both) and (found is None or both > found[0]):
                found = both, low + j - m + 1
        return found and (found[0] / (m + total - found[0]), found[1])

    def search(self, words: Words) -> list[tuple[int, int, int, int, int, float]]:
        """The first of the best windows of every (text, item) that reaches the similarity:
        text, item, first word, words, distance of fingerprints, similarity."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        counts = np.diff(words.first)
        for (length, in_short), runs in self.tables.items():
            hashes, first = words.shingles(length)
            hit, run = runs.hits(hashes)
            text = np.searchsorted(first, hit, side="right") - 1
            asked = self._near(words, counts, runs, hit - first[text], text, run, length, in_short)
            n = self.sizes[asked[:, 1]]
            asked = asked[(counts[asked[:, 0]] < n) == in_short]
            seen = np.unique(text * len(runs.hashes) + run)
            asked = asked[runs.held(asked[:, 0], asked[:, 1], seen)]
            if not len(asked):
                continue
            # windows near each other are looked at in one span
            new = np.ones(len(asked), bool)
            new[1:] = (asked[1:, :2] != asked[:-1, :2]).any(axis=1) | (asked[1:, 2] - asked[:-1, 2] > 2 * self.sizes[asked[1:, 1]])
            starts = np.flatnonzero(new)
            for x, y in zip(starts.tolist(), np.append(starts[1:], len(asked)).tolist(), strict=True):
                t, i, n = int(asked[x, 0]), int(asked[x, 1]), int(self.sizes[asked[x, 1]])
                size = min(n, int(counts[t]))
                low, high = max(0, int(asked[x, 2]) - n), min(int(counts[t]) - size, int(asked[y - 1, 2]) + n)
                got = self.best(hashes[first[t] : first[t + 1]], i, low, high, max(1, size - length + 1))
                if got and ((t, i) not in best or got[0] > best[t, i][0]):
                    best[t, i] = got
        found = []
        for (t, i), (alike, s) in best.items():
            n = min(int(self.sizes[i]), int(counts[t]))
            own = fingerprints(words.hash, words.first[t : t + 1] + s, np.array([n]))[0]
            found.append((t, i, s, n, int(np.bitwise_count(own ^ self.prints_of[i])), alike))
        return found

    def _near(self, words: Words, counts: np.ndarray, runs: Runs, at: np.ndarray, text: np.ndarray, run: np.ndarray, length: int, in_short: bool) -> np.ndarray:
        """Candidates: text, item, and where the item would begin, of the windows around the
        runs at the places `at` of texts."""
        found = [np.zeros((0, 3), np.int64)]
        sizes = runs.bounds[run + 1] - runs.bounds[run] if len(run) else run
        for a, b in _pieces(sizes, 1 << 20):
            which, around = _runs(runs.bounds[run[a:b]], sizes[a:b])
            own, place = text[a:b][which], at[a:b][which]
            if in_short:  # only texts shorter than the item
                right = counts[own] < runs.full[around]
                own, place, around = own[right], place[right], around[right]
            size = np.minimum(runs.size[around], counts[own])
            start = np.clip(place - runs.before[around], 0, counts[own] - size)
            windows = np.unique(np.column_stack([own, start, size]), axis=0)
            hamming, entries = self.hamming[in_short]
            w, entry = hamming.near(fingerprints(words.hash, words.first[windows[:, 0]] + windows[:, 1], windows[:, 2]))
            entry = entries[entry]
            item = self.entry_item[entry]
            right = self.length[item] == length
            found.append(np.unique(np.column_stack([windows[w, 0], item, np.maximum(0, windows[w, 1] - self.entry_at[entry])])[right], axis=0))
        return np.unique(np.concatenate(found), axis=0)


def _blocks(items: DataFrame) -> Iterator[list[tuple[list, str]]]:
    """Distinct texts of items with their identifiers, in blocks of about a size that is
    checked before they leave the cluster."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held = rows.groupBy("text").agg(F.collect_list(F.struct("item_id")).alias("ids"))
    total = held.agg(F.sum(F.octet_length("text") + 8 * F.size("ids"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        yield [([x["item_id"] for x in r["ids"]], r["text"]) for r in held.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()]


def matches(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """Every (document, item) of which a window reaches the similarity: doc_id, item_id,
    start_word and n_words of the best window, distance of its fingerprint, similarity.

    The items are a query set: they go to the tasks in blocks of checked size, and every
    block meets all documents where they stand, so nothing is shuffled and no document
    meets another. Items of fewer than five words are found as runs of all their words.

    Null or wordless texts on either side match nothing; a null item_id or doc_id is
    carried as it is; repeated documents or items give rows each; of windows that tie the
    first counts; without items the result is empty. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, item_id long, start_word int, n_words int, distance int, similarity double"
    found = None
    for block in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, k, percent, radius)

            def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch | None:
                got = [(g, x) for g in index.search(words) for x in index.ids[g[1]]]
                if not got:
                    return None
                doc = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                columns = [[doc[g[0]] for g, _ in got], [x for _, x in got], *([g[j] for g, _ in got] for j in range(2, 6))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

            return by_text(batches, "text", make)

        part = rows.mapInArrow(searched, out)
        found = part if found is None else found.unionByName(part)
    return found


def without_matches(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that no item is found in, with all their columns and as they are.
    Null and wordless texts hold no item and stay, whatever their doc_id; repeated rows
    stay or go together; without items all stay. Every block of items is one more step
    over the rows of a partition, in the same scan."""
    kept = docs
    for block in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, k, percent, radius)

            def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
                hit = np.zeros(hi - lo, bool)
                hit[[g[0] for g in index.search(words)]] = True
                return batch.slice(lo, hi - lo).filter(pa.array(~hit))

            return by_text(batches, "text", make)

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


#: The same in DuckDB's SQL, without the fingerprints: every window that holds a shingle of an
#: item is compared with it, of pairs that share enough shingles for any window to be alike.
SQL = r"""
WITH words AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
split_ AS (SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM words),
items AS (SELECT id AS item_id, w, len(w) AS n, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM split_ WHERE kind = 1 AND len(w) > 0),
docs AS (SELECT id AS doc_id, w, len(w) AS n FROM split_ WHERE kind = 0 AND len(w) > 0),
item_shingles AS (SELECT item_id, k, s, count(*) AS c FROM (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM items)) GROUP BY ALL),
places AS (SELECT doc_id, k, i - 1 AS at_, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, n - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
hits AS (SELECT doc_id, item_id, at_, s, c FROM places JOIN item_shingles USING (k, s)),
pairs AS (SELECT h.doc_id, h.item_id FROM hits h JOIN items i USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 75 * any_value(i.m)),
sized AS (SELECT p.doc_id, p.item_id, i.m, d.n - least(i.n, d.n) AS last_, least(i.n, d.n) AS size, greatest(1, least(i.n, d.n) - i.k + 1) AS mw FROM pairs p JOIN items i USING (item_id) JOIN docs d USING (doc_id)),
starts AS (SELECT DISTINCT doc_id, item_id, m, mw, size, start_ FROM (SELECT z.*, unnest(range(greatest(0, at_ - mw + 1), least(last_, at_) + 1)) AS start_ FROM sized z JOIN hits USING (doc_id, item_id))),
shared AS (SELECT doc_id, item_id, m, mw, size, start_, least(count(*), any_value(c)) AS both_ FROM starts JOIN hits USING (doc_id, item_id) WHERE at_ BETWEEN start_ AND start_ + mw - 1 GROUP BY doc_id, item_id, m, mw, size, start_, s),
alike AS (SELECT doc_id, item_id, size, start_, CAST(sum(both_) AS DOUBLE) / (any_value(m) + any_value(mw) - sum(both_)) AS similarity FROM shared GROUP BY doc_id, item_id, size, start_ HAVING 100 * sum(both_) >= 75 * (any_value(m) + any_value(mw) - sum(both_)))
SELECT doc_id, item_id, CAST(start_ AS INTEGER) AS start_word, CAST(size AS INTEGER) AS n_words, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_) AS r FROM alike) WHERE r = 1
"""
