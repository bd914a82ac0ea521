"""Repeated passages: shared seeds, collinear chains, alignment.

Every run of four words is a seed: of 50 words with 10 replaced at least seven seeds stay.
Seeds are counted in groups of hashes, and those that occur again go on. A seed links each
of its places to the first place that holds it, by document and in it, which is linear in
the occurrences however many share it. Where the seeds of a document turn from one partner
to another, they are linked to the places before them as well: a passage of two parts that
stand first in two other documents has its own earlier holder there. Seeds of a pair of
documents are chained in order, with costs for gaps, through a Fenwick tree; chains are
aligned word by word and extended at both ends, as far as the words stay alike.

A seed that very many places hold is dealt out by document. Its first place is found
beforehand, so that no task holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._filters import filter_of, id_hash, passes
from corpusloom.llm._words import Words, by_text, mix
from corpusloom.session import cut

SEED_WORDS = 4
LEAST_SEEDS = 4  # of a chain; a passage has seven, some of which may be linked elsewhere
STRIDE = 8  # of seeds that follow each other in both texts one in so many is chained
PART_BYTES = 32 << 20  # seeds, and documents, are taken in groups of about so many bytes of text
LEAST_PART_BITS, MOST_PART_BITS = 9, 20  # of groups, as powers of 2
LEAST_FILTER_BITS, MOST_FILTER_BITS = 26, 29  # of the filter of seeds, which goes to all tasks: 8 to 64 MB
KEY_BITS = 32  # by which seeds of a group are counted
HOT_PLACES, HOT_BYTES = 2_000, 120_000  # a seed is dealt out by document if it has so many places, and one in so many bytes
SEAM_GAP, SEAM_SEEDS = 16, 8  # seeds within so many words follow each other; so many on both sides of a seam are linked twice
MARGIN = 64  # a chain is cut at gaps of more words
FETCHED = 32  # words beyond a chain that alignment may reach at first; the last seed of a passage is seldom further from its end
WIDER = 8  # where the words are alike to the end of the span, it is fetched so much wider
GRID = 16  # spans are fetched in units of so many words
GAP_COST = 0.1  # for a word of a gap, on either side
DROP = 8  # extension ends where it has lost so much: a match gives 1, else -2
SHIFT, RESUME = 4, 5
_FAR = 1 << 30
_SHIFTS = sorted(((i, j) for i in range(SHIFT + 1) for j in range(SHIFT + 1) if i or j), key=sum)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in all columns, and the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of the bytes between the bounds (in rows of values)."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // len(values) if len(values) else 1
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _grouped(group: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each run of a group: its number and the columns' bytes."""
    bounds = _runs(group)
    return pa.RecordBatch.from_arrays([pa.array(group[bounds[:-1]].astype(np.int32)), *(_packed(c, bounds) for c in columns.values())], names=["part", *columns])


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _part(hashes: np.ndarray, part_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - part_bits)).astype(np.int64)


def _prefix(hashes: np.ndarray, part_bits: int) -> np.ndarray:
    """The bits by which seeds are counted: those of the group and KEY_BITS more."""
    return hashes >> np.uint64(64 - KEY_BITS - part_bits)


def _places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of every seed."""
    hashes, first = words.shingles(SEED_WORDS)
    made = np.diff(first)
    text = np.repeat(np.arange(len(made)), made)
    enough = np.repeat(np.diff(words.first) >= SEED_WORDS, made)
    return hashes[enough], text[enough], (np.arange(len(hashes)) - first[text])[enough]


def _counted(batches: Iterator[pa.RecordBatch], part_bits: int) -> Iterator[pa.RecordBatch]:
    """Key of each seed of a slice and its places there (255 at most), in groups."""

    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, places = np.unique(_places(words)[0], return_counts=True)
        held = np.empty((len(hashes), 5), np.uint8)
        held[:, :4] = _prefix(hashes, part_bits).astype("<u4").view(np.uint8).reshape(-1, 4)
        held[:, 4] = np.minimum(places, 255)
        return _grouped(_part(hashes, part_bits), {"held": held})

    return by_text(batches, "text", make)


def _again(table: pa.Table, part_bits: int, filter_bits: int, hot: int) -> pa.Table:
    """The filter's bits of the seeds of a group that occur again, and the prefixes of those
    that have very many places."""
    part = table.column("part")[0].as_py()
    raw = _joined(table, "held", np.uint8).reshape(-1, 5)
    keys, places = np.ascontiguousarray(raw[:, :4]).view("<u4").ravel(), raw[:, 4].astype(np.int64)
    order = np.argsort(keys)
    keys, places = keys[order], places[order]
    at = _runs(keys)[:-1]
    total = np.add.reduceat(places, at) if len(at) else at
    own = np.zeros(1 << filter_bits - part_bits, bool)
    own[keys[at][total > 1] >> np.uint32(KEY_BITS - filter_bits + part_bits)] = True
    often = keys[at][total >= hot].astype(np.uint64) | np.uint64(part << KEY_BITS)
    return pa.table({"part": pa.array([part], pa.int32()), "held": pa.array([np.packbits(own, bitorder="little").tobytes()]), "hot": pa.array([often.tobytes()])})


def _put_together(table: pa.Table) -> pa.Table:
    """Neighbouring groups of the filter as one."""
    table = table.sort_by("part")
    size, first = len(table.column("held")[0].as_py()), table.column("top")[0].as_py()
    bits = np.zeros((table.column("each")[0].as_py(), size), np.uint8)
    for part, held in zip(table.column("part").to_pylist(), table.column("held").to_pylist(), strict=True):
        bits[part % len(bits)] = np.frombuffer(held, np.uint8)
    return pa.table({"part": pa.array([first], pa.int32()), "held": pa.array([bits.tobytes()]), "hot": pa.array([_joined(table, "hot", np.uint8).tobytes()])})


def _often(hashes: np.ndarray, hot: np.ndarray, part_bits: int) -> np.ndarray:
    """Whether each seed is one of very many places."""
    if not len(hot):
        return np.zeros(len(hashes), bool)
    own = _prefix(hashes, part_bits)
    return hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own


def _firsts(batches: Iterator[pa.RecordBatch], hot: np.ndarray, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Of seeds of very many places the first one of each slice."""

    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, text, place = _places(words)
        at = np.flatnonzero(_often(hashes, hot, part_bits))
        doc = batch.column("doc_id").slice(lo, hi - lo).to_numpy()[text[at]]
        order = np.lexsort((place[at], doc, hashes[at]))
        order = order[_runs(hashes[at][order])[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(hashes[at][order].view(np.int64)), pa.array(doc[order]), pa.array(place[at][order].astype(np.int32))], names=["seed", "doc", "place"])

    return by_text(batches, "text", make)


def _seeds(batches: Iterator[pa.RecordBatch], bits: np.ndarray, hot: np.ndarray, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Seeds that pass the filter, in groups."""

    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, text, place = _places(words)
        at = np.flatnonzero(passes(bits, hashes))
        ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy()
        hashes, doc, place = hashes[at], ids[text[at]], place[at].astype(np.int32)
        part = np.where(_often(hashes, hot, part_bits), _part(mix(doc.view(np.uint64)), part_bits), _part(hashes, part_bits))
        order = np.lexsort((hashes, part))
        return _grouped(part[order], {"seed": hashes[order], "doc": doc[order], "place": place[order]})

    return by_text(batches, "text", make)


def _linked(table: pa.Table, firsts: tuple[np.ndarray, np.ndarray, np.ndarray], part_bits: int, within: bool) -> pa.Table:
    """Every place of a seed with the first one and with the one before, in groups by document.
    Unless places within a document count as well, the one before is in another document."""
    seed, doc, place = _joined(table, "seed", np.uint64), _joined(table, "doc", np.int64), _joined(table, "place", np.int32)
    order = np.lexsort((place, doc, seed))
    order = order[_runs(seed[order], doc[order], place[order])[:-1]]  # repeated rows count once
    seed, doc, place = seed[order], doc[order], place[order]
    bounds = _runs(seed)
    at = np.repeat(bounds[:-1], np.diff(bounds))
    partner, y = doc[at], place[at]
    hot, hot_doc, hot_place = firsts
    if len(hot):
        which = np.minimum(np.searchsorted(hot, seed), len(hot) - 1)
        known = hot[which] == seed
        partner, y = np.where(known, hot_doc[which], partner), np.where(known, hot_place[which], y)
    own = np.arange(len(seed)) if within else np.repeat(_runs(seed, doc)[:-1], np.diff(_runs(seed, doc)))
    before = np.maximum(own - 1, at)  # the first place of a group has none
    alone = own == at
    prev, z = np.where(alone, partner, doc[before]), np.where(alone, y, place[before])
    later = np.flatnonzero((partner != doc) | (y != place) if within else partner != doc)
    group = _part(mix(doc[later].view(np.uint64)), part_bits)
    columns = {"doc": doc[later], "partner": partner[later], "x": place[later], "y": y[later], "prev": prev[later], "z": z[later]}
    order = np.lexsort((columns["x"], columns["doc"], group))
    return pa.Table.from_batches([_grouped(group[order], {k: c[order] for k, c in columns.items()})])


def chains(x: np.ndarray, y: np.ndarray, seed_words: int = SEED_WORDS, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Anchors (x, y) as chains that rise in both, best first; every anchor is in one.

    f(i) = seed_words + max(0, f(j) - gap_cost * (dx + dy)) over j below and left of i.
    With the cost linear, f(j) + gap_cost * (x + y) is a prefix maximum over y, which a
    Fenwick tree gives while anchors are taken in order of x.
    """
    n = len(x)
    rank = np.searchsorted(np.unique(y), y) + 1
    tree: list[tuple[float, int]] = [(0.0, -1)] * (int(rank.max()) + 1)
    score, back = [0.0] * n, [-1] * n
    order = np.lexsort((y, x))
    xs, ys, ranks = x.tolist(), y.tolist(), rank.tolist()
    waiting: list[int] = []

    def put(i: int) -> None:
        value, r = (score[i] + gap_cost * (xs[i] + ys[i]), i), ranks[i]
        while r < len(tree):
            if tree[r][1] < 0 or value[0] > tree[r][0]:
                tree[r] = value
            r += r & -r

    for i in order.tolist():
        if waiting and xs[waiting[0]] != xs[i]:  # anchors of one x don't follow each other
            for j in waiting:
                put(j)
            waiting = []
        best, r = (0.0, -1), ranks[i] - 1
        while r:
            if tree[r][1] >= 0 and (best[1] < 0 or tree[r][0] > best[0]):
                best = tree[r]
            r -= r & -r
        gain = best[0] - gap_cost * (xs[i] + ys[i]) if best[1] >= 0 else 0.0
        score[i], back[i] = seed_words + max(0.0, gain), best[1] if gain > 0 else -1
        waiting.append(i)
    used, found = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            found.append(chain[::-1])
    return found


_CHAIN = pa.schema([("doc_id", pa.int64()), ("partner", pa.int64()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("room_before", pa.int32()), ("room_after", pa.int32())])


def _seams(doc: np.ndarray, partner: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of anchors by document and place those near a turn to another partner, or to a place
    elsewhere in it."""
    n = len(x)
    if n < 2:
        return np.zeros(n, bool)
    follows = (doc[1:] == doc[:-1]) & (x[1:] - x[:-1] <= SEAM_GAP)
    turns = follows & ((partner[1:] != partner[:-1]) | (np.abs((y - x)[1:] - (y - x)[:-1]) > 2 * SHIFT))
    upto, i = np.concatenate([[0], np.cumsum(turns)]), np.arange(n)
    return upto[np.minimum(i + SEAM_SEEDS, n - 1)] > upto[np.maximum(i - SEAM_SEEDS, 0)]


def _straight_chains(pair: np.ndarray, x: np.ndarray, weight: np.ndarray, least_seeds: int) -> tuple[np.ndarray, ...]:
    """Anchors of pairs on one diagonal each: bounds of the chains, and the room around each."""
    new = np.ones(len(x), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (x[1:] - x[:-1] > MARGIN)
    bounds = np.append(np.flatnonzero(new), len(x))
    kept = np.flatnonzero(np.add.reduceat(weight, bounds[:-1]) >= least_seeds) if len(x) else np.zeros(0, np.int64)
    lo, hi = bounds[:-1][kept], bounds[1:][kept]
    same = pair[lo[1:]] == pair[lo[:-1]] if len(lo) else np.zeros(0, bool)
    before, after = x[lo].astype(np.int64), np.full(len(lo), _FAR, np.int64)
    gap = x[lo[1:]] - x[hi[:-1] - 1]
    before[1:][same], after[:-1][same] = gap[same] - SEED_WORDS, gap[same]
    return lo, hi, before, after


def _chained(table: pa.Table, least_seeds: int) -> pa.Table:
    """Anchors of a group of documents to a row for each chain, with the room that other
    chains of the pair leave before and after it."""
    doc, partner, prev = (_joined(table, c, np.int64) for c in ("doc", "partner", "prev"))
    x, y, z = (_joined(table, c, np.int32) for c in ("x", "y", "z"))
    order = np.lexsort((x, doc))
    doc, partner, prev, x, y, z = (c[order] for c in (doc, partner, prev, x, y, z))
    twice = np.flatnonzero(_seams(doc, partner, x, y) & ((prev != partner) | (z != y)))
    doc, partner, x, y = (np.concatenate(c) for c in ((doc, doc[twice]), (partner, prev[twice]), (x, x[twice]), (y, z[twice])))
    order = np.lexsort((x, y - x, partner, doc))
    doc, partner, x, y = (c[order] for c in (doc, partner, x, y))
    # of seeds that follow each other on a diagonal some stand for all
    runs = _runs(doc, partner, y - x, x - np.arange(len(x)))
    size = np.diff(runs)
    within = np.arange(len(x)) - np.repeat(runs[:-1], size)
    kept = np.flatnonzero((within % STRIDE == 0) | (within == np.repeat(size, size) - 1))
    weight = np.diff(np.append(kept, len(x)))
    doc, partner, x, y = (c[kept] for c in (doc, partner, x, y))
    pairs = _runs(doc, partner)
    pair = np.repeat(np.arange(len(pairs) - 1), np.diff(pairs))
    if not len(x):
        return _CHAIN.empty_table()
    enough = np.add.reduceat(weight, pairs[:-1]) >= least_seeds
    turns = np.zeros(len(x), np.int64)
    turns[1:] = (pair[1:] == pair[:-1]) & ((y - x)[1:] != (y - x)[:-1])
    straight = np.add.reduceat(turns, pairs[:-1]) == 0

    own = np.flatnonzero((enough & straight)[pair])
    lo, hi, before, after = _straight_chains(pair[own], x[own], weight[own], least_seeds)
    which = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]) if len(lo) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[own][which], pa.int32())) for c in (x, y)]
    done = pa.table([pa.array(doc[own][lo]), pa.array(partner[own][lo]), *lists, pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], schema=_CHAIN)

    rows: list[tuple] = []
    for p in np.flatnonzero(enough & ~straight).tolist():
        a, b = int(pairs[p]), int(pairs[p + 1])
        px, py, parts, seeds = x[a:b], y[a:b], [], weight[a:b].tolist()
        for chain in chains(px, py):
            if sum(seeds[i] for i in chain) < least_seeds:
                continue
            gaps = np.maximum(np.diff(px[chain]), np.diff(py[chain])) > MARGIN  # passages of their own
            for part in np.split(np.array(chain), np.flatnonzero(gaps) + 1):
                if weight[a:b][part].sum() >= least_seeds:
                    parts.append((px[part], py[part]))
        starts, ends = np.sort([q[0][0] for q in parts]), np.sort([q[0][-1] + SEED_WORDS for q in parts])
        for cx, cy in parts:
            i, j = np.searchsorted(ends, cx[0], side="right"), np.searchsorted(starts, cx[-1], side="right")
            low = cx[0] - ends[i - 1] if i else cx[0]
            high = starts[j] - cx[-1] if j < len(starts) else _FAR
            rows.append((int(doc[a]), int(partner[a]), cx.tolist(), cy.tolist(), int(low), int(high)))
    return pa.concat_tables([done, pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHAIN)], schema=_CHAIN)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, as hashes, of the spans that are asked for of a text."""

    def make(words: Words, lo: int, hi: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, spans = batch.column("doc_id").slice(lo, hi - lo).to_pylist(), batch.column("spans").slice(lo, hi - lo).to_pylist()
        rows = []
        short = words.hash.astype(np.uint32)
        for d, (doc, asked) in enumerate(zip(ids, spans, strict=True)):
            mine = short[words.first[d] : words.first[d + 1]]
            rows += [(doc, s["a"], s["b"], mine[s["a"] : s["b"]].tobytes()) for s in asked]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["of", "a", "b", "words"])

    return by_text(batches, "text", make)


def _straight(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs of words go on together without a shift, and their matches there."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    falls = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total >= DROP)
    upto = falls[0] if len(falls) else n
    if not upto or total[:upto].max() <= 0:
        return 0, 0
    best = int(total[:upto].argmax()) + 1
    return best, int(same[:best].sum())


def _reach(a: np.ndarray, b: np.ndarray, most: int = _FAR) -> tuple[int, int, int]:
    """How far two runs of words go on together, each, and their matches. Words left out or
    put in, up to SHIFT on both sides, are passed over if RESUME equal words follow; b is
    never shifted by more than `most` words against a."""
    p = q = matches = 0
    held = None
    while True:
        n, same = _straight(a[p:], b[q:])
        p, q, matches = p + n, q + n, matches + same
        if min(len(a) - p, len(b) - q) < RESUME:
            return p, q, matches
        held = held or (a.tobytes(), b.tobytes())
        ones, others = ([text[w * at : w * (at + RESUME)] for at in range(start, start + SHIFT + 1)] for text, w, start in zip(held, (a.itemsize, b.itemsize), (p, q), strict=True))
        for i, j in _SHIFTS:
            if ones[i] == others[j] and q + j - p - i <= most and min(len(a) - p - i, len(b) - q - j) >= RESUME:
                p, q = p + i, q + j
                break
        else:
            return p, q, matches


def _goes_on(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether what is left of two spans ends before it has lost enough to end a passage."""
    n = min(len(a), len(b))
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    return not (np.maximum.accumulate(np.maximum(total, 0)) - total >= DROP).any()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that a gap of each side has in common, in order."""
    if len(a) == len(b) and a.tobytes() == b.tobytes():
        return len(a)
    at: dict[int, int] = {}
    for place, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << place
    every = (1 << len(b)) - 1
    free = every  # bit by bit the places of b where the row of the usual table doesn't rise
    for w in a.tolist():
        met = free & at.get(w, 0)
        free = (free + met | free - met) & every
    return len(b) - free.bit_count()


def align(one: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, apart: int | None = None) -> tuple[int, int, int, int, int]:
    """Bounds of the passage in both (end exclusive), and the matches, from anchors. Of one
    text, whose spans begin `apart` words from each other, no place is aligned with itself."""
    room = lambda between: _FAR if apart is None else between + apart - 1
    other_back, back, matches = _reach(other[: y[0]][::-1], one[: x[0]][::-1], room(int(x[0] - y[0])))
    start, other_start = x[0] - back, y[0] - other_back
    p, q = int(x[0]), int(y[0])
    size = int(x[-1]) + SEED_WORDS - p
    if int(y[-1]) + SEED_WORDS - q == size and (one[p : p + size] == other[q : q + size]).all():  # word by word
        p, q, matches, x, y = p + size, q + size, matches + size, x[:0], y[:0]
        last = p - q
    else:
        last = int(x[-1] - y[-1])
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        if i > p or j > q:
            matches += _common(one[p:i], other[q:j]) if i >= p and j >= q else 0
        step = max(p - i, q - j, 0)  # anchors may overlap
        take = max(0, SEED_WORDS - step)
        matches += take
        p, q = max(p, i + SEED_WORDS), max(q, j + SEED_WORDS)
    more, other_more, extra = _reach(one[p:], other[q:], room(last))
    return int(start), int(p + more), int(other_start), int(q + other_more), int(matches + extra)


def _further(one: np.ndarray, other: np.ndarray, got: tuple, least_words: int, identity: float) -> tuple:
    """A passage that ends short of least_words taken on at both ends, without a shift, to equal
    words beyond unlike ones: as far as it takes, with the most matches, if all of it stays
    alike enough; else as it is."""
    s, e, t, u, matches = got
    lacks = least_words - min(e - s, u - t)
    if lacks <= 0 or matches < identity * least_words - lacks:
        return got
    left, right = min(s, t, 2 * lacks), min(len(one) - e, len(other) - u, 2 * lacks)
    before = one[s - left : s][::-1] == other[t - left : t][::-1]
    after = one[e : e + right] == other[u : u + right]
    if matches + np.count_nonzero(before) + np.count_nonzero(after) < identity * (max(e - s, u - t) + lacks):
        return got
    a, b = (np.append(0, np.flatnonzero(same) + 1) for same in (before, after))
    total = matches + np.append(0, np.cumsum(before))[a][:, None] + np.append(0, np.cumsum(after))[b][None, :]
    longer = a[:, None] + b[None, :]
    good = (longer >= lacks) & (total >= identity * (max(e - s, u - t) + longer))
    if not good.any():
        return got
    i, j = np.unravel_index(np.where(good, total - longer, -_FAR).argmax(), total.shape)
    return s - int(a[i]), e + int(b[j]), t - int(a[i]), u + int(b[j]), int(total[i, j])


def _alike(one: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, apart: int | None, least_words: int, identity: float) -> tuple[tuple, list[tuple]]:
    """The alignment of all anchors, and the passages that are alike enough: all of it, or
    parts of it, cut at the widest gap."""
    whole, found, open_ = None, [], [(0, len(x))]
    while open_:
        a, b = open_.pop()
        got = align(one, other, x[a:b], y[a:b], apart)
        whole = whole or got
        s, e, t, u, matches = got = _further(one, other, got, least_words, identity)
        if min(e - s, u - t) >= least_words and matches >= identity * max(e - s, u - t):
            if not found or s >= found[-1][1] and t >= found[-1][3]:  # parts may reach into each other
                found.append(got)
        elif b - a > 1 and max(e - s, u - t) > least_words:
            at = a + 1 + int(np.maximum(np.diff(x[a:b]), np.diff(y[a:b])).argmax())
            open_ += [(at, b), (a, at)]
    return whole, found


def _equal(one: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Anchors whose words are the same in the texts at hand: a doc_id may have had two."""
    good = (x + SEED_WORDS <= len(one)) & (y + SEED_WORDS <= len(other))
    run = np.arange(SEED_WORDS)
    good[good] = (one[x[good][:, None] + run] == other[y[good][:, None] + run]).all(axis=1)
    return good


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists of numbers, none of them null, and the bounds of its lists."""
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64), bounds - bounds[0]


def _aligned(batches: Iterator[pa.RecordBatch], least_words: int, identity: float) -> Iterator[pa.RecordBatch]:
    """Passages, and what has to be aligned once more: before and after have grown there."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int32()] * 4]
    for batch in batches:
        rows = []
        flat_x, bounds_x = _lists(batch.column("x"))
        flat_y, bounds_y = _lists(batch.column("y"))
        for k, r in enumerate(batch.drop_columns(["x", "y"]).to_pylist()):
            one, other = np.frombuffer(r["words_x"], np.uint32), np.frombuffer(r["words_y"], np.uint32)
            whole_x, whole_y = flat_x[bounds_x[k] : bounds_x[k + 1]], flat_y[bounds_y[k] : bounds_y[k + 1]]
            x, y = whole_x - r["ax"], whole_y - r["ay"]
            good = _equal(one, other, x, y)
            if not good.any():
                continue
            apart = r["ax"] - r["ay"] if r["doc_id"] == r["partner"] else None
            (s, e, t, u, _), found = _alike(one, other, x[good], y[good], apart, least_words, identity)
            before, after = r["before"], r["after"]
            if r["ax"] and r["ay"] and _goes_on(one[:s][::-1], other[:t][::-1]):
                before = max(before, min(WIDER * before, r["room_before"]))
            if len(one) == r["bx"] - r["ax"] and len(other) == r["by"] - r["ay"] and _goes_on(one[e:], other[u:]):
                after = max(after, min(WIDER * after, r["room_after"]))
            if (before, after) != (r["before"], r["after"]):
                rows.append((r["doc_id"], None, None, r["partner"], None, None, None, None, whole_x.tolist(), whole_y.tolist(), r["room_before"], r["room_after"], before, after))
                continue
            for s, e, t, u, matches in found:
                rows.append((r["doc_id"], s + r["ax"], e + r["ax"], r["partner"], t + r["ay"], u + r["ay"], e - s, round(min(1.0, matches / max(e - s, u - t)), 6), *[None] * 6))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_NAMES)


def _shared(rows: DataFrame, part_bits: int, filter_bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of seeds that occur again, and the prefixes of those that have `hot` places
    or more: as a place takes two bytes of text, HOT_BYTES / 2 of them at most."""
    counted = rows.mapInArrow(lambda b: _counted(b, part_bits), "part int, held binary").groupBy("part").applyInArrow(lambda t: _again(t, part_bits, filter_bits, hot), "part int, held binary, hot binary")
    if part_bits > LEAST_PART_BITS:
        each = 1 << part_bits - LEAST_PART_BITS
        counted = counted.select("*", F.floor(F.col("part") / each).cast("int").alias("top"), F.lit(each).alias("each")).groupBy("top").applyInArrow(_put_together, "part int, held binary, hot binary")
    got = counted.toArrow()
    bits = np.zeros((1 << LEAST_PART_BITS, 1 << filter_bits - LEAST_PART_BITS - 3), np.uint8)
    for part, held in zip(got.column("part").to_pylist(), got.column("held").to_pylist(), strict=True):
        bits[part] = np.frombuffer(held, np.uint8)
    return bits.ravel(), np.sort(_joined(got, "hot", np.uint64))


def _first_places(rows: DataFrame, hot: np.ndarray, part_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, document and place where each seed of very many places stands first."""
    if not len(hot):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    sent = rows.sparkSession.sparkContext.broadcast(hot)
    each = rows.mapInArrow(lambda b: _firsts(b, sent.value, part_bits), "seed long, doc long, place int")
    got = each.groupBy("seed").agg(F.min(F.struct("doc", "place")).alias("_")).select("seed", "_.*").toArrow()
    seed, doc, place = (got.column(c).to_numpy() for c in ("seed", "doc", "place"))
    order = np.argsort(seed.view(np.uint64))
    return seed.view(np.uint64)[order], doc[order], place[order].astype(np.int32)


def repeated_passages(docs: DataFrame, least_words: int = 50, identity: float = 0.8, within: bool = True) -> DataFrame:
    """Passages of documents that an earlier document (by doc_id) or, with `within`, an earlier
    place of the same one holds as well, alike in at least `identity` of their words: doc_id,
    start_word, end_word (exclusive), partner, partner_start, partner_end, n_words, identity.

    The partner is the first place of the passage's seeds, so a passage at m places gives
    about m - 1 rows, whether these are in one document or in many; a document that
    repeats a passage of its own is its partner. A passage put together of parts that stand
    first elsewhere has its earlier holder as a partner too. Words are compared in lower case.

    Null, empty and short texts have no passages; rows of null doc_id take no part;
    repeated rows of one doc_id count once, with one of their texts; ties go to the
    smaller doc_id. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(MOST_PART_BITS, max(LEAST_PART_BITS, (size // PART_BYTES).bit_length()))
    filter_bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (size // 8).bit_length()))
    bits, hot = _shared(rows, part_bits, filter_bits, max(HOT_PLACES, size // HOT_BYTES))
    sent = docs.sparkSession.sparkContext.broadcast((bits, hot, _first_places(rows, hot, part_bits)))
    shared = rows.mapInArrow(lambda b: _seeds(b, *sent.value[:2], part_bits), "part int, seed binary, doc binary, place binary")
    anchors = shared.groupBy("part").applyInArrow(lambda t: _linked(t, sent.value[2], part_bits, within), "part int, doc binary, partner binary, x binary, y binary, prev binary, z binary")
    # so many seeds stay in the shortest passage if its unlike words are replaced one by one
    stay = least_words - SEED_WORDS + 1 - SEED_WORDS * int((1 - identity) * least_words + 1e-9)
    least_seeds = max(1, min(LEAST_SEEDS, stay))
    found = cut(anchors.groupBy("part").applyInArrow(lambda t: _chained(t, least_seeds), "doc_id long, partner long, x array<int>, y array<int>, room_before int, room_after int"))
    found, done = found.withColumn("before", F.lit(FETCHED)).withColumn("after", F.lit(FETCHED)), None
    while True:
        aligned = cut(_fetched(rows, found).mapInArrow(lambda b: _aligned(b, least_words, identity), _ALIGNED))
        part = aligned.where("before is null").select(_NAMES[:8])
        done = part if done is None else done.unionByName(part)
        found = aligned.where("before is not null").select("doc_id", "partner", *_NAMES[8:])
        if found.isEmpty():
            return done


_ALIGNED = "doc_id long, start_word int, end_word int, partner long, partner_start int, partner_end int, n_words int, identity double, x array<int>, y array<int>, room_before int, room_after int, before int, after int"
_NAMES = [c.split()[0] for c in _ALIGNED.split(", ")]


def _fetched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Chains with the words around them in both texts."""

    def span(places: str, name: str) -> list:
        low = F.greatest(F.lit(0), F.floor((F.col(places)[0] - F.col("before")) / GRID) * GRID).cast("int")
        high = (F.ceil((F.element_at(places, -1) + SEED_WORDS + F.col("after")) / GRID) * GRID).cast("int")
        return [low.alias(f"a{name}"), high.alias(f"b{name}")]

    asked = found.select("*", *span("x", "x"), *span("y", "y"))
    spans = asked.select(F.col("doc_id").alias("of"), F.col("ax").alias("a"), F.col("bx").alias("b")).unionByName(asked.select(F.col("partner").alias("of"), F.col("ay").alias("a"), F.col("by").alias("b"))).distinct()
    spans = cut(spans.groupBy("of").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    wanted = rows.sparkSession.sparkContext.broadcast(filter_of(spans.select(id_hash("of").alias("key")), "key"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = passes(wanted.value, batch.column("key").to_numpy(zero_copy_only=False))
            yield batch.select(["doc_id", "text"]).filter(pa.array(good))

    texts = rows.withColumn("key", id_hash("doc_id")).mapInArrow(passing, "doc_id long, text string")
    held = texts.join(spans, texts.doc_id == spans.of).select("doc_id", "text", "spans").dropDuplicates(["doc_id"]).mapInArrow(_slices, "of long, a int, b int, words binary")
    held = cut(held)
    side = lambda n: held.select(F.col("of").alias(f"of{n}"), F.col("a").alias(f"a{n}_"), F.col("b").alias(f"b{n}_"), F.col("words").alias(f"words_{n}"))
    both = asked.join(side("x"), (F.col("doc_id") == F.col("ofx")) & (F.col("ax") == F.col("ax_")) & (F.col("bx") == F.col("bx_")))
    both = both.join(side("y"), (F.col("partner") == F.col("ofy")) & (F.col("ay") == F.col("ay_")) & (F.col("by") == F.col("by_")))
    return both.select("doc_id", "partner", "x", "y", "ax", "bx", "ay", "by", "room_before", "room_after", "before", "after", "words_x", "words_y")
