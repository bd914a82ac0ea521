"""The best documents of a block of queries, by sums of weights, with bounds that spare most of the sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bounds give way by so much, as scores are rounded to nine places.
_SLACK = 1e-6
#: So many products are laid out at once.
_PRODUCTS = 1 << 20
#: To look a posting up costs as much as so many that are read in order.
_LOOK = 8


class Best:
    """The k best rows of each query so far: by score, the smaller key first on ties."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.keys = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: a row for each query, a column for each key; -inf is no match."""
        last, last_key = self.scores[:, -1:], self.keys[:, -1:]
        better = (scores > last) | (scores == last) & (keys[None, :] < last_key) & np.isfinite(scores)
        for q in np.flatnonzero(better.any(axis=1)).tolist():
            new = np.flatnonzero(better[q])
            if len(new) > 4 * self.k:  # what ties with the k-th best stays until keys decide
                new = new[scores[q, new] >= np.partition(scores[q, new], -self.k)[-self.k]]
            both, ids = np.append(self.scores[q], scores[q, new]), np.append(self.keys[q], keys[new])
            order = np.lexsort((ids, -both))[: self.k]
            self.scores[q], self.keys[q] = both[order], ids[order]

    def rows(self, ids: list[int], names: list[str]) -> pa.RecordBatch:
        which, at = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[which]), pa.array(self.keys[which, at]), pa.array(self.scores[which, at])], names=names)


class Postings:
    """Which of a piece's documents hold which terms, and with what weight: by term, then
    document, with the largest weight of each term, which bounds what it can add."""

    def __init__(self, keys: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.lexsort((row, term))
        self.keys, self.row, self.weight = keys, row[order], weight[order]
        self.terms, self.first, self.held = np.unique(term[order], return_index=True, return_counts=True)
        self.peak = np.maximum.reduceat(self.weight, self.first) if len(self.first) else np.zeros(0)
        self.cell = np.repeat(np.arange(len(self.terms)), self.held) * len(keys) + self.row


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes laid end to end: the run of each place, and its place in it."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _portions(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges over runs, each of about _PRODUCTS places."""
    if not len(sizes):
        return []
    part = (np.cumsum(sizes) - sizes) // _PRODUCTS
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True))


class Impacts:
    """A block of queries that meets documents piece by piece.

    A query's terms are added in layers, those first that can add most in the piece. As long
    as the terms that are left could alone reach the query's k-th best score (of the pieces
    before, or of the sums so far, which only grow), a layer is added to all documents that
    hold its terms. From then on, no document without a sum can be among the k best, and of
    the others only those stay whose sum, with all that the terms left could add, reaches
    that score. `summed` counts pairs that stayed until their sum was whole, `met` all."""

    def __init__(self, of: np.ndarray, term: np.ndarray, gain: np.ndarray, queries: int, k: int):
        """of, term, gain: for each term of a query, what a weight of 1 adds; 0 or more."""
        self.of, self.term, self.gain, self.queries = of, term, gain, queries
        self.best, self.summed, self.met = Best(queries, k), 0, 0

    def add(self, piece: Postings) -> None:
        n, q, k = len(piece.keys), self.queries, self.best.k
        self.met += n * q
        if not len(piece.terms) or not len(self.term):
            return
        at = np.minimum(np.searchsorted(piece.terms, self.term), len(piece.terms) - 1)
        there = piece.terms[at] == self.term
        of, gain, at = self.of[there], self.gain[there], at[there]
        most = gain * piece.peak[at]
        order = np.lexsort((-most, of))
        of, gain, at, most = of[order], gain[order], at[order], most[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        layer = np.where(place < 3, (place + 1) // 2, (place + 5) // 4)  # of 1, 2, 4, 4, ... terms
        last = np.full(q, -1)
        last[of] = layer  # by the last of a query's terms
        rest, need = np.bincount(of, most, minlength=q), self.best.scores[:, -1] - _SLACK
        scores, naming = np.zeros((n, q)), np.ones(q, bool)
        for step in range(last.max(initial=-1) + 1):
            naming &= rest >= need
            still = (scores > 0) & (scores + rest >= need)
            own = np.flatnonzero(layer == step)
            mine, held = of[own], piece.held[at[own]]
            look = _LOOK * np.count_nonzero(still, axis=0)[mine]  # what it costs to look up the documents left, term by term
            whole = naming[mine] | (look > held)
            scores += self._named(piece, mine[whole], gain[own[whole]], at[own[whole]], n)
            row, query = np.nonzero(still & ~naming)
            few = ~whole
            scores[row, query] += self._left(piece, mine[few], gain[own[few]], at[own[few]], row, query)
            ends = last == step
            self.summed += np.count_nonzero(np.where(naming, scores > 0, still)[:, ends])
            rest -= np.bincount(mine, most[own], minlength=q)
            if n >= k:
                need = np.maximum(need, np.partition(scores, n - k, axis=0)[n - k] - _SLACK)
        self.best.add(np.where((scores > 0) & (scores >= need), np.round(scores, 9), -np.inf).T, piece.keys)

    def _named(self, piece: Postings, of: np.ndarray, gain: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """What these terms add, documents x queries."""
        out = np.zeros(n * self.queries)
        for lo, hi in _portions(piece.held[at]):
            run, place = _runs(piece.held[at[lo:hi]])
            posting = piece.first[at[lo:hi]][run] + place
            out += np.bincount(piece.row[posting] * self.queries + of[lo:hi][run], piece.weight[posting] * gain[lo:hi][run], minlength=len(out))
        return out.reshape(n, self.queries)

    def _left(self, piece: Postings, of: np.ndarray, gain: np.ndarray, at: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """What these terms, ordered by query, add for the pairs of row and query."""
        out = np.zeros(len(row))
        first, sizes = np.searchsorted(of, query), np.bincount(of, minlength=self.queries)[query]
        for lo, hi in _portions(sizes):
            run, place = _runs(sizes[lo:hi])
            term = first[lo:hi][run] + place
            cell = at[term] * len(piece.keys) + row[lo:hi][run]
            posting = np.minimum(np.searchsorted(piece.cell, cell), len(piece.cell) - 1)
            hit = piece.cell[posting] == cell
            out[lo:hi] = np.bincount(run[hit], piece.weight[posting[hit]] * gain[term[hit]], minlength=hi - lo)
        return out
