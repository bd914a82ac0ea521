"""Words, word hashes and shingles of many texts at once, as flat arrays.

A word is a maximal run of characters other than space and U+0009 to U+000D, with
A-Z put in lower case. UTF-8 keeps these separators and letters as single bytes that
occur nowhere else, so all of this works on bytes: a few passes of whole-array
arithmetic and no Python step for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together until they hold so many bytes; a longer text goes alone.
SLICE_BYTES = 1 << 21
SLICE_TEXTS = 2_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
    return cache["up"][:n], cache["down"][:n]


class Words:
    """The words of some texts.

    raw, lower: bytes of the texts; start, end: bounds of each word in them;
    first: for each text the number of its first word, and one more entry for the end;
    hash: of each word in lower case.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, splits: np.ndarray | None = None):
        """splits: for each of 256 bytes, whether it stands between words (ASCII only)."""
        n = len(raw)
        self.raw, self.bounds = raw, bounds
        space = (raw == 32) | ((raw >= 9) & (raw <= 13)) if splits is None else splits[raw]
        opens = np.empty(n, bool)
        closes = np.empty(n, bool)
        if n:
            opens[0] = closes[-1] = True
            opens[1:], closes[:-1] = space[:-1], space[1:]
            inner = bounds[(bounds > 0) & (bounds < n)]
            opens[inner], closes[inner - 1] = True, True
        word = ~space
        self.start = np.flatnonzero(word & opens)
        self.end = np.flatnonzero(word & closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.lower = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _STEP)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row, by text, and for each text its first shingle's
        number (one more entry for the end). A text of fewer words, but some, has one
        shingle of them all."""
        n, count = len(self.hash), np.diff(self.first)
        run = np.zeros(n, np.uint64)
        left = np.repeat(self.first[1:], count) - np.arange(n)  # words from here on
        step = np.uint64(1)
        for j in range(min(k, n)):
            more = self.hash[j:] * step
            run[: n - j] += np.where(left[: n - j] > j, more, np.uint64(0))
            step = np.uint64(int(step) * int(_STEP) & (1 << 64) - 1)
        is_first = np.zeros(n, bool)
        is_first[self.first[:-1][count > 0]] = True
        kept = (left >= k) | is_first & (left < k)
        short = np.minimum(left, k).astype(np.uint64)
        made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        return mix(run + short)[kept], np.concatenate([[0], np.cumsum(made)])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column (null: empty) and the bounds of its texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about `limit` bytes: from, to, their bytes and bounds."""
    raw, bounds = flat(column)
    at = 0
    while at < len(column):
        to = min(at + SLICE_TEXTS, max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1))
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def by_text(batches: Iterator[pa.RecordBatch], text: str, make: Callable[[Words, int, int, pa.RecordBatch], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: calls `make(words, from, to, batch)` for slices of each batch."""
    for batch in batches:
        for lo, hi, raw, bounds in slices(batch.column(text)):
            out = make(Words(raw, bounds), lo, hi, batch)
            if out is not None and out.num_rows:
                yield out
