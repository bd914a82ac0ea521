"""Batches of Arrow in pieces of bounded size, however many rows Spark puts in one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece has about so many bytes of text, or elements of a list.
PIECE_SIZE = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_SIZE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch, in order and complete, each of about `most` bytes of a text column or
    elements of a list column; a longer row stands alone."""
    held = batch.column(column)
    length = pc.list_value_length(held) if pa.types.is_list(held.type) or pa.types.is_large_list(held.type) else pc.binary_length(held)
    upto = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end
