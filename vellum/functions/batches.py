"""Arrow batches in pieces, so that a worker's memory follows bytes and not the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a batch that Python turns into its own objects at once; one row may have more.
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, in slices of at most ``size`` bytes or of one row."""
    if batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), size)
        yield from pieces(batch.slice(half), size)
    elif batch.num_rows:
        yield batch
