"""Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sliced(batches: Iterator[pa.RecordBatch], *texts: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at least one row, whose strings in the columns ``texts`` take about ``limit`` bytes."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for at in texts:
            size += pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
        ends = [*cuts.tolist(), batch.num_rows]
        for lo, hi in zip([0, *cuts.tolist()], ends, strict=True):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def pieces_of(arrays: Iterator[pa.Array], limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """A column of strings as lists of about ``limit`` bytes of text: only one of them is held as Python objects."""
    for part in sliced((pa.RecordBatch.from_arrays([a], names=["text"]) for a in arrays), 0, limit=limit):
        yield part.column(0).to_pylist()
