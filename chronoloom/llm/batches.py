"""Arrow batches in slices that bound a worker's memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZED = (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 2_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in order, none with more than `rows` rows or `size` bytes of text.

    A single row may be larger and then comes alone; an empty batch stays one.
    """
    for batch in batches:
        total = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if any(kind(column.type) for kind in SIZED):
                lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                total[1:] += np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < max(1, batch.num_rows):
            fits = int(np.searchsorted(total, total[at] + size, "right")) - 1
            end = min(max(fits, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at = end
