"""Arrow batches of rows that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def in_groups(batches: Iterable[pa.RecordBatch], key_columns: int) -> Iterator[pa.RecordBatch]:
    """Splits batches sorted by their first columns into record batches of whole groups."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        same = np.ones(batch.num_rows, bool)
        for c in range(key_columns):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        n = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = batch.slice(n)
        if n:
            yield batch.slice(0, n)
    if rest is not None and rest.num_rows:
        yield rest
