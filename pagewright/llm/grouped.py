"""Whole groups from sorted batches, so that Python sees many small groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pagewright.llm.kernels import release


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2000) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys`` (integers); holds the open group and a few batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        cut = runs([table[k].to_numpy() for k in keys])[-2]
        if cut:
            yield table.slice(0, int(cut))
            rest = table.slice(int(cut))
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        least = max(2000, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    release()
