"""Sorted Arrow streams inside a task: where groups begin, and whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def row_slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def changes(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """For each row but the first whether one of the keys differs from the row before; nulls are equal."""
    n = table.num_rows
    out = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys if n > 1 else ():
        column = table.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a, b = column.slice(0, n - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), True)
        if column.null_count:
            differs = pc.and_(differs, pc.invert(pc.and_(pc.is_null(a), pc.is_null(b))))
        out |= differs.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each group of a stream sorted by the keys, however the batches cut it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held:
            edge = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)])
            if changes(edge, keys)[0]:
                yield pa.concat_tables(held)
                held = []
        cuts = [0, *(np.flatnonzero(changes(table, keys)) + 1).tolist(), table.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            held.append(table.slice(a, b - a))
            yield pa.concat_tables(held)
            held = []
        held.append(table.slice(cuts[-2]))
    if held:
        yield pa.concat_tables(held)
