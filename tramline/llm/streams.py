"""Reading sorted partitions group by group inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows as tuples; only ``step`` of them are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield from zip(*(column.to_pylist() for column in part.columns))


def groups_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, its rows) of rows sorted by their first n_keys columns."""
    return groupby(rows_of(batches), key=itemgetter(*range(n_keys)) if n_keys > 1 else lambda r: (r[0],))
