"""Index rows and the queries that meet them, brought together in blocks of bounded size.

Both sides are one table: `_part` and `_block` name a block, `_role` 0 marks index rows, larger
roles mark queries.  Sorted by these, each task first reads the index rows of a block, then
streams the queries past them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEYS = ["_part", "_block", "_role"]


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS[:2]).sortWithinPartitions(*KEYS)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Consecutive rows with equal keys; a run over several batches comes in several parts."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy() for k in keys]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for i, j in pairwise([0, *cuts.tolist(), batch.num_rows]):
                yield tuple(int(c[i]) for c in columns), batch.slice(i, j - i)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.Table, pa.RecordBatch]]:
    """(block, role, its index rows, some queries of that role); blocks without index rows or queries are passed over."""
    block, index, table = None, [], None
    for (part, number, role), rows in runs_of(batches, KEYS):
        if (part, number) != block:
            block, index, table = (part, number), [], None
        if role == 0:
            index.append(rows)
        elif index:
            table = pa.Table.from_batches(index) if table is None else table
            yield block, role, table, rows
