"""Sums of numpy arrays over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Tasks that add up what all others have.
FAN = 16


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of arrays of numbers of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(total: np.ndarray | None, part: int) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])


def summed(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> np.ndarray | None:
    """The sum of ``make()(batch)`` over all batches of ``rows``, arrays of doubles of one length: by
    task, then by a few tasks, then by the driver. None if there are no rows."""

    def partial(batches):
        of, total = make(), None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        yield from _rows(total, TaskContext.get().partitionId())

    def merged(batches):
        total = None
        for batch in batches:
            for data in batch.column(1).to_pylist():
                more = np.frombuffer(data, np.float64)
                total = more if total is None else total + more
        yield from _rows(total, 0)

    parts = rows.mapInArrow(partial, "part int, data binary").repartition(FAN, "part").mapInArrow(merged, "part int, data binary")
    total = None
    for row in parts.collect():
        more = np.frombuffer(row["data"], np.float64)
        total = more.copy() if total is None else total + more
    return total
