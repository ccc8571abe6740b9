"""Arrays of numbers summed over all documents, in blocks, by Spark.

Every task adds up an array of fixed size over its documents. The arrays are cut into
blocks, and each block is summed over the tasks in two steps, so no task receives the
arrays of more than a share of the others. What reaches the driver is one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS, SALTS = 64, 16
_ROW = "block int, salt int, total binary"


def _row(block: list[int], salt: list[int], total: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(salt, pa.int32()), pa.array(total, pa.binary())], ["block", "salt", "total"]
    )


def summed(docs: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of the array of ``size`` float64 numbers that ``per_task``
    makes of a task's batches."""
    padded = -(-size // BLOCKS) * BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        array = np.zeros(padded)
        array[:size] = per_task(batches)
        salt = TaskContext.get().partitionId() % SALTS
        yield _row(list(range(BLOCKS)), [salt] * BLOCKS, [p.tobytes() for p in np.split(array, BLOCKS)])

    def add(table: pa.Table) -> pa.Table:
        # In one order, so that a repeated task gives the very same sum.
        parts = np.sort(np.stack([np.frombuffer(x, np.float64) for x in table["total"].to_pylist()]), axis=0)
        return pa.Table.from_batches([_row([table["block"][0].as_py()], [0], [parts.sum(axis=0).tobytes()])])

    rows = docs.mapInArrow(run, _ROW).groupBy("block", "salt").applyInArrow(add, _ROW)
    rows = rows.groupBy("block").applyInArrow(add, _ROW).orderBy(F.col("block")).collect()
    out = np.zeros((BLOCKS, padded // BLOCKS))
    for row in rows:
        out[row["block"]] = np.frombuffer(row["total"], np.float64)
    return out.ravel()[:size]
