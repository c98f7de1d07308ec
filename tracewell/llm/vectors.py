"""Vectors as Arrow batches of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are multiplied by this and floored; the results must lie below LARGEST, so that squared distances stay in 64 bits.
SCALE, LARGEST = 1024, 1 << 26


def scaled_vectors(table: DataFrame, *others: str) -> DataFrame:
    """(vec_id, *others, x array<long>) of the rows whose vector is neither null nor empty and holds no null or non-finite component; x is floor(1024 * component).

    All vectors must have one length: where they don't, the commonest takes part (ties: the shorter). A component of 65,536 or more stops the job with a message.
    """
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda c: F.when(F.abs(c) * SCALE < LARGEST, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("a component is beyond 65,536"))))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = table.where(v.isNotNull() & (F.size(v) > 0) & finite)
    common = kept.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return kept.where(F.size(v) == (common["size"] if common else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), *others, whole.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """The rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A list column of the rows."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))
