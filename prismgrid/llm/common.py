"""Helpers shared by the operators for training data: stored intermediate tables and bounded slices of Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Text bytes that a task looks at together; bounds the arrays a worker holds, not what it reads.
SLICE_BYTES = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read again.

    Cuts the lineage like ``checkpoint()``, but computes the rows once and keeps them columnar.  The
    files survive lost executors; they are removed with the application's checkpoint folder.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_REMEMBERED: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]):
    """What this Python worker keeps from task to task under ``name``.

    Workers outlive operators, so keeping something lets go of what an earlier operator kept.
    """
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def let_go() -> None:
    """Called first by maps that keep nothing: this worker drops what an earlier operator kept in it."""
    if _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and the offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
