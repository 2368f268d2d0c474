"""Arrow batches of a checked size, so that a Python worker's memory does not follow the length of the rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, and of the texts that are handled at once; a longer row is a batch of its own.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 1 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of BATCH_BYTES at the most from now on."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub("[^0-9]", "", spark.conf.get(size))) <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)
    return spark


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of batches with texts of about SLICE_BYTES in a column, and at most so many rows; at least one row each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            until = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)) + 1, at + rows)
            yield batch.slice(at, until - at)
            at = until
