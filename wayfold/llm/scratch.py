"""Intermediate tables of this subpackage, and the size of the batches that go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wayfold.sources.scratch import new_folder, shared_root
from wayfold.sources.scratch import stored as saved

__all__ = ["bounded_batches", "new_folder", "saved", "shared_root"]

#: Rows and bytes of an Arrow batch, at most: whole texts make rows large, and a task holds some batches at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to those above; lower ones stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    now = spark.conf.get(size).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)
