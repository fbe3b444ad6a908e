"""Staged tables, and the sizes of the batches that Python tasks get."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ruleloom.pinning import counted, drop, shared_folder, staged

__all__ = ["batch_rows", "counted", "drop", "shared_folder", "small_batches", "staged"]

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows from now on, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get(_ROWS)) > rows:
        spark.conf.set(_ROWS, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside: many for rows of a few numbers."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
