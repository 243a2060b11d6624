"""Intermediate tables of this subpackage, under the names it uses for them."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..store import cut


def saved(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, see cut()."""
    return cut(df, name, most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run):
    """A function for mapInArrow, after which its worker gives back what memory it no longer uses: workers outlive their
    tasks, and two stages' worth of them would otherwise hold the most that either needed."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Give memory that this process no longer uses back to the system; the driver does so when a model is fitted."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's library
    if trim:
        trim(0)
