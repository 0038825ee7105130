"""Helpers that several operators use: tables, lineage cuts, columns with free names."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut, remove, shared_folder

__all__ = ["ascii_lower", "cut", "free_name", "lean", "new_folder", "remove", "shared_folder", "slices", "table"]

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, CAPITALS, SMALL)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name = f"_{name}"
    return f"__{name}"


Batches = Iterator[pa.RecordBatch]


def slices(batches: Batches, column: int, size: int = 2 << 20) -> Batches:
    """Parts of batches with about ``size`` bytes of text each, or one row, so that what is made of a part stays small
    however many rows a batch has."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield b.slice(at, to - at)
            at = to


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function, after whose last batch the worker gives unused memory back: workers live on and serve other tasks."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return whole
