"""Shared plumbing of the training-data operators: tables in the shared folder, text access, code shipping."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.shipping import ship_code
from tracklake.sources.tables import read_table as read_table
from tracklake.sources.tables import shared_dir as shared_dir

#: What a Python worker keeps between tasks, by operator: functions that empty it.
_HELD: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Freed memory to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the table: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tracklake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def claim(owner: str, empty: Callable[[], None] | None = None) -> None:
    """Called in a worker by an operator: what other operators have kept there goes, so that only one set of caches is held."""
    others = [k for k in _HELD if k != owner]
    for k in others:
        _HELD.pop(k)()
    if others:
        gc.collect()
        _give_back()
    if empty is not None:
        _HELD[owner] = empty


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mapped(df: DataFrame, fn, schema, owner: str = "") -> DataFrame:
    """mapInArrow with the package shipped first; the worker is claimed for `owner`, and gives freed memory back after each task."""
    ship_code(df.sparkSession)

    def run(batches):
        claim(owner)
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
