"""Helpers shared by the text operators: tables, shared folders and batch plumbing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.storage import new_path, shared_dir, written  # noqa: F401

#: Bytes of text that one inner step of a Python task works on at a time.
SLICE_BYTES = 4 << 20
#: Bytes of text after which a task gives freed memory back.
GIVEN_BACK = 8 << 20
#: A key with one in HOT of all rows is hot, so there are at most so many; its rows are dealt over SALTS.
HOT, SALTS = 1000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor (null id: null)."""
    return F.crc32(doc_id.cast("string")) % divisor


def joined_to_one(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join of many with one (unique by key). hot: at most HOT keys, marked and sent to all tasks;
    their rows in many are dealt over SALTS by spread, and their row in one is copied as often."""
    marks = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    salted = many.join(marks, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = one.join(marks, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def give_back() -> None:
    """Return freed memory to the machine: workers live on through many stages beside a grown heap."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column with about limit bytes each.

    After each column, and after so many bytes inside one, what was freed is given back.
    """
    n, start = len(column), 0
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = done = 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            yield start, i
            done += total
            if done >= GIVEN_BACK:
                give_back()
                done = 0
            start, total = i, 0
        total += int(sizes[i])
    yield start, n
    give_back()


def as_bytes(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, null as empty."""
    return pa.compute.fill_null(column.cast(pa.binary()), b"")
