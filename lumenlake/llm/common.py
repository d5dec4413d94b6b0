"""Shared steps of the text operators: words, byte access in Arrow batches, lineage cuts."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.session import drop_table, ship_package, write_table

# Words are maximal runs of anything but the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; executors get this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of words of a text (none for null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that later steps read as they are.

    Spark copies a projection's expressions into filters and lambdas above it, where a
    split text would be split again for each word. It never does so across a generator,
    here one that makes one row of each row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each row of a binary Arrow column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[start:end]


def stored(df: DataFrame, scratch: list[str]) -> DataFrame:
    """`df` written to the shared checkpoint folder and read again; its path joins `scratch`.

    Afterwards the driver lets go of plans that ended, so that Spark's cleaner can
    delete their shuffle files before the next step fills the disks.
    """
    table, path = write_table(df)
    scratch.append(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables of `stored` that no later plan reads."""
    while scratch:
        drop_table(spark, scratch.pop())
