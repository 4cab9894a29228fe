"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.shared import discard, fresh_path, saved, shared_dir

__all__ = ["discard", "free", "fresh_path", "give_back", "likely_in", "load", "saved", "shared_dir", "small_batches"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return memory that Arrow and Python no longer use to the system; workers outlive tasks, and several share a machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes after which an Arrow batch of texts goes to Python; bounds memory only.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on no batch that the session sends to Python holds more than ``BATCH_BYTES`` and one row.

    Spark's own bounds (10,000 rows, 64 MB) let each task hold some hundred MB of
    texts outside the heap, as a batch's buffers double while they grow, and
    Python as much again. A lower setting stays. It has to hold when the plan
    runs, so it isn't taken back.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Most bits of the filter that ``likely_in`` makes: 1 MB.
MOST_BITS = 1 << 23


def likely_in(keys: DataFrame, key: str, column: Column) -> Column:
    """A filter that holds for every value of ``keys[key]`` and for few others.

    It is a bitmap of hashes, of at most ``MOST_BITS`` bits, so it may be sent
    to all tasks. With more keys than that it lets more through; an exact
    semi-join has to follow in any case. It spares that join the rows that
    certainly have no partner. Null keys are never in.
    """
    count = keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, count)).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bytes_of = keys.where(F.col(key).isNotNull()).select(at(F.col(key)).alias("at"))
    set_bytes = bytes_of.groupBy(F.floor(F.col("at") / 8).cast("int").alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("bits"))
    # bytes and their places, as columns: 5 MB at most reach the driver
    found = set_bytes.toArrow()
    bitmap = np.zeros(bits // 8, np.uint8)
    bitmap[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    # a table of one row, not a literal, which would stand in hexadecimal in each description of a plan that the driver makes and keeps
    table = keys.sparkSession.createDataFrame([(bitmap.tobytes(),)], "bitmap binary").coalesce(1)
    del found, bitmap
    give_back()
    byte = F.conv(F.hex(F.substr(table.scalar(), F.floor(at(column) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return column.isNotNull() & (F.getbit(byte, (at(column) % 8).cast("int")) == 1)
