"""Tables in buckets by key, of which an upsert reads and writes only those that the batch names.

A table is a folder: ``data`` has a folder for each write, in it one for each
bucket; ``manifest`` has a folder for each version, with one row for each bucket
and the folder that holds it. A version counts once its manifest is complete, so
readers see all of a change or nothing, and what a change doesn't touch stays
the same file.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.merge import upsert

__all__ = ["create_buckets", "read_buckets", "upsert_buckets"]


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifests are complete, in order."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [str(s.getPath()) for s in fs.listStatus(at)]
    found = [(int(m[1]), p) for p in names if (m := re.search(r"/v(\d+)$", p))]
    return sorted(v for v, p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Bucket -> folder; as many rows as the table has buckets."""
    rows = spark.read.schema("bucket int, folder string").json(f"{path}/manifest/v{version}").collect()
    return {r["bucket"]: r["folder"] for r in rows}


def _publish(spark: SparkSession, path: str, version: int, held: dict[int, str]) -> None:
    """Write a manifest; two writers of one version can't both succeed, as the folder may not exist before."""
    spark.createDataFrame(sorted(held.items()), "bucket int, folder string").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/v{version}")


def _write(rows: DataFrame, path: str, keys: list[str], n: int) -> str:
    """The rows in a new folder, one part of it for each bucket; buckets are dealt over tasks, and large ones over several files."""
    folder = f"w-{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(keys, n)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
    return folder


def create_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Write ``rows`` as a table in so many buckets by ``keys``."""
    spark = rows.sparkSession
    held = _write(rows, path, keys, buckets)
    there = rows.select(_bucket(keys, buckets).alias("b")).distinct().collect()
    _publish(spark, path, 0, {r["b"]: f"{held}/_bucket={r['b']}" for r in there})


def read_buckets(spark: SparkSession, path: str, schema, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The table as of a version (the latest, if none is named), or some buckets of it."""
    held = _manifest(spark, path, _versions(spark, path)[-1] if version is None else version)
    folders = sorted(f"{path}/data/{folder}" for b, folder in held.items() if only is None or b in only)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_buckets(batch: DataFrame, path: str, schema, keys: list[str], buckets: int = 64, **how) -> list[int]:
    """Merge ``batch`` into the table as ``sources.merge.upsert`` does, and return the buckets that were read and written anew.

    ``buckets`` is the number the table was made with; all others keep their
    files. An empty batch changes nothing. A change that fails leaves the table
    as it was. The keys of the batch have to be unique; more keyword arguments
    go to ``upsert``.
    """
    spark = batch.sparkSession
    touched = {r["b"] for r in batch.select(_bucket(keys, buckets).alias("b")).distinct().collect()}
    if not touched:
        return []
    version = _versions(spark, path)[-1]
    held = _manifest(spark, path, version)
    merged = upsert(read_buckets(spark, path, schema, version, touched), batch, keys, **how)
    folder = _write(merged, path, keys, buckets)
    # a bucket that is touched has rows: those of the batch at least
    _publish(spark, path, version + 1, held | {b: f"{folder}/_bucket={b}" for b in touched})
    return sorted(touched)
