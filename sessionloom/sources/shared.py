"""The folder that all executors share, and intermediate tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["discard", "fresh_path", "release", "saved", "shared_dir"]

#: Tables and folders written by this process, which ``release`` removes.
_written: list[str] = []
#: While it is true, Spark removes a query's shuffle files when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``, or the folder already set on
    the context. Where neither is set a temporary one is made if the master is
    local; on a cluster that would be one machine's own, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sessionloom-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at yet; ``release`` removes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/sessionloom-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage where lost executors can't take the data with them,
    and gives the planner the true size, so that it broadcasts the table only
    if it is below ``spark.sql.autoBroadcastJoinThreshold``. Shuffle files of the
    write go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` has written and that nothing reads any more, so that rounds don't add up on disk."""
    for table in tables:
        folders = {file.rpartition("/")[0].rpartition("/")[2] for file in table.inputFiles()}
        for path in [p for p in _written if p.rpartition("/")[2] in folders]:
            _written.remove(path)
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Remove the tables that ``saved`` has written in this process, once results that read them are written; returns how many."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n
