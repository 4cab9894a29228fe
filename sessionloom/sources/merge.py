"""Upserts and other changes of tables, as joins: the new table is a function of the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["delete_where", "insert_if_absent", "replace_table", "upsert"]


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], only: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the rows of ``batch`` merged in by ``keys``; the columns stay those of ``base``.

    A batch value replaces the old one unless it is null; columns in ``keep``
    hold on to an old value that isn't null. Rows without a partner are
    inserted. With ``only``, a condition on the columns of ``base``, matched
    rows that don't fulfil it stay as they are. The keys of the batch have to
    be unique; null keys match each other.
    """
    others = [c for c in base.columns if c not in keys and c in batch.columns]
    b = base.withColumn("_old", F.lit(True)).alias("b")
    n = batch.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_n_{c}") for c in others), F.lit(True).alias("_new")).alias("n")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"n._k{i}")) for i, k in enumerate(keys)]
    joined = b.join(n, on, "full")
    old = F.col("_old").isNotNull()
    changes = F.lit(True) if only is None else (~old | F.coalesce(only, F.lit(False)))

    def column(c: str) -> Column:
        if c in keys:
            return F.when(old, F.col(f"b.{c}")).otherwise(F.col(f"n._k{keys.index(c)}")).alias(c)
        if c not in others:
            return F.col(f"b.{c}").alias(c)
        first, second = (f"b.{c}", f"n._n_{c}") if c in keep else (f"n._n_{c}", f"b.{c}")
        return F.when(changes, F.coalesce(first, second)).otherwise(F.col(f"b.{c}")).alias(c)

    return joined.select(*map(column, base.columns))


def insert_if_absent(base: DataFrame, batch: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    """``base`` and those rows of ``batch`` whose keys (expressions over both) are not there yet, one for each key; the first by ``names``."""
    marks = [f"_k{i}" for i in range(len(keys))]
    known = base.select(*(k.alias(m) for k, m in zip(keys, marks, strict=True))).distinct()
    new = batch.select("*", *(k.alias(m) for k, m in zip(keys, marks, strict=True))).join(known, marks, "left_anti")
    first = new.groupBy(*marks).agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    return base.unionByName(first.select(*base.columns))


def delete_where(base: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row with the number that goes."""
    gone = F.coalesce(condition, F.lit(False))
    return base.where(~gone), base.agg(F.count_if(gone).alias("n_deleted"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` over the Parquet table it may have been read from: first beside it, then in its place.

    The renames are done by the path's own file system, so they work wherever Spark writes.
    """
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
