"""Upserts by bucket: equal to the join, and other buckets' files stay."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionloom.sources import buckets as B
from sessionloom.sources.merge import upsert

SCHEMA = "k long, t string, x double, s string"


def files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = spark.createDataFrame([(k if k % 10 else None, f"t{k % 3}", float(k), "old" if k % 2 else None) for k in range(200)], SCHEMA).dropDuplicates(["k", "t"])
    batch = spark.createDataFrame([(5, "t2", None, "new"), (7, "t1", 1.5, "new"), (1000, "t0", 2.5, None), (None, "t0", 9.0, None)], SCHEMA)
    B.create_buckets(base, path, ["k", "t"], 32)
    assert rows_of(B.read_buckets(spark, path, SCHEMA)) == rows_of(base)
    before = files(tmp_path)
    touched = B.upsert_buckets(batch, path, SCHEMA, ["k", "t"], 32, keep=("s",))
    assert 0 < len(touched) <= 4
    after = files(tmp_path)
    # nothing that was there is rewritten, and what is new lies in the touched buckets
    assert before.items() <= after.items()
    assert {int(p.split("_bucket=")[1].split("/")[0]) for p in set(after) - set(before)} == set(touched)
    want = rows_of(upsert(base, batch, ["k", "t"], keep=("s",)))
    assert rows_of(B.read_buckets(spark, path, SCHEMA)) == want
    assert rows_of(B.read_buckets(spark, path, SCHEMA, version=0)) == rows_of(base)
    assert B.upsert_buckets(batch.limit(0), path, SCHEMA, ["k", "t"], 32) == []


def test_a_change_that_fails_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = spark.createDataFrame([(k, "t", float(k), "a") for k in range(20)], SCHEMA)
    B.create_buckets(base, path, ["k"], 4)
    failing = base.withColumn("s", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException, match="lost"):
        B.upsert_buckets(failing, path, SCHEMA, ["k"], 4)
    assert rows_of(B.read_buckets(spark, path, SCHEMA)) == rows_of(base)
    os.makedirs(tmp_path / "t/manifest/v1")  # a manifest that isn't complete
    assert rows_of(B.read_buckets(spark, path, SCHEMA)) == rows_of(base)
