"""What goes to Python at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bpe, simhash, toxicity
from sessionloom.llm.common import BATCH_BYTES, likely_in
from sessionloom.llm.queries import tokenizer_path

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
CLASSIFIER = toxicity.Classifier([], [], 0.0, 1.0, 0.0)
STEPS = {
    "encode": lambda docs: bpe.encode(docs, tokenizer_path()),
    "near_duplicates": lambda docs: simhash.near_duplicates(docs.limit(0)),
    "components_of": lambda docs: simhash.components_of(docs.limit(0)),
    "score": lambda docs: toxicity.score(docs, CLASSIFIER),
}


@pytest.fixture
def conf(spark):
    before = spark.conf.get(CONF)
    yield spark.conf
    spark.conf.set(CONF, before)


@pytest.mark.parametrize("step", STEPS)
def test_texts_go_to_python_in_small_batches(spark, conf, step):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"))
    conf.set(CONF, "64m")
    STEPS[step](docs)
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 8000 and len(found) > 3
    assert max(r["bytes"] for r in found) <= BATCH_BYTES + 10_000


def test_a_lower_bound_stays(spark, conf):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    conf.set(CONF, "1m")
    bpe.encode(docs, tokenizer_path())
    assert conf.get(CONF) == "1m"


def test_the_filter_of_keys_is_not_part_of_the_plan(spark):
    """Spark keeps descriptions of plans in the driver, again for each step of adaptive execution."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"))
    keys = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("_id"))
    may = likely_in(keys, "_id", F.col("doc_id"))
    found = docs.where(may).withColumn("may", F.lit(1)).unionAll(docs.where(~may).withColumn("may", F.lit(0)))
    assert len(found._jdf.queryExecution().toString()) < 50_000
    counts = {(r["may"], r["third"]): r["count"] for r in found.groupBy("may", (F.col("doc_id") % 3 == 0).alias("third")).count().collect()}
    assert counts[1, True] == 66_667 and (0, True) not in counts and counts[1, False] < 0.2 * counts[0, False]
    assert sum(counts.values()) == 200_000
    none = likely_in(keys.limit(0), "_id", F.col("doc_id"))
    assert docs.where(none).isEmpty()
