"""The corpus pipeline: from raw documents to token ids of a deduplicated mix.

Stages, in order: toxic documents go; lines that stand on many sites stay once;
of near-duplicates one document stays; sources are mixed to target weights; the
mix is encoded. Each stage gets all that the stage before it kept, as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.bpe import encode
from sessionloom.llm.common import free, likely_in, load, saved
from sessionloom.llm.line_dedup import dedup_lines
from sessionloom.llm.mixing import mix
from sessionloom.llm.queries import MIN_SITES, MIX, TOXIC_FROM, tokenizer_path
from sessionloom.llm.simhash import near_duplicates
from sessionloom.llm.toxicity import score, train

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, as learnt from the labels, is under the threshold; null and empty texts are scored as any other, repeated rows alike; an empty table stays empty."""
    classifier = train(docs, load(spark, sf_dir, "labels"))
    toxicity = free(docs, "_toxicity")
    return score(docs, classifier, output=toxicity).where(F.col(toxicity) < TOXIC_FROM).select(*docs.columns)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on several sites, but for each line's first occurrence.

    A document of which nothing is left goes; one that had no text before stays.
    Rows that repeat an id lose the same lines; an empty table stays empty.
    """
    found = dedup_lines(docs, MIN_SITES)
    left = found.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))
    chars = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*docs.columns) if "n_chars" in docs.columns else left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a similarity (Dice's, of five-word shingles) of .8 or more the document with the smallest id.

    SimHash fingerprints meet by the trie walk, and texts that it links are compared.

    Rows that repeat an id count as one document; rows without an id stay.
    Null and empty texts are equal texts, so one of them stays. An empty table
    stays empty. Only texts of documents that may have to go are moved.
    """
    found = saved(near_duplicates(docs.select("doc_id", "text")), "near-duplicates")
    key = free(docs, "_id")
    gone = saved(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct(), "gone")
    repeated = saved(found.groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "repeated")
    may_go = likely_in(gone.unionAll(repeated), key, F.col("doc_id"))
    some = docs.where(may_go).join(gone, F.col("doc_id") == F.col(key), "left_anti")
    return docs.where(~may_go).unionAll(some if repeated.isEmpty() else some.dropDuplicates(["doc_id"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it.

    Null and empty texts have size 0; they fill no target, and the mix takes
    none of them or some, as the draw falls. A null source is a source.
    Repeated rows are drawn singly. An empty table stays empty.
    """
    row, nth = free(docs, "_row"), free(docs, "_copy")
    found = mix(docs.withColumn(row, F.struct(*docs.columns)), **MIX, keep=[row]).where("copies > 0")
    return found.select(row, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(nth)).select(f"{row}.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to; a null or empty text has none and decodes to an empty one.

    Every row gives a row, repeated ones too; an empty table stays empty.
    """
    path = tokenizer_path()
    found = encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Learning, near-duplicates and sampling can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each stage's result written to the shared folder for the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
