"""Topics as clusters of texts: their terms by class-TF-IDF, their typical texts, and any text's share of each topic."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.sources.shared import saved

__all__ = ["term_counts", "topic_features", "topic_shares", "topic_terms", "typical_texts"]


#: Counts that a task gives out at once; bounds memory only.
COUNTS_AT_ONCE = 100_000


def term_counts(texts: DataFrame, id_col: str, text_col: str, pattern: str = "[a-z]{3,}") -> DataFrame:
    """(id, term, n): how often a text has each term, in lower case; null texts and texts without one give no row.

    Terms are counted where the texts lie, and nothing moves. Rows that repeat
    an id have counts of their own.
    """
    schema = T.StructType([texts.schema[id_col], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            rows, terms, counts = [], [], []
            for k, text in enumerate(batch.column(1)):
                found = Counter(find(text.as_py() or ""))
                rows += [k] * len(found)
                terms += found.keys()
                counts += found.values()
                if len(rows) > COUNTS_AT_ONCE or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=[id_col, "term", "n"])
                    rows, terms, counts = [], [], []

    return texts.select(id_col, F.lower(text_col).alias("_text")).mapInArrow(count, schema)


def topic_terms(counts: DataFrame, topics: DataFrame, id_col: str) -> DataFrame:
    """(topic, term, weight) of texts whose ``topics`` (id, topic) are known.

    A term weighs its share of the topic's words, times log(1 + A / f): f is how
    often all topics have it, A how many words a topic has on average. Topics
    that are null or -1 are none. Sums are partial before anything moves; a term
    has one row for each topic.
    """
    placed = counts.join(topics.where("topic is not null and topic <> -1"), id_col)
    by_topic = saved(placed.groupBy("topic", "term").agg(F.sum("n").alias("n")), "topic-terms")
    words = by_topic.groupBy("topic").agg(F.sum("n").alias("words"))
    every = by_topic.groupBy("term").agg(F.sum("n").alias("f"))
    mean = words.agg(F.avg("words").alias("A"))  # one row
    joined = by_topic.join(every, "term").join(words, "topic").crossJoin(F.broadcast(mean))
    return joined.select("topic", "term", (F.col("n") / F.col("words") * F.log(1 + F.col("A") / F.col("f"))).alias("weight"))


#: Terms with more than one in so many of all counts are frequent; there are no more of them than that.
FREQUENT = 16_384


def _scores(counts: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """(id, topic, score): the mean weight that a text's words have in a topic, for topics that share a term with it.

    Weights of frequent terms, a bounded number of rows for each topic, go to where the texts' counts
    lie, which are then summed up before anything moves; only counts of the
    other terms are sent.
    """
    sizes = counts.groupBy(id_col).agg(F.sum("n").alias("words"))
    often = saved(counts.groupBy("term").agg(F.count("*").alias("k")), "term-rows")
    total = often.agg(F.sum("k").alias("total"))  # one row
    frequent = saved(often.crossJoin(F.broadcast(total)).where(F.col("k") * FREQUENT > F.col("total")).select("term"), "frequent-terms")
    near = counts.join(F.broadcast(terms.join(F.broadcast(frequent), "term", "left_semi")), "term")
    far = counts.join(F.broadcast(frequent), "term", "left_anti").join(terms, "term")
    # summed up apart, so that each text's counts of frequent terms are one row for each topic before they move
    parts = [met.groupBy(id_col, "topic").agg(F.sum(F.col("n") * F.col("weight")).alias("s")) for met in (near, far)]
    met = parts[0].unionAll(parts[1]).groupBy(id_col, "topic").agg(F.sum("s").alias("s"))
    return met.join(sizes, id_col).select(id_col, "topic", (F.col("s") / F.col("words")).alias("score"))


def topic_shares(counts: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """(id, topic, share) of any texts, seen or unseen: their scores, summed up to 1 over topics. A text without a known term gives no row."""
    own = Window.partitionBy(id_col)
    return _scores(counts, terms, id_col).select(id_col, "topic", (F.col("score") / F.sum("score").over(own)).alias("share"))


def typical_texts(counts: DataFrame, topics: DataFrame, terms: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(topic, id, place): the members of each topic whose words weigh most in it, ties by id; counts to nine digits."""
    own = _scores(counts, terms, id_col).join(topics, [id_col, "topic"])
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), id_col))
    return own.withColumn("place", place).where(F.col("place") <= most).select("topic", id_col, "place")


def topic_features(shares: DataFrame, texts: DataFrame, names: list, id_col: str, components: int | None = None) -> DataFrame:
    """(id, topic, topic_probas, one_hot, reduced) for every text: its best topic (-1 if none), its shares in order of ``names``, that topic alone, and the shares' principal components.

    Without ``components`` there is no reduction and no such column. ``names``
    are the topics, a row of numbers for each text.
    """
    held = shares.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("topic", "share"))).alias("m"), F.max_by("topic", F.struct(F.round("share", 9), -F.col("topic"))).alias("best"))
    wide = texts.select(id_col).join(held, id_col, "left")
    probas = F.array(*(F.coalesce(F.get(F.array(F.try_element_at("m", F.lit(n))), F.lit(0)), F.lit(0.0)) for n in names))
    one = F.array(*(F.when(F.col("best") == n, 1.0).otherwise(0.0) for n in names))
    found = wide.select(id_col, F.coalesce("best", F.lit(-1)).alias("topic"), probas.alias("topic_probas"), one.alias("one_hot"))
    if components is None:
        return found
    vectors = saved(found, "topic-features").withColumn("_v", array_to_vector("topic_probas"))
    return PCA(k=components, inputCol="_v", outputCol="_r").fit(vectors).transform(vectors).withColumn("reduced", vector_to_array("_r")).drop("_v", "_r")
