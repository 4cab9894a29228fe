"""Models on MLlib, and plug-in embedders and scorers that run inside tasks."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, StringIndexer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.sources.shared import saved

__all__ = ["Embedder", "HashingEmbedder", "Scorer", "answered", "classification_metrics", "embed", "fit_voters", "margin_probabilities", "score_texts", "soft_vote", "topics"]


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""


class Scorer(Protocol):
    """Labels texts: (label, confidence, motivation) for each."""

    def classify(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """One result for each text."""


class HashingEmbedder:
    """Unit vectors of hashed words; needs no model. Blank texts count as the word ``empty``."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split() or ["empty"]:
                h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
                out[k, h % self.dimension] += 1.0 if h >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def embed(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, a batch at a time; null texts are blank ones."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        vectors = embedder.encode([t or "" for t in texts.to_pylist()])
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * embedder.dimension
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    return run(text)


def score_texts(rows: DataFrame, id_col: str, text_col: str, scorer: Scorer, batch: int = 32, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """(id, label, confidence, motivation) by a scorer that is sent to the tasks.

    A batch that fails is halved until the texts that fail are alone; such a
    text is tried ``retries`` times more, with ``wait`` seconds before the first
    of these and twice as many before each next, and is then ``altro`` at .1. So
    a text's failure costs no other text its answer.
    """
    schema = T.StructType([rows.schema[id_col], T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("motivation", T.StringType())])

    def attempt(texts: list[str]) -> list[tuple[str, float, str]]:
        try:
            found = scorer.classify(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} texts")
            return found
        except Exception as error:  # whatever a plug-in raises
            if len(texts) > 1:
                half = len(texts) // 2
                return attempt(texts[:half]) + attempt(texts[half:])
            for k in range(retries):
                time.sleep(wait * 2**k)
                try:
                    return [scorer.classify(texts)[0]]
                except Exception as again:  # the last one is told
                    error = again
            return [("altro", 0.1, f"error: {error}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                some = b.slice(k, batch)
                labels, confidences, motivations = zip(*attempt([t or "" for t in some.column(text_col).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(id_col), pa.array(labels, pa.string()), pa.array(confidences, pa.float64()), pa.array(motivations, pa.string())], names=[id_col, "label", "confidence", "motivation"])

    return rows.select(id_col, text_col).mapInArrow(run, schema)


def answered(rows: DataFrame, key: Column, text_col: str, answers: str, scorer: Scorer) -> DataFrame:
    """``rows`` with label, confidence and motivation from the table of answers at ``answers``, which the texts not yet in it are scored for first.

    ``key`` is what makes two questions the same. Answers are appended as they
    are, so a run that ends early, or another one, goes on where it stopped;
    errors aren't kept, so those texts are asked again. Equal keys are asked once.
    """
    spark, keyed = rows.sparkSession, rows.withColumn("_key", key)
    schema = "_key string, label string, confidence double, motivation string"
    path = spark._jvm.org.apache.hadoop.fs.Path(answers)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(schema).parquet(answers) if there else spark.createDataFrame([], schema)
    open_ = saved(keyed.join(known.select("_key"), "_key", "left_anti").groupBy("_key").agg(F.first(text_col).alias("_text")), "questions")
    found = saved(score_texts(open_, "_key", "_text", scorer), "answers")
    found.where("motivation is null or not startswith(motivation, 'error: ')").write.mode("append").parquet(answers)
    every = known.unionByName(found).dropDuplicates(["_key"])
    return keyed.join(every, "_key", "left").drop("_key")


def fit_voters(examples: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1024, seed: int = 42, margins: bool = False, folds: int = 3) -> PipelineModel:
    """A random forest and a logistic regression on hashed words, and with ``margins`` a linear support vector machine; asks for two classes and five rows at least.

    The machine has one boundary for each class against the rest. A row's
    margins become probabilities by a logistic curve that is fitted on margins
    of rows that the boundary hadn't seen: ``folds`` boundaries more, each
    without a part of the rows (for a class of fewer than ten rows the boundary's
    own). They sum up to 1 over classes.
    """
    if examples.select(label_col).distinct().count() < 2 or examples.limit(5).count() < 5:
        raise ValueError("training needs two classes and five rows")
    two = Pipeline(
        stages=[
            Tokenizer(inputCol=text_col, outputCol="_words"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            StringIndexer(inputCol=label_col, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"),
            RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=20, seed=seed, probabilityCol="_p1", rawPredictionCol="_r1", predictionCol="_q1"),
            LogisticRegression(featuresCol="_features", labelCol="_y", regParam=0.01, probabilityCol="_p2", rawPredictionCol="_r2", predictionCol="_q2"),
        ]
    ).fit(examples)
    return PipelineModel(two.stages + _margin_stages(two, examples, text_col, folds)) if margins else two


def _margin_stages(two: PipelineModel, examples: DataFrame, text_col: str, folds: int) -> list:
    """For each class a boundary and the curve from its margins to probabilities (columns ``_s0``, ``_s1``, ...)."""
    seen = PipelineModel(two.stages[:4]).transform(examples)
    rows = saved(seen.select("_features", "_y", F.pmod(F.xxhash64(text_col), F.lit(folds)).alias("_fold")), "examples")
    counts = {int(r["_y"]): r["count"] for r in rows.groupBy("_y").count().collect()}
    stages = []
    for k in range(len(two.stages[3].labels)):
        own = rows.withColumn("_own", (F.col("_y") == k).cast("double"))
        machine = LinearSVC(featuresCol="_features", labelCol="_own", maxIter=20, regParam=0.01, rawPredictionCol=f"_m{k}", predictionCol=f"_n{k}")
        boundary = machine.fit(own)
        if min(counts.get(k, 0), sum(counts.values()) - counts.get(k, 0)) < 10:
            margins = boundary.transform(own)
        else:
            parts = [machine.fit(own.where(F.col("_fold") != f)).transform(own.where(F.col("_fold") == f)) for f in range(folds)]
            margins = reduce(DataFrame.unionAll, parts)
        curve = LogisticRegression(featuresCol=f"_m{k}", labelCol="_own", probabilityCol=f"_s{k}", rawPredictionCol=f"_t{k}", predictionCol=f"_u{k}").fit(margins.select(f"_m{k}", "_own"))
        stages += [boundary, curve]
    return stages


def soft_vote(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the label with the highest mean probability of the voters, and that probability."""
    names = model.stages[3].labels
    out = model.transform(rows)
    voters = [F.slice(vector_to_array(p), 1, len(names)) for p in ("_p1", "_p2")]
    if len(model.stages) > 6:
        voters.append(margin_probabilities(len(names)))
    p = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), voters)
    best = F.array_max(F.transform(p, lambda x, k: F.struct((x / len(voters)).alias("p"), (-k).alias("k"))))
    return out.select(*keep, best.alias("_b")).select(*keep, F.get(F.array(*map(F.lit, names)), -F.col("_b.k")).alias("label"), F.col("_b.p").alias("confidence"))


def margin_probabilities(classes: int) -> Column:
    """The third voter's probabilities, summed up to 1 over classes."""
    each = F.array(*(F.get(vector_to_array(f"_s{k}"), F.lit(1)) for k in range(classes)))
    return F.get(F.transform(F.array(each), lambda ps: F.transform(ps, lambda p: p / F.aggregate(ps, F.lit(0.0), lambda a, x: a + x))), F.lit(0))


def topics(rows: DataFrame, text_col: str = "text", k: int = 5, vocabulary: int = 2000, seed: int = 42) -> PipelineModel:
    """A topic model: word counts and latent Dirichlet allocation."""
    return Pipeline(stages=[Tokenizer(inputCol=text_col, outputCol="_words"), CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocabulary, minDF=2), LDA(featuresCol="_counts", k=k, maxIter=5, seed=seed, topicDistributionCol="topic_probabilities")]).fit(rows)


def classification_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighed by the classes' frequency; 0 where a class is never guessed."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    by_truth = counts.groupBy("t").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = counts.groupBy("g").agg(F.sum("n").alias("guessed"))
    j = by_truth.join(by_guess, F.col("t") == F.col("g"), "left")
    p = F.coalesce(F.col("hit") / F.col("guessed"), F.lit(0.0))
    r = F.col("hit") / F.col("support")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    weighed = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return j.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), weighed(p).alias("precision"), weighed(r).alias("recall"), weighed(f1).alias("f1"))
