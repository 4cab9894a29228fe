"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive examples; texts drawn from all, whatever
is known of them, are the unlabelled ones: most are clean, some are not. Linear
classifiers over words and beginnings of words are trained with numpy to lower
the class-prior-corrected risk

    prior * R(positive as toxic) + max(0, R(unlabelled as clean) - prior * R(positive as clean)),

whose second part is kept from going below zero. Their mean is calibrated by the
same risk, so that the scores of unlabelled texts sum up to the prior. Labels of
clean texts are used for the prior only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, saved, small_batches

__all__ = ["Classifier", "features_of", "nn_pu_risk_gradient", "score", "train", "train_linear"]

_WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the sample that the classifier is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 16_000
#: Features the classifier may use, and the fewest positive texts that one has to stand in.
MOST_FEATURES, LEAST_TEXTS = 4_096, 4
#: Standard errors by which a feature has to be more frequent in positive texts.
CLEAR = 4.0
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = range(4, 8)
#: Characters looked at in one go; bounds memory only.
CHARS_AT_ONCE = 1_000_000


def words_of(text: str) -> Counter[str]:
    """How often each word stands in a text, in lower case; long texts are read in parts, cut at white space where there is any."""
    if len(text) <= CHARS_AT_ONCE:
        return Counter(_WORD.findall(text.lower()))
    found, at = Counter(), 0
    while at < len(text):
        end = at + CHARS_AT_ONCE
        while end < len(text) and not text[end].isspace() and end < at + 2 * CHARS_AT_ONCE:
            end += 1
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


def features_of(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings with a ``^`` before them."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def number(name: str) -> int:
    """A feature as a number, to count it by."""
    return xxhash.xxh64_intdigest(name) - (1 << 63)


def values_of(words: dict[str, int], places: dict[str, int]) -> tuple[list[int], list[float]]:
    """Columns and values of a text's row: for each feature that the model knows whether it is there, and how frequent it is."""
    counts: dict[int, int] = {}
    total = 0
    for word, n in words.items():
        total += n
        for f in features_of(word):
            k = places.get(f)
            if k is not None:
                counts[k] = counts.get(k, 0) + n
    at = sorted(counts)
    return [*(2 * k for k in at), *(2 * k + 1 for k in at)], [*(0.5 for _ in at), *(float(np.log1p(100 * counts[k] / (total + 20))) for k in at)]


@dataclass
class Classifier:
    """Features and their weights (of being there, and of frequency): the mean of several linear classifiers, and its calibration."""

    features: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, margin: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for margins (bias and weights summed up)."""
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def nn_pu_risk_gradient(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk under logistic loss, and the gradient to follow, for each row's margin.

    While the unlabelled part of the risk is below zero, the gradient leads it
    back up, as the method prescribes.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    as_toxic, as_clean = np.logaddexp(0, -margin), np.logaddexp(0, margin)
    d_toxic, d_clean = -1 / (1 + np.exp(margin)), 1 / (1 + np.exp(-margin))
    risk_p = prior * as_toxic[positive].sum() / n_p
    risk_n = as_clean[~positive].sum() / n_u - prior * as_clean[positive].sum() / n_p
    part_n = np.where(positive, -prior * d_clean / n_p, d_clean / n_u)
    if risk_n < 0:
        return float(risk_p), -part_n
    return float(risk_p + risk_n), np.where(positive, prior * d_toxic / n_p, 0.0) + part_n


@dataclass
class Rows:
    """Sparse rows: where each begins, its columns and values."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray
    width: int

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows the entries: which row, column and value."""
        sizes = self.start[rows + 1] - self.start[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(int(sizes.sum())) + np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes)
        return owner, self.at[place], self.value[place]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        each = np.append(0.0, np.cumsum(self.value * w[self.at]))
        return each[self.start[1:]] - each[self.start[:-1]]


def train_linear(rows: Rows, positive: np.ndarray, prior: float, seed: int, epochs: int = 40, batch: int = 1024, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier, by Adam over shuffled batches that mix both kinds of rows."""
    random = np.random.default_rng(seed)
    n = len(positive)
    w, b = np.zeros(rows.width), 0.0
    m, v, step = np.zeros(rows.width + 1), np.zeros(rows.width + 1), 0
    for _ in range(epochs):
        for some in np.array_split(random.permutation(n), max(1, n // batch)):
            owner, at, value = rows.part(some)
            _, d = nn_pu_risk_gradient(np.bincount(owner, value * w[at], len(some)) + b, positive[some], prior)
            g = np.append(np.bincount(at, value * d[owner], rows.width) + decay * w, d.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _calibrate(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that lower the positive-unlabelled risk of a logistic curve over margins, by Newton's method.

    Under logistic loss that risk is convex: -prior * mean(curve's argument of
    positives) + mean(log(1 + exp(that of unlabelled))). At its least the scores
    of the unlabelled rows have the prior as their mean.
    """
    if not len(margin) or positive.all() or not positive.any():
        return 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    of_positive, unlabelled = prior * x[positive].mean(axis=0), x[~positive]
    t = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(unlabelled @ t, -30, 30)))
        g = (p[:, None] * unlabelled).mean(axis=0) - of_positive + 1e-4 * (t - [1.0, 0.0])
        h = (unlabelled * (p * (1 - p))[:, None]).T @ unlabelled / len(unlabelled) + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t - step * min(1.0, 1 / (np.abs(step).max() + 1e-12))
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def _first(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    """``n`` rows that a hash of the id picks, the same in every run."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), id_col), id_col).limit(n)


def _with_words(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, and the different words of each text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                found = [sorted(words_of(t.as_py() or "").items()) for t in some.column(text_col)]
                words, counts = pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), words, counts], names=[*keep, "words", "counts"])
            batch = some = None
            give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))]))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, p, u): in how many positive and unlabelled rows each feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                lists = some.column("words")
                coded = lists.flatten().dictionary_encode()
                of_word = [[number(f) for f in features_of(w)] for w in coded.dictionary.to_pylist()]
                size = np.array([len(f) for f in of_word], np.int64)
                flat = np.fromiter((f for fs in of_word for f in fs), np.int64, int(size.sum()))
                features, code = np.unique(flat, return_inverse=True)
                # (text, feature), each once
                word = coded.indices.to_numpy()
                text = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), size[word])
                start = (np.cumsum(size) - size)[word]
                place = np.arange(len(text)) + np.repeat(start - (np.cumsum(size[word]) - size[word]), size[word])
                pairs = np.unique(text * max(1, len(features)) + code[place])
                which, positive = pairs % max(1, len(features)), np.array(some.column("positive").to_pylist(), bool)[pairs // max(1, len(features))]
                yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(np.bincount(which[positive], minlength=len(features))), pa.array(np.bincount(which[~positive], minlength=len(features)))], names=["feature", "p", "u"])
            batch = some = lists = coded = None
            give_back()

    return rows.select("positive", "words").mapInArrow(run, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _names(rows: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """(feature, name) of the chosen features, as found in the words of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(n, f) for w in batch.column("word").to_pylist() for f in features_of(w) if (n := number(f)) in chosen}
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([f for _, f in found], pa.string())], names=["feature", "name"])

    return rows.where("positive").select(F.explode("words").alias("word")).distinct().mapInArrow(run, "feature long, name string").distinct()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, classifiers: int = 3) -> Classifier:
    """A classifier from ``docs`` and the labels of some of them.

    Positive are up to ``most_positive`` documents with label 1; unlabelled are
    up to ``most_unlabelled`` of all documents, picked by a hash of the id
    without regard to labels. The class prior is the share of label 1 among the
    labels; nothing else is learnt from label 0. Without positive documents all
    texts score as the prior says. Null labels and ids are left out; a document
    with several labels is toxic if one is 1. Features are those that are
    clearly more frequent in the positive texts of the sample.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    counts = docs.select(F.col(id_col).alias("_id")).join(known, "_id").groupBy("_label").count().collect()
    n = {r["_label"]: r["count"] for r in counts}
    prior = min(0.9, max(0.001, n.get(1, 0) / max(1, sum(n.values()))))
    # ids are drawn before any text is moved
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null")
    positive, unlabelled = _first(ids.join(known.where("_label = 1"), "_id", "left_semi"), most_positive, "_id"), _first(ids, most_unlabelled, "_id")
    drawn = saved(positive.select("_id", F.lit(True).alias("positive")).unionAll(unlabelled.select("_id", F.lit(False).alias("positive"))).distinct(), "pu-ids")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(drawn, "_id").repartition("_id")  # the bounded sample, dealt over all tasks
    rows = saved(_with_words(texts, "_text", ["_id", "positive"]), "pu-sample")

    sizes = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    n_p, n_u = sizes["p"], sizes["u"]
    if not n_p:
        return Classifier([], np.zeros(0), float(np.log(prior / (1 - prior))))
    share = (F.col("p") + F.col("u")) / float(n_p + n_u)
    clear = (F.col("p") / float(n_p) - F.col("u") / float(max(1, n_u))) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / max(1, n_u)) + 1e-12)
    found = _feature_counts(rows).where(F.col("p") >= LEAST_TEXTS).withColumn("clear", clear).where(F.col("clear") >= CLEAR)
    chosen = {r["feature"]: k for k, r in enumerate(found.orderBy(F.desc("clear"), "feature").limit(MOST_FEATURES).collect())}
    named = {r["name"]: chosen[r["feature"]] for r in _names(rows, chosen).collect()}
    features = sorted(named, key=lambda f: (named[f], f))
    places = {f: k for k, f in enumerate(features)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [values_of(dict(zip(w, c, strict=True)), places) for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("positive"), pa.array([a for a, _ in some], pa.list_(pa.int32())), pa.array([v for _, v in some], pa.list_(pa.float64()))], names=["_id", "positive", "at", "value"])

    schema = T.StructType([rows.schema["_id"], rows.schema["positive"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))])
    sample = rows.mapInArrow(project, schema).toArrow().sort_by([("_id", "ascending"), ("positive", "ascending")]).combine_chunks()
    at = sample["at"].combine_chunks()
    matrix = Rows(np.append(0, np.cumsum(at.value_lengths().to_numpy())), at.flatten().to_numpy(), sample["value"].combine_chunks().flatten().to_numpy(), 2 * len(features))
    is_positive = sample["positive"].to_numpy().astype(bool)
    trained = [train_linear(matrix, is_positive, prior, seed) for seed in range(classifiers)]
    weights, bias = np.mean([w for w, _ in trained], axis=0), float(np.mean([b for _, b in trained]))
    slope, shift = _calibrate(matrix @ weights + bias, is_positive, prior)
    del sample, at, matrix
    give_back()  # else the driver keeps the sample's memory
    return Classifier(features, weights, bias, slope, shift)


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", output: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the probability that a text is toxic in ``output``.

    Null and empty texts score as a text without any known word. Equal texts
    have equal scores, so repeated rows do; an empty table stays empty. A column
    named ``output`` is replaced, other columns are kept, whatever their names.
    """
    places, weights, bias = {f: k for k, f in enumerate(classifier.features)}, classifier.weights, classifier.bias

    @F.arrow_udf(T.DoubleType())
    def toxicity(texts: pa.Array) -> pa.Array:
        give_back()
        margins = []
        for t in texts:
            at, values = values_of(words_of(t.as_py() or ""), places)
            margins.append(bias + sum(v * weights[k] for k, v in zip(at, values, strict=True)))
        return pa.array(classifier.score(np.array(margins, float)))

    columns = [c for c in (docs.columns if keep is None else keep) if c != output]
    small_batches(docs.sparkSession)
    # so marked that the planner keeps one call where the score is used more than once
    return docs.select(*columns, toxicity.asNondeterministic()(F.col(text_col)).alias(output))
