"""Operators on vectors: centroids, nearest neighbours, similarity to labels, novelty, silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.numbers import euclidean

__all__ = ["block_pairs", "centroid_distances", "centroids", "label_similarity", "nearest", "nearest_of", "percentiles", "products", "soft_memberships"]


def centroids(vectors: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, centroid): the mean of each group's vectors, summed up position by position."""
    parts = vectors.select(key, F.posexplode(v).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg("_x").alias("_x"))
    # a centroid has as many positions as a vector
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_p")).select(key, F.col("_p._x").alias("centroid"))


def centroid_distances(vectors: DataFrame, key: str, v: str = "v") -> DataFrame:
    """``vectors`` with their group's ``centroid`` and their ``distance`` from it."""
    return vectors.join(centroids(vectors, key, v), key).withColumn("distance", euclidean(F.col(v), F.col("centroid")))


def nearest(queries: DataFrame, memory: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query_id, id, similarity[, group], place): the ``k`` vectors of the memory nearest to each query by cosine, ties by id.

    ``queries`` has (query_id, v), ``memory`` (id, v); with ``by`` both have
    that column, and only vectors of the query's group count. Every query is
    held against every vector: both sides are packed into blocks, each pair of
    blocks is one product of matrices that keeps the ``k`` best of each query,
    and the blocks' bests are ranked in the end. So what moves grows with
    queries times blocks, not with pairs.
    """
    group = F.col(by) if by else F.lit(0)
    met = block_pairs(queries.select(group.alias("g"), F.col("query_id").alias("i"), "v"), memory.select(group.alias("g"), F.col("id").alias("i"), "v"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from nearest_of(*(_matrix(batch.column(c)[row]) for c in ("q", "m")), k)

    pairs = met.mapInArrow(multiply, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_of(queries: tuple[np.ndarray, np.ndarray], memory: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, similarity): the ``k`` nearest of a block (ids, vectors) of the memory to each of a block of queries."""
    (qi, qv), (mi, mv) = queries, memory
    top = min(k, len(mi))
    # by similarity, ties by id: ids ascend within a block
    order = np.argsort(mi, kind="stable")
    mi, mv = mi[order], mv[order]
    for some, s in products(qv, mv):
        best = _best(s, top)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi[some], top)), pa.array(mi[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query_id", "id", "similarity"])


#: Most vectors in a block, and the fewest blocks that more than a handful of vectors are dealt into.
BLOCK, FEWEST_BLOCKS = 2048, 8
#: Most values of a product of blocks that a task holds at once; bounds memory only.
CELLS = 1 << 18


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows (g, i, v) packed into blocks of up to about BLOCK vectors of one group, with the block's number ``b``."""
    dealt = rows.join(_numbers(rows), "g").withColumn("b", F.pmod(F.xxhash64("i"), F.col("n")).cast("long"))
    return dealt.groupBy("g", "b").agg(F.collect_list(F.struct("i", "v")).alias(name))


def _numbers(rows: DataFrame) -> DataFrame:
    """(g, n): how many blocks each group is dealt into."""
    n = F.count("*")
    return rows.groupBy("g").agg(F.greatest(F.least(F.lit(FEWEST_BLOCKS), F.ceil(n / 64)), F.ceil(n / BLOCK)).alias("n"))


def block_pairs(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """(g, q, m): each block of the queries with each block of the memory of its group; both sides have (g, i, v).

    A block of queries is sent to every block of the memory, by group and number,
    so that the pairs of one group are dealt over all tasks.
    """
    q = _blocks(queries, "q").drop("b").join(_numbers(memory), "g").select("g", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("b"))
    return q.join(_blocks(memory, "m"), ["g", "b"]).select("g", "q", "m")


def percentiles(rows: DataFrame, key: str, value: str, share: float, output: str, slack: float = 0.005) -> DataFrame:
    """(key, output): the exact percentile of a value in each group, interpolated between its neighbours.

    Two passes: sketches give bounds a little below and above it, and only the
    values within, counted, are put in order. So no group is held in one buffer.
    Nulls don't count.
    """
    some = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"))
    bounds = some.groupBy("k").agg(F.percentile_approx("x", F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack))), 2000).alias("b"), F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    # one value more on either side, as a percentile lies between two
    near = some.join(bounds, "k")
    outer = near.groupBy("k").agg(F.coalesce(F.max(F.when(F.col("x") < F.col("b")[0], F.col("x"))), F.min("low")).alias("from"), F.coalesce(F.min(F.when(F.col("x") > F.col("b")[1], F.col("x"))), F.max("high")).alias("to"), F.first("n").alias("n"))
    placed = some.join(outer, "k")
    below = placed.groupBy("k").agg(F.count_if(F.col("x") < F.col("from")).alias("below"))
    counted = placed.where(F.col("x").between(F.col("from"), F.col("to"))).groupBy("k", "x").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("x"))
    ranked = counted.withColumn("upto", upto).join(below, "k").withColumn("upto", F.col("upto") + F.col("below"))
    at = F.lit(share) * (F.col("n") - 1)
    first = F.min(F.when(F.col("upto") > F.floor(at), F.col("x")))
    second = F.min(F.when(F.col("upto") > F.ceil(at), F.col("x")))
    found = ranked.groupBy("k").agg(first.alias("a"), second.alias("z"), F.first(at - F.floor(at)).alias("f"))
    return found.select(F.col("k").alias(key), (F.col("a") + (F.col("z") - F.col("a")) * F.col("f")).alias(output))


def _matrix(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = block.values
    vectors = rows.field("v")
    return rows.field("i").to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def products(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Cosines of the rows of two blocks, some rows of the first at a time: (which rows, their cosines), of about CELLS values each."""
    unit, step = _unit(y).T, max(1, CELLS // max(1, len(y)))
    for k in range(0, len(x), step):
        some = slice(k, k + step)
        yield some, _unit(x[some]) @ unit


#: Columns whose greatest value stands for them where a row's best are looked for, and the decimals to which values count.
SPAN, DECIMALS = 64, 12


def _best(s: np.ndarray, top: int) -> np.ndarray:
    """The places of each row's ``top`` greatest values (to DECIMALS), in order; of equal ones the first."""
    spans = s.shape[1] // SPAN
    # as many spans reach their ``top``-th greatest maximum, so no better value is below it
    some = s[:, : spans * SPAN].reshape(len(s), SPAN, spans).max(axis=1) if spans >= top else s
    least = np.partition(some, some.shape[1] - top, axis=1)[:, some.shape[1] - top, None]
    row, at = np.nonzero(s >= least - 2 * 10.0**-DECIMALS)
    value = np.round(s[row, at], DECIMALS)
    order = np.lexsort((at, -value, row))
    # of those that are over the least one or equal to it as many as there is room for
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row]
    return at[order][place < top].reshape(len(s), top)


def label_similarity(queries: DataFrame, memory: DataFrame, per_label: int = 50) -> DataFrame:
    """(query_id, label, score): .6 of the best, .3 of the mean and .1 of the median cosine with a label's vectors.

    ``queries`` has (query_id, v) and is a stated set; ``memory`` has (id,
    label, v). A label is remembered by its ``per_label`` newest vectors (by
    id), so one row holds them; queries come in blocks, and a block meets each
    label in one product of matrices.
    """
    newest = Window.partitionBy("label").orderBy(F.desc("id"))
    held = memory.select("id", "label", "v").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= per_label)
    labels = held.groupBy("label").agg(F.collect_list(F.struct(F.col("id").alias("i"), "v")).alias("m"))
    # labels are dealt into parts, and a block of queries is sent to each part
    parts = labels.agg(F.greatest(F.lit(FEWEST_BLOCKS), F.ceil(F.count("*") / 64)).alias("n"))
    dealt = labels.crossJoin(parts).select("label", "m", F.pmod(F.xxhash64("label"), F.col("n")).cast("long").alias("b"))  # parts is one row
    q = _blocks(queries.select(F.lit(0).alias("g"), F.col("query_id").alias("i"), "v"), "q").select("q").crossJoin(parts).select("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("b"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (qi, qv), (_, mv) = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
                s = _unit(qv) @ _unit(mv).T
                score = 0.6 * s.max(axis=1) + 0.3 * s.mean(axis=1) + 0.1 * np.median(s, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array([batch.column("label")[row].as_py()] * len(qi), batch.column("label").type), pa.array(score)], names=["query_id", "label", "score"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), memory.schema["label"], T.StructField("score", T.DoubleType())])
    return q.join(dealt, "b").select("q", "label", "m").mapInArrow(multiply, schema)


def soft_memberships(rows: DataFrame, regions: DataFrame, boundary: float, floor: float = 0.1) -> DataFrame:
    """(id, region, membership) of rows (id, v) in those regions (region, centroid, radius) to which their affinity is over ``boundary``.

    Affinity falls with the distance in diameters, to ``floor`` at least;
    memberships of a row sum up to 1. Regions are numbered by a long. Rows and
    regions meet in blocks; only what is over the boundary leaves them.
    """
    shapes = regions.select(F.lit(0).alias("g"), F.col("region").cast("long").alias("i"), F.concat("centroid", F.array("radius")).alias("v"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (qi, qv), (mi, mv) = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
                # some rows at a time, as differences are exact where products of matrices aren't
                for k in range(0, len(qi), 64):
                    far = np.sqrt(((qv[k : k + 64, None, :] - mv[None, :, :-1]) ** 2).sum(axis=2))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        near = np.maximum(floor, np.nan_to_num(1 - far / (2 * mv[:, -1][None, :]), nan=1.0, neginf=floor))
                    x, y = np.nonzero(np.round(near, 9) > boundary)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[k + x]), pa.array(mi[y]), pa.array(near[x, y])], names=["id", "region", "a"])

    found = block_pairs(rows.select(F.lit(0).alias("g"), F.col("id").alias("i"), "v"), shapes).mapInArrow(meet, "id long, region long, a double")
    return found.select("id", "region", (F.col("a") / F.sum("a").over(Window.partitionBy("id"))).alias("membership"))
