"""Density clustering on a graph of nearest neighbours.

A point's core distance is that of its ``min_samples``-th neighbour. Points
whose core distance is within the cut are linked if their mutual reachability
is, however many nearer points they have; the components of the links are the clusters, and a
point outside that is near enough to a core point joins its cluster. This is a
flat cut of the density hierarchy: the hierarchy itself would have to be read
in one place, which doesn't hold for large tenants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.graph import connected_components
from sessionloom.operators.vectors import _matrix, block_pairs, nearest, products
from sessionloom.sources.shared import saved

__all__ = ["density_clusters", "recluster_outliers"]


def _links_within(rows: DataFrame, cut: float, by: str | None) -> DataFrame:
    """Links (u, v) that join rows (id, v) of one group exactly as all pairs within ``cut`` do.

    Each pair of blocks is one product of matrices, of whose links only a
    spanning forest leaves it.
    """
    group = F.col(by) if by else F.lit(0)
    of = rows.select(group.alias("g"), F.col("id").alias("i"), "v")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (qi, qv), (mi, mv) = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
                near = np.concatenate([np.sqrt(np.maximum(0.0, 2 - 2 * s)) <= cut for _, s in products(qv, mv)])
                left, fresh, u, v = np.ones(len(qi), bool), np.ones(len(mi), bool), [], []
                for seed in range(len(qi)):
                    # every row and column is reached once, and linked to where its component began
                    ends = np.array([seed]) if left[seed] else np.zeros(0, np.int64)
                    left[ends] = False
                    while len(ends):
                        reached = np.flatnonzero(near[ends].any(axis=0) & fresh)
                        fresh[reached] = False
                        ends = np.flatnonzero(near[:, reached].any(axis=1) & left)
                        left[ends] = False
                        for found in (mi[reached], qi[ends]):
                            u.append(np.full(len(found), qi[seed]))
                            v.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (u, v)], names=["u", "v"])

    return block_pairs(of, of).mapInArrow(join, "u long, v long").where("u != v")


def _bucketed(rows: DataFrame, by: str | None, tables: int, planes: int, seed: int = 7) -> DataFrame:
    """Rows (id, v, _bucket), one for each table: the bucket says on which side of each of a table's random planes the vector is."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sides(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        normal = np.random.default_rng(seed).normal(size=(x.shape[1], tables * planes))
        bits = (x @ normal > 0).reshape(len(x), tables, planes)
        found = (bits * (1 << np.arange(planes))).sum(axis=2).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(found.ravel()))

    table = rows.select("id", "v", *([by] if by else []), F.posexplode(sides(F.col("v"))).alias("_t", "_side"))
    return table.select("id", "v", F.xxhash64(*([by] if by else []), "_t", "_side").alias("_bucket"))


def density_clusters(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int = 3, cut: float | None = None, quantile: float = 0.8, neighbours: int = 10, by: str | None = None, tables: int = 0, bucket: int = 1000) -> DataFrame:
    """(id, cluster, core, probability) for rows (id, v): cluster is the smallest id of its core points, or -1.

    With ``tables`` 0 all pairs are compared, which is exact and quadratic. For
    many rows ask for some tables: then rows are compared that fall on the same
    side of all of a table's random planes, of which there are so many that a
    bucket has about ``bucket`` rows, so the work grows with the rows. Against
    all pairs 16 tables find over nine tenths of the links (see the tests).

    Distances are Euclidean between unit vectors. Without ``cut`` it is the
    ``quantile`` of the core distances. With ``by`` groups are clustered apart.
    Zero vectors are at distance 1.41 from all others. Components under
    ``min_cluster_size`` are outliers. An empty table gives an empty result.
    """
    rows = vectors.select("id", "v", *([by] if by else []))
    asked = rows.withColumnRenamed("id", "query_id")
    k = max(min_samples, neighbours) + 1
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    within_of, key = rows, by
    if tables:
        planes = max(1, round(np.log2(max(2.0, rows.count() / bucket))))
        within_of, key = saved(_bucketed(rows, by, tables, planes), "buckets"), "_bucket"
        asked = within_of.withColumnRenamed("id", "query_id")
    # a neighbour can be met once in each table
    met = nearest(asked, within_of, k * max(1, tables), key).where("query_id != id")
    found = met.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")) if tables else met
    near = saved(found.select("query_id", "id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("d"), F.row_number().over(order).alias("place")), "neighbours")
    cores = saved(near.where(F.col("place") == min_samples).select(F.col("query_id").alias("i"), F.col("d").alias("core")), "cores")
    if cut is None:
        # off by one part in 100,000 of the ranks at most
        cut = cores.agg(F.percentile_approx("core", F.lit(quantile), F.lit(100_000))).first()[0]
    dense = cores.where(F.col("core") <= (cut if cut is not None else 0.0)).select("i")
    within = near.where(F.col("d") <= (cut or 0.0))
    links = within.join(dense.withColumnRenamed("i", "query_id"), "query_id", "left_semi").join(dense.withColumnRenamed("i", "id"), "id", "left_semi")
    all_links = links.select(F.col("query_id").alias("u"), F.col("id").alias("v")).unionAll(_links_within(within_of.join(dense.withColumnRenamed("i", "id"), "id", "left_semi"), cut or 0.0, key))
    members = saved(connected_components(all_links), "members")
    border = within.join(dense.withColumnRenamed("i", "query_id"), "query_id", "left_anti").join(members.withColumnRenamed("node", "id"), "id").groupBy(F.col("query_id").alias("node")).agg(F.min_by("component", F.struct("d", "id")).alias("component"))
    every = members.unionAll(border)
    large = every.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster_size).select("component")
    kept = every.join(large, "component", "left_semi")
    joined = rows.select("id").join(kept.withColumnRenamed("node", "id"), "id", "left").join(cores.withColumnRenamed("i", "id"), "id", "left")
    strength = F.when(F.col("component").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("core") / F.lit(2.0 * (cut or 1.0)))).otherwise(0.0)
    return joined.select("id", F.coalesce("component", F.lit(-1)).alias("cluster"), "core", strength.alias("probability"))


def recluster_outliers(clusters: DataFrame, history: DataFrame, vectors: DataFrame, most_old: int = 20, least: int = 5, min_cluster_size: int = 3, min_samples: int = 2, quantile: float = 0.9) -> DataFrame:
    """(id, cluster) of this run's outliers and of up to ``most_old`` of earlier runs, clustered again with looser parameters.

    ``clusters`` is this run's result (id, cluster), ``history`` has the outliers
    of earlier runs (id; those with the greatest ids count as the latest),
    ``vectors`` has (id, v) of both. With fewer than ``least`` in all, and where
    a row stays alone, the cluster is -1. New clusters are numbered from the
    greatest of this run's on, by their smallest member.
    """
    new = clusters.where("cluster = -1").select("id")
    old = history.select("id").join(new, "id", "left_anti").distinct().orderBy(F.desc("id")).limit(most_old)
    ids = saved(new.unionByName(old), "outliers")
    if ids.count() < least:
        return ids.select("id", F.lit(-1).cast("long").alias("cluster"))
    again = saved(density_clusters(vectors.join(ids, "id", "left_semi"), min_cluster_size, min_samples, quantile=quantile).select("id", "cluster"), "reclustered")
    top = clusters.agg(F.greatest(F.coalesce(F.max("cluster"), F.lit(-1)), F.lit(-1)).alias("top"))
    # few new clusters: a row for each
    names = again.where("cluster != -1").select("cluster").distinct().withColumn("nth", F.row_number().over(Window.orderBy("cluster"))).crossJoin(top)
    named = again.join(names, "cluster", "left")
    return named.select("id", F.coalesce(F.col("top") + F.col("nth"), F.lit(-1)).cast("long").alias("cluster"))
