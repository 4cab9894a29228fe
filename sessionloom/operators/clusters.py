"""What follows clustering: review budgets, representatives, consensus labels and their propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["consensus", "disjoint_pairs", "diverse_representatives", "linkage_groups", "merge_candidates", "n_representatives", "propagate", "refine_regions", "review_budget", "silhouettes", "tuned"]


def n_representatives(size: Column) -> Column:
    """How many representatives a cluster of some size gets: all up to 3, then 3, 4 and 5."""
    return F.when(size <= 3, size).when(size <= 10, 3).when(size <= 50, 4).otherwise(5)


def review_budget(clusters: DataFrame, budget: int, order: list[Column] | None = None) -> DataFrame:
    """``slots`` of each cluster: its number of representatives as far as the budget goes, largest clusters first.

    There is one row for each cluster. Only those within the budget's reach
    are ordered in one place: no cluster gets a slot beyond the ``budget``
    first ones, as each of these takes one at least.
    """
    order = order or [F.desc("size"), F.asc("cluster_id")]
    base = n_representatives(F.col("size")).cast("long")
    reach = clusters.orderBy(*order).limit(budget).withColumn("base", base)
    before = F.coalesce(F.sum("base").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = reach.select("cluster_id", F.greatest(F.lit(0), F.least("base", F.lit(budget) - before)).alias("slots"))
    return clusters.join(given, "cluster_id", "left").withColumn("slots", F.coalesce("slots", F.lit(0)).cast("long"))


def consensus(votes: DataFrame) -> DataFrame:
    """(cluster_id, label, confidence, agreement) from representatives' votes (cluster_id, rep_id, label, confidence).

    A label of at least .6 of the votes wins with the mean confidence of its
    votes and a bonus of up to .1; else the surest vote wins at .8 of its
    confidence. What is below .5 is given .3 at least. Ties go to the label
    that comes first; votes without a label don't count.
    """
    cast = votes.where(F.col("label").isNotNull())
    by_label = cast.groupBy("cluster_id", "label").agg(F.count("*").alias("k"), F.avg("confidence").alias("mean"))
    totals = by_label.groupBy("cluster_id").agg(F.sum("k").alias("n"), F.min_by(F.struct("label", "k", "mean"), F.struct(-F.col("k"), "label")).alias("top"))
    surest = cast.groupBy("cluster_id").agg(F.min_by(F.struct("label", "confidence"), F.struct(-F.col("confidence"), "label")).alias("best"))
    joined = totals.join(surest, "cluster_id")
    ratio = F.col("top.k") / F.col("n")
    majority = ratio >= 0.6
    raw = F.when(majority, F.least(F.lit(1.0), F.col("top.mean") + F.least(F.lit(0.1), (ratio - 0.6) * 0.25))).otherwise(F.col("best.confidence") * 0.8)
    floor = F.when(raw < 0.5, F.greatest(F.lit(0.3), raw)).otherwise(raw)
    return joined.select("cluster_id", F.when(majority, F.col("top.label")).otherwise(F.col("best.label")).alias("label"), floor.alias("confidence"), ratio.alias("agreement"))


def diverse_representatives(vectors: DataFrame, cluster: str, id_col: str = "id", v: str = "v", most: int = 5) -> DataFrame:
    """(cluster, id, rank) of each cluster's representatives: the member nearest to the centre, then the one farthest from all chosen, and so on.

    How many depends on the cluster's size. Every round is one aggregation by
    cluster over all members, so clusters of any size are spread out. Ties go
    to the smallest id.
    """
    from sessionloom.functions.numbers import euclidean
    from sessionloom.operators.vectors import centroid_distances
    from sessionloom.sources.shared import saved

    members = centroid_distances(vectors.select(F.col(cluster).alias("c"), F.col(id_col).alias("i"), F.col(v).alias("v")), "c")
    sizes = members.groupBy("c").agg(F.count("*").alias("size")).withColumn("wanted", n_representatives(F.col("size")))
    key = F.struct(F.round("distance", 9).alias("d"), F.col("i"))
    chosen = saved(members.groupBy("c").agg(F.min_by(F.struct("i", "v"), key).alias("r")).select("c", F.lit(1).alias("rank"), "r.i", "r.v"), "representatives")
    wanted, rows = saved(sizes, "wanted"), saved(members.select("c", "i", "v"), "members")
    out = chosen
    for rank in range(2, most + 1):
        # all chosen so far, of which a cluster has at most ``most``, as one row beside its members
        picked = out.groupBy("c").agg(F.collect_list("v").alias("_vs"), F.collect_list("i").alias("_is")).join(wanted.where(F.col("wanted") >= rank).select("c"), "c", "left_semi")
        near = F.array_min(F.transform("_vs", lambda x: euclidean(F.col("v"), x)))
        far = rows.join(picked, "c").where(~F.array_contains("_is", F.col("i"))).select("c", "i", "v", near.alias("near"))
        chosen = saved(far.groupBy("c").agg(F.max_by(F.struct("i", "v"), F.struct(F.round("near", 9), -F.col("i"))).alias("r")).select("c", F.lit(rank).alias("rank"), "r.i", "r.v"), "representatives")
        out = out.unionAll(chosen)
    return out.select(F.col("c").alias(cluster), F.col("i").alias(id_col), "rank")


def silhouettes(vectors: DataFrame, cluster: str, v: str = "v", id_col: str = "vec_id", by: str | None = None) -> DataFrame:
    """``vectors`` with each member's ``silhouette`` under squared distances; clusters named -1 are left out.

    With ``by`` (whole numbers) each value has clusters of its own, and an id counts once in each.

    The mean squared distance to a cluster follows from its size, its centre
    and the mean of its members' squared lengths, so no pairs of members are
    made. Members and clusters meet in blocks, each a product of matrices, of
    which the two least distances of a member leave it. Ids are distinct.
    """
    from sessionloom.functions.numbers import dot
    from sessionloom.operators.vectors import _matrix, block_pairs, centroids

    rows = vectors.where(F.col(cluster) != -1).withColumn("_g", F.col(by).cast("long") if by else F.lit(0).cast("long"))
    keyed = rows.withColumn("_key", F.struct("_g", cluster))
    shape = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.avg(dot(F.col(v), F.col(v))).alias("_q")).join(centroids(keyed, "_key", v), "_key")
    shape = shape.select(F.col("_key._g").alias("_g"), F.col(f"_key.{cluster}").alias(cluster), "_n", "_q", "centroid")
    # a cluster as a vector: twice its centre, and the mean squared length of its members
    shapes = shape.select(F.col("_g").alias("g"), F.col(cluster).cast("long").alias("i"), F.concat(F.transform("centroid", lambda x: 2 * x), F.array("_q")).alias("v"))
    asked = rows.select(F.col("_g").alias("g"), F.col(id_col).cast("long").alias("i"), F.concat(F.col(v), F.array(F.col(cluster).cast("double"))).alias("v"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (qi, qv), (mi, mv) = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
                own = qv[:, -1].astype(np.int64)[:, None] == mi[None, :]
                far = (qv[:, :-1] ** 2).sum(axis=1)[:, None] + mv[:, -1][None, :] - qv[:, :-1] @ mv[:, :-1].T
                inside = np.where(own, far, np.inf).min(axis=1)
                outside = np.where(own, np.inf, far).min(axis=1)
                group = np.full(len(qi), batch.column("g")[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(qi), pa.array(inside), pa.array(outside)], names=["_m", "_id", "_a", "_b"])

    met = block_pairs(asked, shapes).mapInArrow(meet, "_m long, _id long, _a double, _b double").groupBy("_m", "_id").agg(F.greatest(F.lit(0.0), F.min("_a")).alias("_a"), F.greatest(F.lit(0.0), F.min("_b")).alias("_b"))
    own = shape.select(F.col("_g").alias("_s"), F.col(cluster).alias("_c"), "_n")
    joined = rows.drop(v).join(met, (F.col(id_col) == F.col("_id")) & (F.col("_g") == F.col("_m"))).join(own, (F.col(cluster) == F.col("_c")) & (F.col("_g") == F.col("_s")))
    own = F.col("_a") * F.col("_n") / (F.col("_n") - 1)
    s = F.when((F.col("_n") < 2) | (F.col("_b") == float("inf")), 0.0).otherwise((F.col("_b") - own) / F.greatest("_b", own))
    return joined.select(*(c for c in vectors.columns if c != v), s.alias("silhouette"))


def merge_candidates(regions: DataFrame, least_cosine: float = 0.85, least_ratio: float = 0.3, least_share: float = 0.7) -> DataFrame:
    """(a, b, cosine) of regions that may be merged, from (region, label, share, size, centre): one row for each region.

    Both have the same dominant label with a share over ``least_share``, sizes
    whose ratio is over ``least_ratio``, and centres at ``least_cosine`` or more.
    """
    from sessionloom.functions.numbers import cosine

    r = regions.where(F.col("share") > least_share)
    a, b = (r.select("label", F.col("region").alias(x), F.col("size").alias(f"_n{x}"), F.col("centre").alias(f"_v{x}")) for x in "ab")
    met = a.join(b, "label").where("a < b").where(F.least("_na", "_nb") / F.greatest("_na", "_nb") > least_ratio)
    return met.select("a", "b", cosine(F.col("_va"), F.col("_vb")).alias("cosine")).where(F.round("cosine", 9) >= least_cosine)


def disjoint_pairs(candidates: DataFrame) -> DataFrame:
    """(a, b, cosine): of candidate pairs the best first, so that no region stands in two, ties to the smaller regions.

    In each round the pairs that are best for both their regions are taken, and
    all others of these regions go, which gives what taking one by one would.
    """
    from sessionloom.sources.shared import saved

    left, out = saved(candidates, "merge-candidates"), None
    while not left.isEmpty():
        best = F.min(F.struct((-F.round("cosine", 9)).alias("s"), "a", "b")).alias("best")
        ends = left.select(F.explode(F.array("a", "b")).alias("region"), "a", "b", "cosine").groupBy("region").agg(best)
        mutual = ends.groupBy("best.a", "best.b").count().where("count = 2").select("a", "b")
        taken = saved(left.join(mutual, ["a", "b"], "left_semi"), "merge-pairs")
        out = taken if out is None else out.unionAll(taken)
        used = taken.select(F.explode(F.array("a", "b")).alias("used"))
        left = saved(left.join(used, F.col("a") == F.col("used"), "left_anti").join(used, F.col("b") == F.col("used"), "left_anti"), "merge-candidates")
    return candidates if out is None else out


def propagate(members: DataFrame, labels: DataFrame, fallback: str = "altro", confidence: float = 0.85, fallback_confidence: float = 0.3) -> DataFrame:
    """(session_id, label, confidence, method): members take their reviewed cluster's label, all others the fallback."""
    joined = members.join(labels.select("cluster_id", F.col("label").alias("_l")), "cluster_id", "left")
    known = F.col("_l").isNotNull()
    return joined.select("session_id", F.coalesce("_l", F.lit(fallback)).alias("label"), F.when(known, confidence).otherwise(fallback_confidence).alias("confidence"), F.when(known, "CLUSTER_PROPAGATION").otherwise("OUTLIER_DEFAULT").alias("method"))


def refine_regions(members: DataFrame, min_size: int = 5, severe: float = 0.4, rounds: int = 3) -> DataFrame:
    """(session_id, region): clusters are split by label while their labels conflict, for up to ``rounds`` rounds.

    ``members`` has (session_id, cluster_id, label). In each round the label
    distributions of all regions are found by one aggregation; regions whose
    conflict is over ``severe`` are split into those of their labels that hold
    ``min_size`` members, and what is left stays. It ends when no region
    splits. Members stay distributed; only how many regions split is looked at.
    """
    from sessionloom.functions.numbers import conflict_severity
    from sessionloom.sources.shared import saved

    now = saved(members.select("session_id", F.col("cluster_id").alias("region"), "label"), "regions")
    for _ in range(rounds):
        counts = now.where("label IS NOT NULL").groupBy("region", "label").agg(F.count("*").alias("n"))
        shape = counts.groupBy("region").agg(F.sum("n").alias("all"), F.collect_list(F.col("n").cast("double")).alias("ns"))
        severity = conflict_severity(F.transform("ns", lambda x: x / F.col("all")))
        torn = shape.where(severity > severe).select("region")
        parts = saved(counts.where(F.col("n") >= min_size).join(torn, "region", "left_semi").select("region", "label", F.lit(True).alias("_split")), "region-parts")
        if parts.isEmpty():
            break
        joined = now.join(parts, ["region", "label"], "left")
        now = saved(joined.select("session_id", F.when(F.col("_split"), F.concat_ws(":", "region", "label")).otherwise(F.col("region")).alias("region"), "label"), "regions")
    return now.select("session_id", "region")


def linkage_groups(names: list[str], similarity, k: int | None = None) -> list[int]:
    """Group numbers of one tenant's labels by average linkage down to ``k`` groups (half of the labels, 1 to 20).

    A tenant's labels are a vocabulary that people keep, so a task may hold all their pairs.
    """
    n = len(names)
    wanted = max(1, max(1, min(n // 2, 20)) if k is None else k)
    near = np.full((n, n), -np.inf)
    for i in range(n):
        for j in range(i):
            near[i, j] = near[j, i] = similarity(names[j], names[i])
    size, member = np.ones(n), np.arange(n)
    for _ in range(n - wanted):
        x, y = sorted(np.unravel_index(np.argmax(near), near.shape))
        # the mean over all pairs, from the means of the two parts
        merged = (size[x] * near[x] + size[y] * near[y]) / (size[x] + size[y])
        near[x], near[:, x] = merged, merged
        near[y], near[:, y], near[x, x] = -np.inf, -np.inf, -np.inf
        size[x] += size[y]
        member[member == y] = x
    return np.unique(member, return_inverse=True)[1].tolist()


def tuned(parameters: dict[str, float], outlier_share: float, n_clusters: int) -> dict[str, float]:
    """Clustering parameters moved within their bounds: looser where over .4 are outliers, stricter where under 3 clusters are found."""
    size, samples = parameters["min_cluster_size"], parameters["min_samples"]
    if outlier_share > 0.4:
        size, samples = max(2, size - 1), max(1, samples - 1)
    elif n_clusters < 3:
        size = max(2, size - 1)
    elif outlier_share < 0.05:
        size = min(50, size + 1)
    return {**parameters, "min_cluster_size": size, "min_samples": samples}
