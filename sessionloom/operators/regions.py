"""Regions that adapt to their members' labels, round by round, to a fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numbers import conflict_severity, entropy
from sessionloom.operators.clusters import disjoint_pairs, merge_candidates
from sessionloom.operators.vectors import centroids
from sessionloom.sources.shared import saved

__all__ = ["adapt_regions"]

#: Severities over which a region is split, or gets a boundary; the confidence under which a member belongs to that; the fewest members of a part.
SPLIT, BOUNDARY, SURE, LEAST = 0.7, 0.4, 0.75, 3


def _conflicts(now: DataFrame, labels: DataFrame) -> DataFrame:
    """(region, severity, size, strong): regions whose members' labels, weighed by confidence, disagree; ``strong`` are the labels of over a fifth."""
    rows = now.join(labels.select("id", "label"), "id").where("label is not null")
    by_label = rows.groupBy("region", "label").agg(F.sum("conf").alias("s"))
    maps = by_label.groupBy("region").agg(F.sum("s").alias("all"), F.collect_list(F.struct("label", "s")).alias("ls"))
    shares = maps.select("region", F.transform("ls", lambda x: F.struct(x["label"].alias("label"), F.round(x["s"] / F.col("all"), 9).alias("p"))).alias("ls"))
    ps = F.transform("ls", lambda x: x["p"])
    strong = F.transform(F.filter("ls", lambda x: x["p"] > 0.2), lambda x: x["label"])
    measured = shares.select("region", entropy(ps).alias("h"), F.array_max(ps).alias("top"), F.round(conflict_severity(ps), 9).alias("severity"), strong.alias("strong"))
    sizes = now.groupBy("region").agg(F.count("*").alias("size"))
    torn = (F.round("h", 9) > 1.0) | (F.col("top") < 0.6) | (F.size("strong") > 1)
    return measured.where(torn).join(sizes, "region").select("region", "severity", "size", "strong")


def _merged(now: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Regions of one dominant label whose centres are near, two by two, under the smaller name; and how many pairs."""
    rows = now.join(labels, "id").where("label is not null")
    counts = rows.groupBy("region", "label").agg(F.sum("conf").alias("s"), F.count("*").alias("k"))
    shape = counts.groupBy("region").agg(F.max_by("label", F.struct(F.round("s", 9), "label")).alias("label"), (F.max("s") / F.sum("s")).alias("share"), F.sum("k").alias("size"))
    centres = centroids(rows.select("region", "v"), "region").withColumnRenamed("centroid", "centre")
    pairs = saved(disjoint_pairs(merge_candidates(shape.join(centres, "region"))), "merges")
    n = pairs.count()
    if not n:
        return now, 0
    renamed = now.join(pairs.select(F.col("b").alias("region"), "a"), "region", "left").withColumn("region", F.coalesce("a", "region"))
    # a member of both keeps the stronger membership
    return renamed.groupBy("id", "region").agg(F.max("weight").alias("weight"), F.max("conf").alias("conf")), n


def adapt_regions(members: DataFrame, rounds: int = 3, least: int = LEAST, severe: float = SPLIT, moderate: float = BOUNDARY) -> DataFrame:
    """(id, region, weight, conf) after up to ``rounds`` rounds, from members (id, region, label, confidence, v).

    In each round regions with conflicting labels change by severity (over
    ``severe``, over ``moderate``, less). A severe conflict in a region of twice ``least`` members splits off each strong label
    that ``least`` members have (``region:label``). A moderate one gives members
    it isn't sure of (confidence under .75) a second membership in a new boundary
    region (``region~round``): .6 and .4. A slight one lowers confidences and
    weights by .3 of the severity, to .1 at least. Then regions of one label that
    lie near each other are merged. It ends when no region conflicts, or when
    their number stays and no member moved. Null labels take no part in
    conflicts; a null confidence is .5; ids are distinct. An empty table stays
    empty.

    Every step is an aggregation by region or a join on it; the state is written
    each round, and the driver sees counts only.
    """
    labels = saved(members.select("id", "label", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "v"), "labels")
    sure = labels.select("id", F.col("confidence").alias("own"), F.col("label").alias("own_label"))
    now = saved(members.select("id", "region", F.lit(1.0).alias("weight"), F.coalesce("confidence", F.lit(0.5)).alias("conf")), "memberships")
    before = now.select("region").distinct().count()
    for k in range(rounds):
        conflicts = saved(_conflicts(now, labels), "conflicts")
        if conflicts.isEmpty():
            break
        known = now.join(conflicts, "region", "left").join(sure, "id")
        splits = (F.col("severity") > severe) & (F.col("size") >= 2 * least)
        action = F.when(F.col("severity").isNull(), "keep").when(splits, "split").when(F.col("severity") > moderate, "boundary").otherwise("soft")
        known = saved(known.withColumn("action", action), "dispatched")
        parts = known.where("action = 'split' and size(strong) > 1 and array_contains(strong, own_label)").groupBy("region", "own_label").agg(F.count("*").alias("part")).where(F.col("part") >= least)
        placed = known.join(parts.withColumn("goes", F.lit(True)), ["region", "own_label"], "left")
        moves, doubts = F.coalesce("goes", F.lit(False)), (F.col("action") == "boundary") & (F.col("conf") < SURE)
        soft = F.greatest(F.lit(0.1), F.col("conf") - 0.3 * F.col("severity"))
        kept = placed.select(
            "id",
            F.when(moves, F.concat_ws(":", "region", "own_label")).otherwise(F.col("region")).alias("region"),
            F.when(moves, 1.0).when(doubts, 0.6).when(F.col("action") == "soft", soft).otherwise(F.col("weight")).alias("weight"),
            F.when(moves, F.col("own")).when(F.col("action") == "soft", soft).otherwise(F.col("conf")).alias("conf"),
        )
        boundary = placed.where(doubts).select("id", F.concat("region", F.lit(f"~{k}")).alias("region"), F.lit(0.4).alias("weight"), F.lit(0.5).alias("conf"))
        moved = placed.where(moves | doubts | (F.col("action") == "soft")).limit(1).count()
        now, _ = _merged(saved(kept.unionAll(boundary), "memberships"), labels)
        now = saved(now, "memberships")
        n = now.select("region").distinct().count()
        if n == before and not moved:
            break
        before = n
    return now
