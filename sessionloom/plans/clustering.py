"""Queries of clustering, representatives, consensus, propagation and fuzzy regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import numbers as N
from sessionloom.operators import clusters as C
from sessionloom.operators.density import density_clusters, recluster_outliers
from sessionloom.operators.hierarchy import hierarchical_clusters
from sessionloom.operators.vectors import centroid_distances, percentiles
from sessionloom.plans.oracle import FACTS, VECTORS, with_
from sessionloom.plans.registry import query
from sessionloom.plans.relational import BUDGET
from sessionloom.plans.scalars import CENTROIDS, DIST, label_maps
from sessionloom.sources.catalog import facts, vectors

c = F.col


@query("C1_density_clusters")
def c1(spark, d):
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v")
    found = hierarchical_clusters(rows, min_cluster_size=5, min_samples=3, epsilon=0.08)
    return found.select("id", "cluster", F.round("probability", 4).alias("probability"), F.round("outlier_score", 4).alias("outlier_score"))


@query("C2_silhouette", with_(VECTORS) + """, p AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(2 - 2 * list_dot_product(a.v, b.v) + (list_dot_product(a.v, a.v) - 1) + (list_dot_product(b.v, b.v) - 1)) AS m, count(*) AS n FROM vectors a CROSS JOIN vectors b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN m * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM p GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM s""")
def c2(spark, d):
    return C.silhouettes(vectors(spark, d), "label").agg(F.round(F.avg("silhouette"), 4).alias("silhouette"))


@query("C3_intent_combinations", with_(FACTS) + ", i AS (SELECT user_id, list_sort(list(DISTINCT label)) AS intents FROM facts WHERE label <> '' GROUP BY user_id) SELECT array_to_string(intents, '+') AS intents, count(*) AS size FROM i GROUP BY 1 HAVING count(*) >= 2")
def c3(spark, d):
    intents = facts(spark, d).where("label <> ''").groupBy("user_id").agg(F.array_sort(F.collect_set("label")).alias("intents"))
    return intents.groupBy(F.array_join("intents", "+").alias("intents")).agg(F.count("*").alias("size")).where("size >= 2")


@query("C4_refined_groups")
def c4(spark, d):
    # groups of ten and more are clustered on their own; a single sub-cluster refines nothing
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v", "label")
    large = rows.groupBy("label").count().where("count >= 10").select("label")
    found = hierarchical_clusters(rows.join(large, "label", "left_semi"), by="label").join(rows.select("id", "label"), "id")
    return found.groupBy("label").agg(F.count_distinct(F.when(c("cluster") != -1, c("cluster"))).alias("n_parts"), F.count_if(c("cluster") == -1).alias("n_outliers"))


@query("C6_intent_by_scorer", with_(FACTS) + "SELECT session_id, coalesce(llm_label, 'altro') AS intent, CASE WHEN llm_label IS NULL THEN .1 WHEN llm_label = 'error' THEN .05 ELSE llm_conf END AS confidence FROM facts")
def c6(spark, d):
    confidence = F.when(c("llm_label").isNull(), 0.1).when(c("llm_label") == "error", 0.05).otherwise(c("llm_conf"))
    return facts(spark, d).select("session_id", F.coalesce("llm_label", F.lit("altro")).alias("intent"), confidence.alias("confidence"))


@query("C7_group_by_intent", with_(FACTS) + ", i AS (SELECT session_id, CASE WHEN llm_conf >= .3 THEN llm_label || '_' || CAST(session_id % 60 AS STRING) ELSE 'altro' END AS intent FROM facts), n AS (SELECT *, count(*) OVER (PARTITION BY intent) AS size FROM i) SELECT intent, count(*) AS size FROM (SELECT CASE WHEN size < 20 THEN 'altro' ELSE intent END AS intent FROM n) GROUP BY intent")
def c7(spark, d):
    # small groups spill into the catch-all, whatever order they come in
    intent = F.when(c("llm_conf") >= 0.3, F.concat("llm_label", F.lit("_"), (c("session_id") % 60).cast("string"))).otherwise("altro")
    sizes = facts(spark, d).groupBy(intent.alias("intent")).agg(F.count("*").alias("size"))
    return sizes.groupBy(F.when(c("size") < 20, "altro").otherwise(c("intent")).alias("intent")).agg(F.sum("size").alias("size"))


@query("C9_regrouped_outliers", with_(FACTS) + ", o AS (SELECT llm_label, count(*) AS n FROM facts WHERE (cluster_id = '-1' OR starts_with(cluster_id, 'outlier_')) AND llm_conf >= .8 GROUP BY 1) SELECT llm_label, n, 39 + row_number() OVER (ORDER BY llm_label) AS new_cluster FROM o WHERE n >= 2")
def c9(spark, d):
    sure = facts(spark, d).where("(cluster_id = '-1' OR startswith(cluster_id, 'outlier_')) AND llm_conf >= 0.8")
    groups = sure.groupBy("llm_label").agg(F.count("*").alias("n")).where("n >= 2")  # one row for each label
    last = facts(spark, d).agg(F.max(F.expr("try_cast(cluster_id AS BIGINT)")).alias("last"))
    return groups.crossJoin(F.broadcast(last)).select("llm_label", "n", (c("last") + F.row_number().over(Window.orderBy("llm_label"))).alias("new_cluster"))


@query("R1_diverse_representatives")
def r1(spark, d):
    return C.diverse_representatives(vectors(spark, d), "label", "vec_id")


@query("R2_farthest_from_first", with_(VECTORS) + ", f AS (SELECT label, arg_min(v, vec_id) AS w, min(vec_id) AS i FROM vectors GROUP BY label), g AS (SELECT v.label, vec_id, i, CASE WHEN vec_id = i THEN -1 ELSE 1 - list_dot_product(v.v, w) / sqrt(list_dot_product(v.v, v.v) * list_dot_product(w, w)) END AS far FROM vectors v JOIN f ON v.label = f.label) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(far, 9) DESC, vec_id) AS rn FROM g) WHERE rn <= 2 OR vec_id = i")
def r2(spark, d):
    rows = vectors(spark, d)
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"), F.min("vec_id").alias("i"))
    far = rows.join(first, "label").withColumn("far", F.when(c("vec_id") == c("i"), -1.0).otherwise(1 - N.cosine(c("v"), c("w"))))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("far", 9)), "vec_id")
    return far.withColumn("rn", F.row_number().over(order)).where("rn <= 2 OR vec_id = i").select("label", "vec_id")


@query("R4_review_selection", with_(FACTS) + BUDGET + ", b AS (SELECT cluster_id, greatest(0, least(base, 60 - coalesce(sum(base) OVER (ORDER BY size DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS slots FROM plan), r AS (SELECT session_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence NULLS FIRST, session_id) AS rn FROM facts WHERE cluster_id IS NOT NULL) SELECT session_id, cluster_id FROM r JOIN b USING (cluster_id) WHERE rn <= slots")
def r4(spark, d):
    rows = facts(spark, d).where("cluster_id IS NOT NULL")
    slots = C.review_budget(rows.groupBy("cluster_id").agg(F.count("*").alias("size")), 60).where("slots > 0")
    order = Window.partitionBy("cluster_id").orderBy(c("confidence").asc_nulls_first(), "session_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 5").join(slots, "cluster_id").where("rn <= slots").select("session_id", "cluster_id")


def review_selection(spark, d, order):
    """Rows of clusters in some order as far as 60 slots go, the least sure first within each."""
    rows = facts(spark, d).where("cluster_id IS NOT NULL")
    clusters = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.5)), 6).alias("sure"), F.min("session_id").alias("first"))
    slots = C.review_budget(clusters, 60, order).where("slots > 0")
    place = Window.partitionBy("cluster_id").orderBy(c("confidence").asc_nulls_first(), "session_id")
    return rows.withColumn("rn", F.row_number().over(place)).where("rn <= 5").join(slots, "cluster_id").where("rn <= slots").select("session_id", "cluster_id")


def review_sql(order: str) -> str:
    return with_(FACTS) + f""", clusters AS (SELECT cluster_id, count(*) AS size, round(coalesce(avg(confidence), .5), 6) AS sure, min(session_id) AS first FROM facts WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
plan AS (SELECT *, CASE WHEN size <= 3 THEN size WHEN size <= 10 THEN 3 WHEN size <= 50 THEN 4 ELSE 5 END AS base FROM clusters),
b AS (SELECT cluster_id, greatest(0, least(base, 60 - coalesce(sum(base) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS slots FROM plan),
r AS (SELECT session_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence NULLS FIRST, session_id) AS rn FROM facts WHERE cluster_id IS NOT NULL) SELECT session_id, cluster_id FROM r JOIN b USING (cluster_id) WHERE rn <= slots"""


@query("R4_review_by_confidence", review_sql("sure, cluster_id"))
def r4_sure(spark, d):
    return review_selection(spark, d, [c("sure").asc(), c("cluster_id").asc()])


@query("R4_review_in_order", review_sql("first"))
def r4_first(spark, d):
    # clusters as they came up first
    return review_selection(spark, d, [c("first").asc()])


CONSENSUS = """, votes AS (SELECT cluster_id, llm_label AS label, llm_conf AS confidence FROM facts WHERE is_representative AND cluster_id IS NOT NULL AND llm_label IS NOT NULL),
k AS (SELECT cluster_id, label, count(*) AS k, avg(confidence) AS mean FROM votes GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY cluster_id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, label) AS rn FROM k),
s AS (SELECT cluster_id, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, label) AS rn FROM votes) WHERE rn = 1),
raw AS (SELECT r.cluster_id, CASE WHEN k / n >= .6 THEN r.label ELSE s.label END AS label, CASE WHEN k / n >= .6 THEN least(1, mean + least(.1, (k / n - .6) * .25)) ELSE s.confidence * .8 END AS c FROM r JOIN s USING (cluster_id) WHERE rn = 1),
consensus AS (SELECT cluster_id, label, CASE WHEN c < .5 THEN greatest(.3, c) ELSE c END AS confidence FROM raw)
"""


def consensus(spark, d):
    reps = facts(spark, d).where("is_representative AND cluster_id IS NOT NULL").select("cluster_id", c("session_id").alias("rep_id"), c("llm_label").alias("label"), c("llm_conf").alias("confidence"))
    return C.consensus(reps)


@query("G1_consensus", with_(FACTS) + CONSENSUS + "SELECT cluster_id, label, round(confidence, 4) AS confidence FROM consensus")
def g1(spark, d):
    return consensus(spark, d).select("cluster_id", "label", F.round("confidence", 4).alias("confidence"))


@query("P1_optimised_classification", with_(FACTS) + CONSENSUS + """SELECT session_id, CASE WHEN is_representative THEN llm_label WHEN q.label IS NOT NULL THEN q.label ELSE llm_label END AS label,
CASE WHEN f.cluster_id IS NULL OR f.cluster_id = '-1' OR starts_with(f.cluster_id, 'outlier_') THEN 'OUTLIER_DIRECT' WHEN is_representative THEN 'REPRESENTATIVE_ORIGINAL' WHEN q.label IS NOT NULL THEN 'CLUSTER_PROPAGATED' ELSE 'DIRECT' END AS method
FROM facts f LEFT JOIN (SELECT * FROM consensus WHERE cluster_id <> '-1' AND NOT starts_with(cluster_id, 'outlier_')) q ON f.cluster_id = q.cluster_id""")
def p1(spark, d):
    labels = consensus(spark, d).where("cluster_id != '-1' AND NOT startswith(cluster_id, 'outlier_')").select("cluster_id", c("label").alias("shared"))
    joined = facts(spark, d).join(labels, "cluster_id", "left")
    outlier = c("cluster_id").isNull() | (c("cluster_id") == "-1") | c("cluster_id").startswith("outlier_")
    rep = F.coalesce("is_representative", F.lit(False))
    label = F.when(rep, c("llm_label")).otherwise(F.coalesce("shared", "llm_label"))
    method = F.when(outlier, "OUTLIER_DIRECT").when(rep, "REPRESENTATIVE_ORIGINAL").when(c("shared").isNotNull(), "CLUSTER_PROPAGATED").otherwise("DIRECT")
    return joined.select("session_id", label.alias("label"), method.alias("method"))


@query("P2_propagate_human_labels", with_(FACTS) + CONSENSUS + "SELECT session_id, coalesce(q.label, 'altro') AS label, CASE WHEN q.label IS NULL THEN .3 ELSE .85 END AS confidence, CASE WHEN q.label IS NULL THEN 'OUTLIER_DEFAULT' ELSE 'CLUSTER_PROPAGATION' END AS method FROM facts f LEFT JOIN consensus q ON f.cluster_id = q.cluster_id")
def p2(spark, d):
    return C.propagate(facts(spark, d), consensus(spark, d))


@query("P3_gate_propagation", with_(FACTS) + ", f1 AS (SELECT cluster_id, llm_label AS shared, llm_conf AS conf FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY session_id) AS rn FROM facts WHERE is_representative AND cluster_id IS NOT NULL) WHERE rn = 1) SELECT session_id, coalesce(shared, 'altro') AS label, coalesce(conf, .3) AS confidence, coalesce(conf >= .5 AND shared <> '', FALSE) AS automatic FROM facts LEFT JOIN f1 USING (cluster_id)")
def p3(spark, d):
    first = facts(spark, d).where("is_representative AND cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min_by(F.struct(c("llm_label").alias("shared"), c("llm_conf").alias("conf")), "session_id").alias("x")).select("cluster_id", "x.*")
    joined = facts(spark, d).select("session_id", "cluster_id").join(first, "cluster_id", "left")
    return joined.select("session_id", F.coalesce("shared", F.lit("altro")).alias("label"), F.coalesce("conf", F.lit(0.3)).alias("confidence"), F.coalesce((c("conf") >= 0.5) & (c("shared") != ""), F.lit(False)).alias("automatic"))


@query("P4_cluster_info", with_(FACTS) + "SELECT label, count(*) AS size, CAST(.8 AS DOUBLE) AS confidence FROM facts WHERE label IS NOT NULL GROUP BY label")
def p4(spark, d):
    return facts(spark, d).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("size"), F.lit(0.8).alias("confidence"))


@query("P5_recluster_outliers")
def p5(spark, d):
    # the run before clustered the first two thirds; its outliers are the history of this run on the rest
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v")
    history = density_clusters(rows.where("id % 3 <> 0"), quantile=0.5).where("cluster = -1").select("id")
    return recluster_outliers(density_clusters(rows.where("id % 3 = 0"), quantile=0.5), history, rows)


# -- fuzzy regions ------------------------------------------------------------------

RADII = ", radii AS (SELECT label, quantile_cont(distance, 0.75) AS radius FROM far GROUP BY label)\n"


def radii(rows):
    return percentiles(rows, "label", "distance", 0.75, "radius")


@query("T1_initial_regions", with_(VECTORS) + CENTROIDS + RADII + ", core AS (SELECT vec_id, label FROM far JOIN radii USING (label) WHERE round(distance, 9) <= round(radius, 9)), out AS (SELECT * FROM vectors WHERE vec_id NOT IN (SELECT vec_id FROM core)), aff AS (SELECT v.vec_id, c.label AS region, greatest(.1, 1 - sqrt(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / (2 * radius)) AS a FROM out v CROSS JOIN centroids c JOIN radii r ON r.label = c.label), soft AS (SELECT vec_id, region, a / sum(a) OVER (PARTITION BY vec_id) AS m FROM aff WHERE round(a, 9) > .25) SELECT vec_id, CAST(label AS VARCHAR) AS region, CAST(1 AS DOUBLE) AS membership FROM core UNION ALL SELECT vec_id, CAST(region AS VARCHAR), round(m, 4) FROM soft UNION ALL SELECT vec_id, 'outlier_' || CAST(vec_id AS VARCHAR), CAST(1 AS DOUBLE) FROM out WHERE vec_id NOT IN (SELECT vec_id FROM soft)")
def t1(spark, d):
    from sessionloom.operators.vectors import centroids, soft_memberships

    rows = vectors(spark, d)
    far = centroid_distances(rows, "label")
    radius = radii(far)
    inside = F.round("distance", 9) <= F.round("radius", 9)
    placed = far.join(radius, "label").select("vec_id", "label", "v", inside.alias("core"))
    regions = centroids(rows, "label").join(radius, "label").withColumnRenamed("label", "region")
    out = placed.where("NOT core").select("vec_id", "v")
    soft = soft_memberships(out.withColumnRenamed("vec_id", "id"), regions, 0.25).withColumnRenamed("id", "vec_id")
    # a row that no region takes is a region of its own
    alone = out.select("vec_id").join(soft, "vec_id", "left_anti").select("vec_id", F.concat(F.lit("outlier_"), c("vec_id").cast("string")).alias("region"), F.lit(1.0).alias("membership"))
    core = placed.where("core").select("vec_id", c("label").cast("string").alias("region"), F.lit(1.0).alias("membership"))
    return core.unionByName(soft.select("vec_id", c("region").cast("string").alias("region"), F.round("membership", 4).alias("membership"))).unionByName(alone)


@query("T2_region_labels", with_(FACTS) + "SELECT cluster_id, label, round(sum(confidence) / sum(sum(confidence)) OVER (PARTITION BY cluster_id), 4) AS p FROM facts WHERE cluster_id IS NOT NULL AND label IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2")
def t2(spark, d):
    sums = facts(spark, d).where("cluster_id IS NOT NULL AND label IS NOT NULL AND confidence IS NOT NULL").groupBy("cluster_id", "label").agg(F.sum("confidence").alias("s"))
    return sums.select("cluster_id", "label", F.round(c("s") / F.sum("s").over(Window.partitionBy("cluster_id")), 4).alias("p"))


CONFLICT = DIST + """, m AS (SELECT cluster_id, -sum(p * log2(p)) AS h, max(p) AS top, count(*) FILTER (p > .2) AS strong, count(*) AS k FROM p GROUP BY 1),
conflicts AS (SELECT *, least(1, least(h / log2(greatest(k, 2)), 1) * .4 + (1 - top) * .4 + least((k - 1) / 3, 1) * .2) AS severity FROM m)
"""


def conflicts(spark, d):
    maps = label_maps(spark, d).withColumn("ps", F.map_values("m"))
    return maps.select("cluster_id", N.entropy(c("ps")).alias("h"), F.array_max("ps").alias("top"), F.size(F.filter("ps", lambda p: p > 0.2)).alias("strong"), N.conflict_severity(c("ps")).alias("severity"))


@query("T3_conflicts", with_(FACTS) + CONFLICT + "SELECT cluster_id, round(severity, 4) AS severity FROM conflicts WHERE round(h, 9) > 1.0 OR round(top, 9) < .6 OR strong > 1")
def t3(spark, d):
    return conflicts(spark, d).where("round(h, 9) > 1.0 OR round(top, 9) < 0.6 OR strong > 1").select("cluster_id", F.round("severity", 4).alias("severity"))


@query("T4_resolution", with_(FACTS) + CONFLICT + "SELECT cluster_id, CASE WHEN round(severity, 9) > .7 AND k >= 4 THEN 'split' WHEN round(severity, 9) > .4 THEN 'boundary' ELSE 'soft' END AS action FROM conflicts")
def t4(spark, d):
    sizes = label_maps(spark, d).select("cluster_id", F.size("m").alias("k"))
    s = F.round("severity", 9)
    return conflicts(spark, d).join(sizes, "cluster_id").select("cluster_id", F.when((s > 0.7) & (c("k") >= 4), "split").when(s > 0.4, "boundary").otherwise("soft").alias("action"))


@query("T5_split_by_label", with_(FACTS) + "SELECT cluster_id || ':' || label AS region, count(*) AS size FROM facts WHERE cluster_id IS NOT NULL AND label <> '' GROUP BY 1 HAVING count(*) >= 5")
def t5(spark, d):
    return facts(spark, d).where("cluster_id IS NOT NULL AND label <> ''").groupBy(F.concat_ws(":", "cluster_id", "label").alias("region")).agg(F.count("*").alias("size")).where("size >= 5")


@query("T6_boundary_refinement", with_(VECTORS) + CENTROIDS + RADII + "SELECT vec_id, label AS region, .6 AS membership FROM far JOIN radii USING (label) WHERE distance > radius AND distance <= radius * 1.5 UNION ALL SELECT vec_id, -label - 1, .4 FROM far JOIN radii USING (label) WHERE distance > radius AND distance <= radius * 1.5")
def t6(spark, d):
    far = centroid_distances(vectors(spark, d), "label")
    edge = far.join(radii(far), "label").where("distance > radius AND distance <= radius * 1.5")
    return edge.select("vec_id", F.explode(F.array(F.struct(c("label").alias("region"), F.lit(0.6).alias("membership")), F.struct((-c("label") - 1).alias("region"), F.lit(0.4).alias("membership")))).alias("x")).select("vec_id", "x.*")


@query("T7_soft_reassignment", with_(FACTS) + CONFLICT + "SELECT session_id, round(greatest(.1, confidence - .3 * severity), 4) AS confidence FROM facts JOIN conflicts USING (cluster_id) WHERE confidence IS NOT NULL")
def t7(spark, d):
    return facts(spark, d).where("confidence IS NOT NULL").join(conflicts(spark, d), "cluster_id").select("session_id", F.round(F.greatest(F.lit(0.1), c("confidence") - c("severity") * 0.3), 4).alias("confidence"))


REGIONS = ", parts AS (SELECT label || ':' || CAST(vec_id % 4 AS VARCHAR) AS region, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vectors), means AS (SELECT region, label, i, avg(x) AS x, count(*) AS n FROM parts GROUP BY ALL), regions AS (SELECT region, label, max(n) AS n, list(x ORDER BY i) AS w FROM means GROUP BY ALL)\n"


def vector_regions(spark, d):
    """Regions of vectors (a quarter of each label's), with their dominant label, its share, their size and centre."""
    from sessionloom.operators.vectors import centroids

    rows = vectors(spark, d).withColumn("region", F.concat_ws(":", c("label").cast("string"), (c("vec_id") % 4).cast("string")))
    counts = rows.groupBy("region", "label").agg(F.count("*").alias("k"))
    shape = counts.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("label"), (F.max("k") / F.sum("k")).alias("share"), F.sum("k").alias("size"))
    return shape.join(centroids(rows, "region"), "region").withColumnRenamed("centroid", "centre")


@query("T8_merge_candidates", with_(VECTORS) + REGIONS + "SELECT a.region AS a, b.region AS b, round(list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)), 4) AS cosine FROM regions a JOIN regions b ON a.label = b.label AND a.region < b.region WHERE least(a.n, b.n) / greatest(a.n, b.n) > .3 AND round(list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)), 9) >= .1")
def t8(spark, d):
    return C.merge_candidates(vector_regions(spark, d), least_cosine=0.1).withColumn("cosine", F.round("cosine", 4))


@query("T8_merge_pairs")
def t8_pairs(spark, d):
    return C.disjoint_pairs(C.merge_candidates(vector_regions(spark, d), least_cosine=0.1)).select("a", "b")


@query("T9_region_merge", with_(FACTS) + "SELECT CAST(CAST(cluster_id AS BIGINT) // 2 AS BIGINT) AS region, count(*) AS size, round(sum(confidence) / count(confidence), 4) AS centre, round(max(confidence), 4) AS strongest FROM facts WHERE regexp_matches(cluster_id, '^[0-9]+$') GROUP BY 1")
def t9(spark, d):
    # the merged centre is the mean of the parts' centres, weighed by their sizes
    parts = facts(spark, d).where("cluster_id RLIKE '^[0-9]+$'").groupBy("cluster_id").agg(F.count("*").alias("n"), F.count("confidence").alias("k"), F.avg("confidence").alias("centre"), F.max("confidence").alias("strongest"))
    merged = parts.groupBy(F.floor(c("cluster_id").cast("long") / 2).alias("region"))
    return merged.agg(F.sum("n").alias("size"), F.round(F.sum(c("centre") * c("k")) / F.sum("k"), 4).alias("centre"), F.round(F.max("strongest"), 4).alias("strongest"))


@query("T11_region_depth", "WITH RECURSIVE r AS (SELECT n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, depth + 1 FROM nation n JOIN r ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 2 = r.id) SELECT CAST(id AS BIGINT) AS id, CAST(depth AS BIGINT) AS depth FROM r")
def t11(spark, d):
    # regions form a tree of some tens of rows, as deep as splits go
    tree = spark.read.parquet(f"{d}/nation.parquet").select(c("n_nationkey").cast("long").alias("id"), F.when(c("n_nationkey") > 0, F.floor((c("n_nationkey") - 1) / 2)).alias("parent"))
    level, found, depth = tree.where("parent IS NULL").select("id"), None, 0
    while not level.isEmpty():
        named = level.withColumn("depth", F.lit(depth).cast("long"))
        found = named if found is None else found.unionAll(named)
        level, depth = tree.join(level.withColumnRenamed("id", "parent"), "parent").select("id"), depth + 1
    return found


@query("T12_final_label", with_(FACTS) + ", m AS (SELECT user_id, cluster_id, sum(confidence) AS s FROM facts WHERE cluster_id IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2), r AS (SELECT user_id, arg_max(cluster_id, {'s': round(s, 9), 'c': cluster_id}) AS cluster_id FROM m GROUP BY 1), k AS (SELECT cluster_id, label, count(*) AS k FROM facts WHERE label IS NOT NULL GROUP BY 1, 2), t AS (SELECT cluster_id, arg_max(label, {'k': k, 'l': label}) AS label FROM k GROUP BY 1) SELECT user_id, label FROM r JOIN t USING (cluster_id)")
def t12(spark, d):
    rows = facts(spark, d)
    sums = rows.where("cluster_id IS NOT NULL AND confidence IS NOT NULL").groupBy("user_id", "cluster_id").agg(F.sum("confidence").alias("s"))
    best = sums.groupBy("user_id").agg(F.max_by("cluster_id", F.struct(F.round("s", 9), "cluster_id")).alias("cluster_id"))
    labels = rows.where("label IS NOT NULL").groupBy("cluster_id", "label").agg(F.count("*").alias("k")).groupBy("cluster_id").agg(F.max_by("label", F.struct("k", "label")).alias("label"))
    return best.join(labels, "cluster_id").select("user_id", "label")
