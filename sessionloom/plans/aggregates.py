"""Aggregations over the classification log, the call log and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.plans.oracle import FACTS, TAGS, TENANTS, VECTORS, with_
from sessionloom.plans.registry import query
from sessionloom.sources.catalog import facts, table, tags, tenants, vectors


def rows_n():
    return F.count("*").alias("n")


def mean3():
    return F.round(F.avg("confidence"), 3).alias("mean_confidence")


MEAN3 = "round(avg(confidence), 3) AS mean_confidence"


def counted(name: str, keys: str, where: str = "TRUE", extra: str = "") -> None:
    """Register a count by keys, with a filter and further aggregates in SQL that both engines share."""
    aggregates = f"count(*) AS n{', ' + extra if extra else ''}"

    @query(name, with_(FACTS) + f"SELECT {keys}{', ' if keys else ''}{aggregates} FROM facts WHERE {where}{' GROUP BY ' + keys if keys else ''}")
    def run(spark, d):
        rows = facts(spark, d).where(where)
        parts = [F.expr(x) for x in _split(aggregates)]
        return rows.groupBy(*keys.split(", ")).agg(*parts) if keys else rows.agg(*parts)


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


@query("A3_label_statistics", with_(FACTS) + f"SELECT coalesce(label, llm_label, 'altro') AS shown, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct, {MEAN3}, round(min(confidence), 3) AS min_confidence, round(max(confidence), 3) AS max_confidence FROM facts GROUP BY 1")
def a3(spark, d):
    shown = F.coalesce("label", "llm_label", F.lit("altro")).alias("shown")
    rows = facts(spark, d).groupBy(shown).agg(rows_n(), mean3(), F.round(F.min("confidence"), 3).alias("min_confidence"), F.round(F.max("confidence"), 3).alias("max_confidence"))
    return rows.withColumn("pct", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy(F.lit(0))), 2)).orderBy(F.desc("n"), "shown")


@query("A4_review_status", with_(FACTS) + ", keys AS (SELECT unnest(['pending', 'auto_classified', 'resolved', 'completed', 'not_required', 'skipped']) AS status), c AS (SELECT coalesce(review_status, 'not_required') AS status, count(*) AS n FROM facts GROUP BY 1) SELECT status, coalesce(n, 0) AS n, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total FROM keys LEFT JOIN c USING (status)")
def a4(spark, d):
    keys = spark.sql("SELECT explode(array('pending', 'auto_classified', 'resolved', 'completed', 'not_required', 'skipped')) AS status")
    counts = facts(spark, d).groupBy(F.coalesce("review_status", F.lit("not_required")).alias("status")).agg(rows_n())
    joined = keys.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return joined.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


@query("A5_distinct_labels", with_(FACTS) + "SELECT DISTINCT label FROM facts WHERE trim(label) <> ''")
def a5(spark, d):
    return facts(spark, d).select("label").where("trim(label) <> ''").distinct().orderBy("label")


@query("A6_cluster_summary", with_(FACTS) + """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY session_id) AS rn FROM facts WHERE cluster_id IS NOT NULL),
dominant AS (SELECT cluster_id, label AS dominant_label FROM (SELECT cluster_id, label, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, label) AS r FROM numbered WHERE label IS NOT NULL AND label <> '' GROUP BY cluster_id, label) WHERE r = 1)
SELECT cluster_id, count(*) AS n, string_agg(left(text, 100), ' | ' ORDER BY session_id) FILTER (rn <= 3) AS previews, any_value(dominant_label) AS dominant_label, round(avg(confidence), 3) AS mean_confidence, count(DISTINCT label) AS n_labels
FROM numbered LEFT JOIN dominant USING (cluster_id) GROUP BY cluster_id""")
def a6(spark, d):
    rows = facts(spark, d).where("cluster_id IS NOT NULL")
    dominant = rows.where("label IS NOT NULL AND label <> ''").groupBy("cluster_id", "label").agg(rows_n()).groupBy("cluster_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("dominant_label"))
    # previews come from the three first rows only, so no cluster is gathered whole
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("session_id"))).where("rn <= 3").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("session_id", F.left("text", F.lit(100)).alias("t")))).alias("p"))
    main = rows.groupBy("cluster_id").agg(rows_n(), mean3(), F.count_distinct("label").alias("n_labels"))
    return main.join(first, "cluster_id").join(dominant, "cluster_id", "left").select("cluster_id", "n", F.array_join("p.t", " | ").alias("previews"), "dominant_label", "mean_confidence", "n_labels")


@query("A7_tenant_statistics", with_(FACTS, TENANTS) + "SELECT tenant_name, count(DISTINCT session_id) AS n_sessions, count(*) AS n_docs FROM facts JOIN tenants USING (tenant_id) GROUP BY tenant_name")
def a7(spark, d):
    return facts(spark, d).join(tenants(spark, d), "tenant_id").groupBy("tenant_name").agg(F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_docs")).orderBy("tenant_name")


counted("A8_labels_by_tenant", "tenant_id, label", extra="count(DISTINCT session_id) AS n_sessions, round(avg(confidence), 3) AS mean_confidence")
counted("A10_tag_distribution", "label", "tenant_id = 2", "round(avg(confidence), 4) AS mean_confidence")
counted("A16_tag_usage", "label", "label <> 'altro'", "round(avg(confidence), 4) AS mean_confidence")
counted("A17_automatic_tags", "label", "method IN ('AUTOMATIC', 'HYBRID')", "round(avg(confidence), 4) AS mean_confidence")
counted("A18_human_tags", "label", "method IN ('HUMAN_REVIEW', 'MANUAL') AND label IS NOT NULL", "CAST(0.95 AS DOUBLE) AS confidence")
counted("A25_auto_breakdown", "method", "review_status = 'auto_classified'")
counted("A40_method_histogram", "method")
counted("A12_general_statistics", "", extra="count(DISTINCT session_id) AS n_sessions, count(DISTINCT label) AS n_labels, count(DISTINCT tenant_id) AS n_tenants, round(avg(confidence), 4) AS mean_confidence")
counted("A26_status_breakdown", "", extra="count(CASE WHEN review_status = 'pending' THEN 1 END) AS pending, count(CASE WHEN review_status = 'auto_classified' THEN 1 END) AS automatic, count(CASE WHEN review_status IN ('resolved', 'completed') THEN 1 END) AS reviewed, count(CASE WHEN review_status IS NULL THEN 1 END) AS available, count(CASE WHEN label IS NOT NULL THEN 1 END) AS classified")
counted("A32_ml_debug_summary", "", "ml_label IS NOT NULL", "round(avg(ml_conf), 4) AS mean_confidence, round(min(ml_conf), 4) AS min_confidence, round(max(ml_conf), 4) AS max_confidence, count(DISTINCT ml_label) AS n_labels")
counted("A35_feedback_summary", "method", "method IN ('HUMAN_REVIEW', 'MANUAL')", "round(avg(confidence), 4) AS mean_confidence, round(avg(CASE WHEN label <> ml_label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS change_rate")
counted("A38_memory_statistics", "label", extra="count(CASE WHEN review_status = 'resolved' THEN 1 END) AS in_memory, count(CASE WHEN method = 'MANUAL' THEN 1 END) AS in_database")
counted("A42_label_decisions", "", extra="count(CASE WHEN label = ml_label THEN 1 END) AS reused, count(CASE WHEN label <> ml_label THEN 1 END) AS created, round(count(CASE WHEN label = ml_label THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS reuse_rate")
counted("A43_classifier_statistics", "", extra="round(count(CASE WHEN session_id % 3 = 0 THEN 1 END) / CAST(greatest(1, count(*)) AS DOUBLE), 4) AS cache_hit_rate, round(count(CASE WHEN llm_label = 'error' THEN 1 END) / CAST(greatest(1, count(llm_label)) AS DOUBLE), 4) AS error_rate")
counted("A27_run_statistics", "", extra="count(CASE WHEN confidence >= 0.8 THEN 1 END) AS high, count(CASE WHEN confidence < 0.8 THEN 1 END) AS low, count(CASE WHEN ml_label = llm_label THEN 1 END) AS agreements, count(CASE WHEN ml_label <> llm_label THEN 1 END) AS disagreements")
counted("A29_batch_statistics", "label", extra="round(avg(confidence), 4) AS mean_confidence, round(avg(CASE WHEN confidence >= 0.8 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS high_rate")
counted("A15_conditional_counts", "", extra="count(CASE WHEN method = 'AUTOMATIC' THEN 1 END) AS automatic, count(CASE WHEN method = 'MANUAL' THEN 1 END) AS manual, count(CASE WHEN review_status = 'completed' THEN 1 END) AS reviewed, round(avg(confidence), 4) AS mean_confidence")


@query("A9_client_status", with_(FACTS) + "SELECT count(*) AS n, round(avg(confidence), 4) AS mean_confidence, epoch_us(max(ts)) AS newest FROM facts WHERE tenant_id = 1")
def a9(spark, d):
    return facts(spark, d).where("tenant_id = 1").agg(rows_n(), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.unix_micros(F.max("ts").cast("timestamp")).alias("newest"))


@query("A11_label_by_method", with_(FACTS) + """, m AS (SELECT label, method, count(*) AS n, count(DISTINCT session_id) AS s FROM facts WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT m.label, CAST(sum(n) AS BIGINT) AS n, any_value(u.s) AS n_sessions, any_value(u.c) AS mean_confidence, string_agg(method || '=' || CAST(n AS STRING), ',' ORDER BY method) AS methods
FROM m JOIN (SELECT label, count(DISTINCT session_id) AS s, round(avg(confidence), 4) AS c FROM facts GROUP BY 1) u USING (label) GROUP BY m.label""")
def a11(spark, d):
    rows = facts(spark, d).where("label IS NOT NULL")
    by_method = rows.groupBy("label", "method").agg(rows_n(), F.sum("confidence").alias("c"), F.count("confidence").alias("k"), F.count_distinct("session_id").alias("s"))
    methods = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "n"))), lambda x: F.concat(x["method"], F.lit("="), x["n"].cast("string"))), ",")
    # a session has one method, so its counts add up; means are weighted
    return by_method.groupBy("label").agg(F.sum("n").alias("n"), F.sum("s").alias("n_sessions"), F.round(F.sum("c") / F.sum("k"), 4).alias("mean_confidence"), methods.alias("methods"))


@query("A13_client_rollup", with_(FACTS, TENANTS) + "SELECT tenant_name, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, epoch_us(max(ts)) AS newest FROM facts JOIN tenants USING (tenant_id) GROUP BY tenant_name")
def a13(spark, d):
    rows = facts(spark, d).groupBy("tenant_id").agg(rows_n(), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.unix_micros(F.max("ts").cast("timestamp")).alias("newest"))
    return rows.join(tenants(spark, d), "tenant_id").select("tenant_name", "n", "mean_confidence", "newest").orderBy(F.desc("n"))


@query("A14_totals", with_(FACTS) + "SELECT tenant_id, label, method, count(*) AS n FROM facts GROUP BY GROUPING SETS ((tenant_id), (label), (method), ())")
def a14(spark, d):
    facts(spark, d).select("tenant_id", "label", "method").createOrReplaceTempView("loom_facts")
    return spark.sql("SELECT tenant_id, label, method, count(*) AS n FROM loom_facts GROUP BY GROUPING SETS ((tenant_id), (label), (method), ())")


@query("A19_tag_dedupe", with_(TAGS) + "SELECT left(tag_name, 1) AS name, min(tag_id) AS tag_id, max(tag_description) AS description FROM tags GROUP BY 1")
def a19(spark, d):
    return tags(spark, d).groupBy(F.left("tag_name", F.lit(1)).alias("name")).agg(F.min("tag_id").alias("tag_id"), F.max("tag_description").alias("description"))


@query("A20_tenant_dates", with_(FACTS) + "SELECT tenant_id, count(*) AS n, epoch_us(min(ts)) AS oldest, epoch_us(max(ts)) AS newest FROM facts GROUP BY tenant_id")
def a20(spark, d):
    return facts(spark, d).groupBy("tenant_id").agg(rows_n(), F.unix_micros(F.min("ts").cast("timestamp")).alias("oldest"), F.unix_micros(F.max("ts").cast("timestamp")).alias("newest"))


@query("A21_active_per_tenant", with_(TAGS) + "SELECT tenant_id, count(*) AS n FROM tags WHERE is_active GROUP BY tenant_id")
def a21(spark, d):
    return tags(spark, d).where("is_active").groupBy("tenant_id").agg(rows_n())


@query("A22_frequent_labels", with_(FACTS) + "SELECT label, count(*) AS n FROM facts WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND label <> 'altro' GROUP BY label ORDER BY n DESC, label LIMIT 5")
def a22(spark, d):
    return facts(spark, d).where("ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAYS AND label <> 'altro'").groupBy("label").agg(rows_n()).orderBy(F.desc("n"), "label").limit(5)


@query("A23_merged_counts", with_(FACTS) + """, merged AS (SELECT label FROM facts WHERE method = 'MANUAL' UNION ALL SELECT llm_label FROM facts WHERE method = 'HUMAN_REVIEW' UNION ALL SELECT CASE quality WHEN 1 THEN 'click' ELSE 'view' END FROM labels)
SELECT label, count(*) AS n FROM merged WHERE label IS NOT NULL GROUP BY label""")
def a23(spark, d):
    rows = facts(spark, d)
    merged = rows.where("method = 'MANUAL'").select("label").unionByName(rows.where("method = 'HUMAN_REVIEW'").select(F.col("llm_label").alias("label"))).unionByName(table(spark, d, "labels").select(F.expr("CASE quality WHEN 1 THEN 'click' ELSE 'view' END").alias("label")))
    return merged.where("label IS NOT NULL").groupBy("label").agg(rows_n())


@query("A24_queue_statistics", with_(FACTS) + """SELECT count(*) AS n, round(avg(uncertainty), 4) AS mean_uncertainty, round(avg(novelty), 4) AS mean_novelty,
count(*) FILTER (confidence >= .8) AS high, count(*) FILTER (confidence >= .5 AND confidence < .8) AS middle, count(*) FILTER (confidence < .5) AS low,
count(*) FILTER (ml_label <> llm_label) AS disagree, count(*) FILTER (uncertainty > .7) AS uncertain, count(*) FILTER (novelty > .7) AS novel FROM facts WHERE review_status = 'pending'""")
def a24(spark, d):
    c = F.col("confidence")
    return facts(spark, d).where("review_status = 'pending'").agg(
        rows_n(), F.round(F.avg("uncertainty"), 4).alias("mean_uncertainty"), F.round(F.avg("novelty"), 4).alias("mean_novelty"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("middle"), F.count_if(c < 0.5).alias("low"),
        F.count_if(F.col("ml_label") != F.col("llm_label")).alias("disagree"), F.count_if(F.col("uncertainty") > 0.7).alias("uncertain"), F.count_if(F.col("novelty") > 0.7).alias("novel"),
    )


@query("A28_propagation_statistics", with_(FACTS) + "SELECT CAST(floor(confidence * 10) * 10 AS BIGINT) AS decile, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters FROM facts WHERE propagated_from IS NOT NULL AND confidence IS NOT NULL GROUP BY 1")
def a28(spark, d):
    return facts(spark, d).where("propagated_from IS NOT NULL AND confidence IS NOT NULL").groupBy((F.floor(F.col("confidence") * 10) * 10).alias("decile")).agg(rows_n(), F.count_distinct("cluster_id").alias("n_clusters"))


@query("A30_call_summary", "SELECT event_type AS phase, count(*) AS n, round(avg(value), 3) AS mean_time, round(count(*) FILTER (user_id % 10 = 0) / count(*), 3) AS error_rate FROM events GROUP BY 1")
def a30(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(rows_n(), F.round(F.avg("value"), 3).alias("mean_time"), F.round(F.count_if(F.col("user_id") % 10 == 0) / F.count("*"), 3).alias("error_rate"))


@query("A31_call_performance", with_(FACTS) + """, counts AS (SELECT method, llm_label, count(*) AS k FROM facts WHERE llm_label IS NOT NULL GROUP BY 1, 2), top AS (SELECT method, arg_max(llm_label, {'k': k, 'l': llm_label}) AS mode FROM counts GROUP BY 1)
SELECT method, count(*) AS n, round(avg(llm_conf), 4) AS mean_confidence, min(llm_conf) AS lowest, max(llm_conf) AS highest, count(*) FILTER (llm_conf < .5) AS below_5, count(*) FILTER (llm_conf < .3) AS below_3, count(DISTINCT llm_label) AS n_labels, any_value(mode) AS mode FROM facts JOIN top USING (method) GROUP BY method""")
def a31(spark, d):
    rows = facts(spark, d)
    top = rows.where("llm_label IS NOT NULL").groupBy("method", "llm_label").agg(F.count("*").alias("k")).groupBy("method").agg(F.max_by("llm_label", F.struct("k", "llm_label")).alias("mode"))
    c = F.col("llm_conf")
    main = rows.groupBy("method").agg(rows_n(), F.round(F.avg(c), 4).alias("mean_confidence"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.count_if(c < 0.5).alias("below_5"), F.count_if(c < 0.3).alias("below_3"), F.count_distinct("llm_label").alias("n_labels"))
    return main.join(top, "method")


@query("A33_feature_statistics", with_(VECTORS) + ", e AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vectors) SELECT i AS dimension, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS lowest, round(max(x), 4) AS highest, count(*) FILTER (x <> 0) AS n_nonzero FROM e GROUP BY i")
def a33(spark, d):
    rows = vectors(spark, d).select(F.posexplode("v").alias("i", "x"))
    return rows.groupBy((F.col("i") + 1).cast("long").alias("dimension")).agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("std"), F.round(F.min("x"), 4).alias("lowest"), F.round(F.max("x"), 4).alias("highest"), F.count_if(F.col("x") != 0).alias("n_nonzero"))


@query("A34_label_balance", with_(FACTS) + ", c AS (SELECT label, count(*) AS n FROM facts WHERE label <> '' GROUP BY label) SELECT count(*) AS n_labels, arg_max(label, {'n': n, 'l': label}) AS most, arg_min(label, {'n': n, 'l': label}) AS least, round(min(n) / max(n), 4) AS balance FROM c")
def a34(spark, d):
    counts = facts(spark, d).where("label <> ''").groupBy("label").agg(rows_n())
    key = F.struct("n", "label")
    return counts.agg(F.count("*").alias("n_labels"), F.max_by("label", key).alias("most"), F.min_by("label", key).alias("least"), F.round(F.min("n") / F.max("n"), 4).alias("balance"))


@query("A36_cluster_statistics", with_(FACTS) + ", c AS (SELECT cluster_id, count(*) AS n, avg(confidence) AS c FROM facts GROUP BY cluster_id) SELECT count(*) FILTER (cluster_id IS NOT NULL AND cluster_id <> '-1') AS n_clusters, CAST(sum(n) FILTER (cluster_id = '-1') AS BIGINT) AS n_outliers, max(n) FILTER (cluster_id <> '-1') AS largest, min(n) FILTER (cluster_id <> '-1') AS smallest, round(avg(c) FILTER (cluster_id <> '-1'), 4) AS mean_probability FROM c")
def a36(spark, d):
    c = facts(spark, d).groupBy("cluster_id").agg(rows_n(), F.avg("confidence").alias("c"))
    inside = F.col("cluster_id") != "-1"
    return c.agg(F.count_if(inside).alias("n_clusters"), F.sum(F.when(F.col("cluster_id") == "-1", F.col("n"))).alias("n_outliers"), F.max(F.when(inside, F.col("n"))).alias("largest"), F.min(F.when(inside, F.col("n"))).alias("smallest"), F.round(F.avg(F.when(inside, F.col("c"))), 4).alias("mean_probability"))


@query("A37_multi_membership", with_(FACTS) + ", m AS (SELECT user_id, count(DISTINCT cluster_id) AS regions FROM facts WHERE cluster_id IS NOT NULL GROUP BY user_id) SELECT count(*) AS n, count(*) FILTER (regions > 1) AS n_multiple, round(avg(regions), 4) AS mean_regions FROM m")
def a37(spark, d):
    m = facts(spark, d).where("cluster_id IS NOT NULL").groupBy("user_id").agg(F.count_distinct("cluster_id").alias("regions"))
    return m.agg(rows_n(), F.count_if(F.col("regions") > 1).alias("n_multiple"), F.round(F.avg("regions"), 4).alias("mean_regions"))


@query("A39_novelty_statistics", with_(VECTORS) + "SELECT label AS tenant, count(*) AS n, round(count(*) / 10000.0, 6) AS utilisation, round(avg(len(v)), 2) AS mean_dimension FROM vectors GROUP BY label")
def a39(spark, d):
    return vectors(spark, d).groupBy(F.col("label").alias("tenant")).agg(rows_n(), F.round(F.count("*") / 10000, 6).alias("utilisation"), F.round(F.avg(F.size("v")), 2).alias("mean_dimension"))


@query("A41_consolidation_plan", with_(FACTS) + ", rules(source, target) AS (VALUES ('click', 'interaction'), ('view', 'interaction'), ('signup', 'conversion'), ('purchase', 'conversion')) SELECT target, count(*) AS n, count(*) FILTER (source = 'click') AS n_click, count(DISTINCT source) AS n_sources FROM facts JOIN rules ON label = source GROUP BY target")
def a41(spark, d):
    rules = spark.sql("SELECT * FROM VALUES ('click', 'interaction'), ('view', 'interaction'), ('signup', 'conversion'), ('purchase', 'conversion') AS t(source, target)")
    return facts(spark, d).join(rules, F.col("label") == F.col("source")).groupBy("target").agg(rows_n(), F.count_if(F.col("source") == "click").alias("n_click"), F.count_distinct("source").alias("n_sources"))


@query("A44_next_outlier", with_(FACTS) + "SELECT coalesce(max(CAST(regexp_extract(cluster_id, '^outlier_([0-9]+)$', 1) AS BIGINT)) FILTER (regexp_matches(cluster_id, '^outlier_[0-9]+$')), -1) + 1 AS next_number FROM facts WHERE cluster_id LIKE 'outlier%'")
def a44(spark, d):
    number = F.nullif(F.regexp_extract("cluster_id", r"^outlier_(\d+)$", 1), F.lit("")).cast("long")
    return facts(spark, d).agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next_number"))
