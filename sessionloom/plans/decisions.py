"""Queries of the ensemble, the gate, the review workflow, semantic memory and label resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import labels as L
from sessionloom.functions import numbers as N
from sessionloom.operators import decisions as D
from sessionloom.operators.semantic_cache import semantic_hits
from sessionloom.operators.vectors import label_similarity, nearest
from sessionloom.plans.oracle import FACTS, TAGS, VECTORS, with_
from sessionloom.plans.registry import query
from sessionloom.sources.catalog import facts, tags, vectors
from sessionloom.sources.shared import saved

c = F.col

COMBINED = """, w AS (SELECT *, 0.6 * CASE WHEN llm_conf > .9 THEN 1.2 ELSE 1 END AS a, 0.4 * CASE WHEN ml_conf > .9 THEN 1.2 ELSE 1 END AS b FROM facts),
e AS (SELECT *, CASE WHEN llm_label IS NULL AND ml_label IS NULL THEN NULL WHEN ml_label IS NULL THEN llm_label WHEN llm_label IS NULL THEN ml_label WHEN llm_label = ml_label THEN llm_label WHEN a * llm_conf / (a + b) > b * ml_conf / (a + b) THEN llm_label ELSE ml_label END AS e_label,
    CASE WHEN llm_label IS NULL AND ml_label IS NULL THEN NULL WHEN ml_label IS NULL THEN llm_conf WHEN llm_label IS NULL THEN ml_conf WHEN llm_label = ml_label THEN (a * llm_conf + b * ml_conf) / (a + b) WHEN a * llm_conf / (a + b) > b * ml_conf / (a + b) THEN llm_conf * .8 ELSE ml_conf * .8 END AS e_conf,
    CASE WHEN llm_label IS NULL AND ml_label IS NULL THEN 'ERROR' WHEN ml_label IS NULL THEN 'LLM_ONLY' WHEN llm_label IS NULL THEN 'ML_ONLY' WHEN llm_label = ml_label THEN 'AGREEMENT' WHEN a * llm_conf / (a + b) > b * ml_conf / (a + b) THEN 'DISAGREEMENT_LLM' ELSE 'DISAGREEMENT_ML' END AS e_method FROM w)
"""
# compared at nine digits, so that equal products in another order don't decide
COMBINED = COMBINED.replace("a * llm_conf / (a + b) > b * ml_conf / (a + b)", "CAST(a / (a + b) * llm_conf AS DOUBLE) > CAST(b / (a + b) * ml_conf AS DOUBLE)")


def combined(spark, d):
    e = D.combine(c("llm_label"), c("llm_conf"), c("ml_label"), c("ml_conf"))
    return facts(spark, d).withColumn("e", e)


@query("E1_weighted_combine", with_(FACTS) + COMBINED + "SELECT session_id, e_label AS label, round(e_conf, 4) AS confidence FROM e")
def e1(spark, d):
    return combined(spark, d).select("session_id", "e.label", F.round("e.confidence", 4).alias("confidence"))


@query("E2_ensemble_prediction", with_(FACTS) + COMBINED + "SELECT session_id, e_method AS method, coalesce(round(e_conf, 6) >= .8, FALSE) AS high_confidence FROM e")
def e2(spark, d):
    return combined(spark, d).select("session_id", "e.method", F.coalesce(F.round("e.confidence", 6) >= 0.8, F.lit(False)).alias("high_confidence"))


@query("E3_batch_prediction", with_(FACTS) + COMBINED + "SELECT session_id // 32 AS batch, count(*) AS n, count(*) FILTER (e_label IS NULL) AS n_fallback, round(avg(coalesce(e_conf, .1)) + 1e-9, 4) AS mean_confidence FROM e GROUP BY 1")
def e3(spark, d):
    rows = combined(spark, d)
    return rows.groupBy(F.floor(c("session_id") / 32).alias("batch")).agg(F.count("*").alias("n"), F.count_if(c("e.label").isNull()).alias("n_fallback"), F.round(F.avg(F.coalesce("e.confidence", F.lit(0.1))) + 1e-9, 4).alias("mean_confidence"))


@query("E4_adaptive_weights", with_(FACTS) + ", acc AS (SELECT avg(CASE WHEN llm_label = label THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN ml_label = label THEN 1.0 ELSE 0 END) AS b FROM facts WHERE label <> '') SELECT round(a / (a + b), 4) AS llm_weight, round(b / (a + b), 4) AS ml_weight FROM acc")
def e4(spark, d):
    hit = lambda side: F.avg(F.when(c(side) == c("label"), 1.0).otherwise(0.0))
    acc = facts(spark, d).where("label <> ''").agg(hit("llm_label").alias("a"), hit("ml_label").alias("b"))
    return acc.select(F.round(c("a") / (c("a") + c("b")), 4).alias("llm_weight"), F.round(c("b") / (c("a") + c("b")), 4).alias("ml_weight"))


@query("E5_llm_only", with_(FACTS) + "SELECT session_id, coalesce(llm_label, 'altro') AS label, coalesce(llm_conf, .1) AS confidence FROM facts")
def e5(spark, d):
    return facts(spark, d).select("session_id", F.coalesce("llm_label", F.lit("altro")).alias("label"), F.coalesce("llm_conf", F.lit(0.1)).alias("confidence"))


SCORED = """, scored AS (SELECT *, CASE WHEN llm_label IS NULL OR ml_label IS NULL THEN 0 WHEN llm_label <> ml_label THEN 1 ELSE 1 - ml_conf END AS disagreement, least(llm_conf, ml_conf) AS low FROM facts),
gated AS (SELECT *, concat_ws('; ', CASE WHEN low < .7 THEN 'low confidence' END, CASE WHEN round(disagreement, 6) > .3 THEN 'disagreement' END, CASE WHEN uncertainty > .5 THEN 'uncertainty' END, CASE WHEN novelty > .8 THEN 'novelty' END) AS reasons FROM scored)
"""


def gated(spark, d):
    p = F.when(c("ml_label").isNotNull(), F.create_map(c("ml_label"), c("ml_conf")))
    scored = facts(spark, d).withColumn("disagreement", D.disagreement(c("llm_label"), c("ml_label"), p))
    reasons = D.gate_reasons(F.least("llm_conf", "ml_conf"), F.round("disagreement", 6), c("uncertainty"), c("novelty"))
    low = F.when(c("llm_conf").isNotNull() & c("ml_conf").isNotNull(), F.least("llm_conf", "ml_conf")).otherwise(F.coalesce("llm_conf", "ml_conf"))
    return scored.withColumn("low", low).withColumn("reasons", reasons)


@query("Q1_disagreement", with_(FACTS) + SCORED + "SELECT session_id, round(disagreement, 4) AS disagreement FROM scored")
def q1(spark, d):
    return gated(spark, d).select("session_id", F.round("disagreement", 4).alias("disagreement"))


@query("Q2_uncertainty", with_(FACTS) + "SELECT session_id, round(CASE WHEN ml_conf IS NULL THEN 0 ELSE list_sum(list_transform(list_filter([ml_conf, 1 - ml_conf], lambda x: x > 0), lambda x: -x * log2(x + 1e-10))) END, 4) AS uncertainty FROM facts")
def q2(spark, d):
    p = F.array("ml_conf", 1 - c("ml_conf"))
    return facts(spark, d).select("session_id", F.round(F.when(c("ml_conf").isNull(), 0.0).otherwise(N.normalised_entropy(p)), 4).alias("uncertainty"))


@query("Q3_novelty_default", with_(FACTS) + "SELECT session_id, CASE WHEN session_id % 10 = 0 THEN .2 ELSE novelty END AS novelty FROM facts")
def q3(spark, d):
    return facts(spark, d).select("session_id", F.coalesce(F.when(c("session_id") % 10 != 0, c("novelty")), F.lit(0.2)).alias("novelty"))


@query("Q4_review_gate", with_(FACTS) + SCORED + "SELECT session_id, reasons <> '' AS needs_review, reasons FROM gated")
def q4(spark, d):
    return gated(spark, d).select("session_id", (c("reasons") != "").alias("needs_review"), "reasons")


@query("Q5_final_decision", with_(FACTS) + SCORED + """SELECT session_id, CASE WHEN reasons <> '' THEN CASE WHEN llm_conf >= ml_conf THEN llm_label ELSE ml_label END ELSE CASE WHEN llm_conf > ml_conf THEN llm_label ELSE ml_label END END AS label,
CASE WHEN reasons <> '' THEN least(llm_conf, ml_conf) ELSE greatest(llm_conf, ml_conf) END AS confidence FROM gated WHERE llm_label IS NOT NULL AND ml_label IS NOT NULL""")
def q5(spark, d):
    decided = D.final_decision(c("reasons") != "", c("llm_label"), c("llm_conf"), c("ml_label"), c("ml_conf"))
    return gated(spark, d).where("llm_label IS NOT NULL AND ml_label IS NOT NULL").select("session_id", decided.alias("x")).select("session_id", "x.*")


@query("Q6_disagreement_metrics", with_(FACTS) + "SELECT session_id, CASE WHEN llm_label = ml_label THEN 'agreement' WHEN llm_label IS NULL OR ml_label IS NULL THEN 'single' ELSE 'disagreement' END AS kind, round(abs(llm_conf - ml_conf), 4) AS gap FROM facts")
def q6(spark, d):
    kind = F.when(c("llm_label") == c("ml_label"), "agreement").when(c("llm_label").isNull() | c("ml_label").isNull(), "single").otherwise("disagreement")
    return facts(spark, d).select("session_id", kind.alias("kind"), F.round(F.abs(c("llm_conf") - c("ml_conf")), 4).alias("gap"))


@query("Q7_pipeline_review", with_(FACTS) + "SELECT session_id, CASE WHEN llm_label <> ml_label AND novelty > .3 THEN printf('disagreement %.2f', novelty) WHEN llm_conf < .7 THEN printf('confidence %.2f', llm_conf) END AS reason FROM facts")
def q7(spark, d):
    reason = D.pipeline_review(F.coalesce(c("llm_label") != c("ml_label"), F.lit(False)), c("novelty"), c("llm_conf"))
    return facts(spark, d).select("session_id", reason.alias("reason"))


@query("Q9_new_only_analysis", with_(FACTS) + SCORED + "SELECT session_id, reasons FROM gated WHERE session_id NOT IN (SELECT session_id FROM facts WHERE review_status IN ('resolved', 'completed'))")
def q9(spark, d):
    done = facts(spark, d).where("review_status IN ('resolved', 'completed')").select("session_id")
    return gated(spark, d).join(done, "session_id", "left_anti").select("session_id", "reasons")


@query("Q10_workflow_stage", with_(FACTS) + "SELECT tenant_id, CASE WHEN count(*) FILTER (review_status = 'pending') > 0 AND count(*) FILTER (review_status = 'auto_classified') > 0 THEN 'both' WHEN count(*) FILTER (review_status = 'pending') > 0 THEN 'reviewing' WHEN count(*) FILTER (review_status = 'auto_classified') > 0 THEN 'pending_save' ELSE 'idle' END AS stage FROM facts GROUP BY tenant_id")
def q10(spark, d):
    p, a = F.count_if(c("review_status") == "pending") > 0, F.count_if(c("review_status") == "auto_classified") > 0
    return facts(spark, d).groupBy("tenant_id").agg(F.when(p & a, "both").when(p, "reviewing").when(a, "pending_save").otherwise("idle").alias("stage"))


@query("Q11_pending_cache", with_(FACTS) + "SELECT session_id, CASE WHEN review_status = 'auto_classified' THEN coalesce(ml_label, label) ELSE label END AS label FROM facts")
def q11(spark, d):
    from sessionloom.sources.merge import upsert

    rows = facts(spark, d)
    cache = rows.where("review_status = 'auto_classified'").select("session_id", c("ml_label").alias("label"))
    return upsert(rows.select("session_id", "label"), cache, ["session_id"])


@query("Q12_retrain_trigger", with_(FACTS) + "SELECT tenant_id, count(*) FILTER (method = 'HUMAN_REVIEW') AS n, count(*) FILTER (method = 'HUMAN_REVIEW') % 5 = 0 AND count(*) FILTER (method = 'HUMAN_REVIEW' AND label <> '' AND label <> 'altro') >= 2 AS retrain FROM facts GROUP BY tenant_id")
def q12(spark, d):
    human = c("method") == "HUMAN_REVIEW"
    valid = F.count_if(human & (c("label") != "") & (c("label") != "altro"))
    return facts(spark, d).groupBy("tenant_id").agg(F.count_if(human).alias("n"), ((F.count_if(human) % 5 == 0) & (valid >= 2)).alias("retrain"))


@query("Q13_catch_all_validation", with_(FACTS) + "SELECT session_id, CASE WHEN llm_conf > .7 AND llm_label = ml_label THEN CASE WHEN ml_conf >= .9 THEN 'reuse' ELSE 'new' END ELSE 'human' END AS action FROM facts WHERE label = 'altro'")
def q13(spark, d):
    agree = F.coalesce((c("llm_conf") > 0.7) & (c("llm_label") == c("ml_label")), F.lit(False))
    return facts(spark, d).where("label = 'altro'").select("session_id", F.when(agree & (c("ml_conf") >= 0.9), "reuse").when(agree, "new").otherwise("human").alias("action"))


@query("Q15_tag_bootstrap", with_(FACTS, TAGS) + ", t AS (SELECT llm_label, count(*) AS n, round(avg(llm_conf), 4) AS conf FROM facts WHERE llm_label IS NOT NULL GROUP BY 1) SELECT llm_label, n, conf >= .85 AS approved FROM t WHERE n >= 3 AND conf >= .4 AND llm_label NOT IN (SELECT tag_name FROM tags) ORDER BY n DESC, llm_label LIMIT 20")
def q15(spark, d):
    topics = facts(spark, d).where("llm_label IS NOT NULL").groupBy("llm_label").agg(F.count("*").alias("n"), F.round(F.avg("llm_conf"), 4).alias("conf")).where("n >= 3 AND conf >= 0.4")
    return topics.join(tags(spark, d).select(c("tag_name").alias("llm_label")), "llm_label", "left_anti").orderBy(F.desc("n"), "llm_label").limit(20).select("llm_label", "n", (c("conf") >= 0.85).alias("approved"))


@query("Q16_new_tags", with_(FACTS, TAGS) + "SELECT DISTINCT label FROM facts WHERE label <> '' AND lower(label) NOT IN (SELECT tag_name FROM tags)")
def q16(spark, d):
    return facts(spark, d).where("label <> ''").select("label").distinct().join(tags(spark, d), F.lower("label") == c("tag_name"), "left_anti")


# -- semantic memory ----------------------------------------------------------------

COS = "list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v)))"
#: Queries: every vector whose id is divisible by 100; memory: all others.
PAIRS = f", pairs AS (SELECT q.vec_id AS query_id, m.vec_id AS id, m.label, {COS} AS s FROM vectors q JOIN vectors m ON q.vec_id % 100 = 0 AND m.vec_id % 100 <> 0)\n"

#: The same with the fifty newest vectors of each label.
HELD = PAIRS.replace("JOIN vectors m ON", "JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM vectors WHERE vec_id % 100 <> 0) WHERE rn <= 50) m ON")


def asked(spark, d):
    return vectors(spark, d).where("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), "v")


def memory(spark, d):
    return vectors(spark, d).where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "id")


@query("N1_similar_labels", with_(VECTORS) + HELD + "SELECT query_id, label, round(.6 * max(s) + .3 * avg(s) + .1 * median(s), 4) AS score FROM pairs GROUP BY query_id, label")
def n1(spark, d):
    return label_similarity(asked(spark, d), memory(spark, d)).select("query_id", "label", F.round("score", 4).alias("score"))


@query("N2_reuse_decision", with_(VECTORS) + HELD + ", scored AS (SELECT query_id, label, round(.6 * max(s) + .3 * avg(s) + .1 * median(s), 6) AS score FROM pairs GROUP BY query_id, label) SELECT query_id, arg_max(label, {'s': score, 'l': -label}) AS label, max(score) >= .5 AS reuse FROM scored GROUP BY query_id")
def n2(spark, d):
    scored = label_similarity(asked(spark, d), memory(spark, d)).withColumn("score", F.round("score", 6))
    return scored.groupBy("query_id").agg(F.max_by("label", F.struct("score", -c("label"))).alias("label"), (F.max("score") >= 0.5).alias("reuse"))


@query("N3_add_capped", with_(VECTORS) + "SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM vectors) WHERE rn <= 20")
def n3(spark, d):
    order = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return vectors(spark, d).withColumn("rn", F.row_number().over(order)).where("rn <= 20").select("label", "vec_id")


@query("N4_novelty", with_(VECTORS) + PAIRS + "SELECT query_id, round(greatest(0, least(1, 1 - max(s))), 4) AS novelty FROM pairs GROUP BY query_id")
def n4(spark, d):
    found = nearest(asked(spark, d), memory(spark, d), 1)
    near = asked(spark, d).select("query_id").join(found, "query_id", "left")
    return near.select("query_id", F.round(F.coalesce(N.clamp(1 - c("similarity")), F.lit(0.0)), 4).alias("novelty"))


@query("N5_nearest_conversations", with_(VECTORS) + PAIRS + "SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rn FROM pairs) WHERE rn <= 5")
def n5(spark, d):
    return nearest(asked(spark, d), memory(spark, d), 5).select("query_id", "id")


@query("S4_similar_labels_top", with_(VECTORS) + HELD + ", scored AS (SELECT query_id, label, round(.6 * max(s) + .3 * avg(s) + .1 * median(s), 6) AS score FROM pairs GROUP BY query_id, label) SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM scored) WHERE rn <= 3")
def s4(spark, d):
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "label")
    return label_similarity(asked(spark, d), memory(spark, d)).withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("query_id", "label")


@query("S5_similar_sessions_top", with_(VECTORS) + PAIRS + "SELECT query_id, id, round(s, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rn FROM pairs) WHERE rn <= 10")
def s5(spark, d):
    return nearest(asked(spark, d), memory(spark, d), 10).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query("V2_batch_cosine", with_(VECTORS) + PAIRS + "SELECT query_id, round(max(s), 4) AS best FROM pairs GROUP BY query_id")
def v2(spark, d):
    return nearest(asked(spark, d), memory(spark, d), 1).select("query_id", F.round("similarity", 4).alias("best"))


@query("J14_similarity_join", with_(VECTORS) + ", parts AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vectors), means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL), cent AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label), s AS (SELECT q.vec_id, m.label AS near, " + COS + " AS s FROM vectors q CROSS JOIN cent m) SELECT vec_id, arg_max(near, {'s': round(s, 9), 'l': -near}) AS nearest FROM s GROUP BY vec_id")
def j14(spark, d):
    from sessionloom.operators.vectors import centroids

    rows = vectors(spark, d)
    cent = centroids(rows, "label").select(c("label").alias("id"), c("centroid").alias("v"))  # one row for each label
    found = nearest(rows.select(c("vec_id").alias("query_id"), "v"), cent, 1)
    return found.select(c("query_id").alias("vec_id"), c("id").alias("nearest"))


@query("N6_memory_load", with_(FACTS) + "SELECT label, session_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, ts DESC, session_id) AS rn FROM facts WHERE method IN ('HUMAN_REVIEW', 'MANUAL') AND confidence >= .5) WHERE rn <= 50")
def n6(spark, d):
    order = Window.partitionBy("label").orderBy(F.desc("confidence"), F.desc("ts"), "session_id")
    return facts(spark, d).where("method IN ('HUMAN_REVIEW', 'MANUAL') AND confidence >= 0.5").withColumn("rn", F.row_number().over(order)).where("rn <= 50").select("label", "session_id")


@query("N7_duplicate_report", with_(FACTS) + "SELECT lower(label) AS label, count(*) AS n, count(DISTINCT label) AS spellings FROM facts WHERE label <> '' GROUP BY 1")
def n7(spark, d):
    return facts(spark, d).where("label <> ''").groupBy(L.normalise_plain(c("label")).alias("label")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("spellings"))


# -- label resolution ---------------------------------------------------------------


@query("L1_dedup_candidates", with_(VECTORS) + PAIRS + "SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rn FROM pairs) WHERE rn <= 5 AND s > .5")
def l1(spark, d):
    return nearest(asked(spark, d), memory(spark, d), 5).where("similarity > 0.5").select("query_id", "id")


@query("L3_ask_about", with_(VECTORS) + PAIRS + "SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rn FROM pairs) WHERE rn <= 2 AND s BETWEEN .3 AND .9")
def l3(spark, d):
    return nearest(asked(spark, d), memory(spark, d), 2).where("similarity BETWEEN 0.3 AND 0.9").select("query_id", "id")


@query("L4_dedup_decision", with_(FACTS) + "SELECT session_id, round(.6 * llm_conf + .4 * ml_conf, 4) AS score, CASE WHEN round(.6 * llm_conf + .4 * ml_conf, 6) >= .85 THEN llm_label ELSE lower(llm_label) || '_new' END AS label FROM facts WHERE llm_conf IS NOT NULL AND ml_conf IS NOT NULL")
def l4(spark, d):
    score = c("llm_conf") * 0.6 + c("ml_conf") * 0.4
    label = F.when(F.round(score, 6) >= 0.85, c("llm_label")).otherwise(F.concat(L.normalise_dedup(c("llm_label")), F.lit("_new")))
    return facts(spark, d).where("llm_conf IS NOT NULL AND ml_conf IS NOT NULL").select("session_id", F.round(score, 4).alias("score"), label.alias("label"))


@query("L5_label_resolution", with_(FACTS) + "SELECT session_id, CASE WHEN llm_label IN ('click', 'view') THEN llm_label WHEN llm_conf >= .9 THEN llm_label WHEN novelty <= .35 THEN ml_label WHEN uncertainty < .2 THEN 'topic' ELSE 'altro' END AS label FROM facts WHERE llm_label IS NOT NULL")
def l5(spark, d):
    direct = F.when(c("llm_label").isin("click", "view"), c("llm_label"))
    created = F.when(c("llm_conf") >= 0.9, c("llm_label"))
    near = c("novelty") <= 0.35
    topic = F.when(c("uncertainty") < 0.2, "topic")
    resolved = F.when(direct.isNotNull(), direct).when(created.isNotNull(), created).when(near, c("ml_label")).otherwise(F.coalesce(topic, F.lit("altro")))
    return facts(spark, d).where("llm_label IS NOT NULL").select("session_id", resolved.alias("label"))


@query("L6_semantic_resolution", with_(FACTS) + "SELECT session_id, round(CASE WHEN session_id % 4 = 0 THEN .6 * llm_conf + .4 * ml_conf ELSE .4 * llm_conf + .3 * ml_conf + .3 * novelty END, 4) AS score FROM facts WHERE llm_conf IS NOT NULL AND ml_conf IS NOT NULL")
def l6(spark, d):
    score = F.when(c("session_id") % 4 == 0, c("llm_conf") * 0.6 + c("ml_conf") * 0.4).otherwise(c("llm_conf") * 0.4 + c("ml_conf") * 0.3 + c("novelty") * 0.3)
    return facts(spark, d).where("llm_conf IS NOT NULL AND ml_conf IS NOT NULL").select("session_id", F.round(score, 4).alias("score"))


@query("L7_example_match", with_(FACTS) + "SELECT cluster_id, label, round(.5 * avg(llm_conf) + .3 * max(llm_conf) + .2 * avg(ml_conf), 4) AS score FROM facts WHERE cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2")
def l7(spark, d):
    rows = facts(spark, d).where("cluster_id IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("cluster_id", "label").agg(F.round(F.avg("llm_conf") * 0.5 + F.max("llm_conf") * 0.3 + F.avg("ml_conf") * 0.2, 4).alias("score"))


@query("L8_embedding_validation", with_(FACTS) + "SELECT session_id, CASE WHEN novelty < .5 AND llm_conf < .8 AND ml_conf - llm_conf > .2 THEN ml_label ELSE llm_label END AS label FROM facts")
def l8(spark, d):
    better = (c("novelty") < 0.5) & (c("llm_conf") < 0.8) & (c("ml_conf") - c("llm_conf") > 0.2)
    return facts(spark, d).select("session_id", F.when(F.coalesce(better, F.lit(False)), c("ml_label")).otherwise(c("llm_label")).alias("label"))


@query("L9_new_category", with_(FACTS) + "SELECT session_id, coalesce(novelty > .7 AND llm_conf < .5, FALSE) AS is_new FROM facts")
def l9(spark, d):
    return facts(spark, d).select("session_id", F.coalesce((c("novelty") > 0.7) & (c("llm_conf") < 0.5), F.lit(False)).alias("is_new"))


@query("L10_topic_fallback", with_(FACTS) + "SELECT session_id, CASE WHEN llm_conf < .3 THEN 'emergent_' || event_topic WHEN llm_conf IS NULL THEN 'altro' ELSE llm_label END AS label FROM (SELECT *, lower(regexp_replace(text, '[^a-zA-Z0-9_]+', '_', 'g')) AS event_topic FROM facts)")
def l10(spark, d):
    topic = F.concat(F.lit("emergent_"), F.lower(F.regexp_replace("text", "[^a-zA-Z0-9_]+", "_")))
    return facts(spark, d).select("session_id", F.when(c("llm_conf") < 0.3, topic).when(c("llm_conf").isNull(), "altro").otherwise(c("llm_label")).alias("label"))


@query("L11_cached_answers", with_(FACTS) + ", cache AS (SELECT text, arg_min(label, {'t': ts, 's': session_id}) AS cached, min(ts) AS since FROM facts WHERE label IS NOT NULL GROUP BY text) SELECT f.session_id, CASE WHEN f.ts - c.since <= INTERVAL 24 HOURS THEN c.cached ELSE f.label END AS label FROM facts f LEFT JOIN cache c ON f.text = c.text")
def l11(spark, d):
    rows = facts(spark, d)
    cache = rows.where("label IS NOT NULL").groupBy("text").agg(F.min_by("label", F.struct("ts", "session_id")).alias("cached"), F.min("ts").alias("since"))
    return rows.join(cache, "text", "left").selectExpr("session_id", "CASE WHEN ts - since <= INTERVAL 24 HOURS THEN cached ELSE label END AS label")


# questions of eight are variants of one: its vector and a little of their own
ASKED = """, base AS (SELECT a.vec_id AS id, list_transform(list_zip(b.v, a.v), lambda z: z[1] + CAST(.2 AS DOUBLE) * z[2]) AS v FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id - a.vec_id % 8),
asked AS (SELECT f.session_id AS id, f.tenant_id % 2 AS g, f.ts, f.text, f.label, v FROM facts f JOIN base ON base.id = f.session_id),
exact AS (SELECT q.id, arg_min(m.label, {'t': m.ts, 'i': m.id}) AS label FROM asked q JOIN asked m ON q.text = m.text AND q.g = m.g AND m.label IS NOT NULL AND (m.ts < q.ts OR m.ts = q.ts AND m.id < q.id) AND q.ts - m.ts < INTERVAL 24 HOURS GROUP BY q.id),
near AS (SELECT q.id, arg_min(m.label, {'t': m.ts, 'i': m.id}) AS label FROM asked q JOIN asked m ON q.g = m.g AND m.label IS NOT NULL AND (m.ts < q.ts OR m.ts = q.ts AND m.id < q.id) AND q.ts - m.ts < INTERVAL 24 HOURS
         AND round(list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v))), 9) > .95 GROUP BY q.id)
"""


@query("L11_semantic_cache", with_(FACTS, VECTORS) + ASKED + "SELECT a.id AS session_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN n.id IS NOT NULL THEN 'semantic' ELSE 'none' END AS hit, CASE WHEN e.id IS NOT NULL THEN e.label WHEN n.id IS NOT NULL THEN n.label ELSE a.label END AS label FROM asked a LEFT JOIN exact e ON e.id = a.id LEFT JOIN near n ON n.id = a.id")
def l11_semantic(spark, d):
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v")
    first = rows.select(c("id").alias("first"), c("v").alias("w"))
    own = rows.join(first, c("first") == c("id") - c("id") % 8).select("id", F.zip_with("w", "v", lambda a, b: a + F.lit(0.2) * b).alias("v"))
    told = facts(spark, d).select(c("session_id").alias("id"), (c("tenant_id") % 2).alias("g"), "ts", "text", "label").join(own, "id")
    asked = saved(told.withColumn("at", F.unix_micros(c("ts").cast("timestamp")) / F.lit(1e6)), "asked")
    known = asked.where("label is not null")
    # equal texts first: the first answer of the last 24 hours
    key = lambda rows: rows.select(F.xxhash64("g", "text").alias("g"), "id", "at", F.array(F.lit(1.0)).alias("v"))
    exact = semantic_hits(key(asked), key(known)).select("id", c("hit").alias("e"))
    near = semantic_hits(asked.select("g", "id", "at", "v"), known.select("g", "id", "at", "v")).select("id", c("hit").alias("n"))
    found = asked.join(exact, "id", "left").join(near, "id", "left").select("id", c("label").alias("own"), "e", "n", F.coalesce("e", "n").alias("h"))
    answers = known.select(c("id").alias("h"), "label")
    kind = F.when(c("e").isNotNull(), "exact").when(c("n").isNotNull(), "semantic").otherwise("none")
    return found.join(answers, "h", "left").select(c("id").alias("session_id"), kind.alias("hit"), F.when(c("h").isNull(), c("own")).otherwise(c("label")).alias("label"))
