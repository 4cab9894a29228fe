"""Queries of the smaller operators: compositions, logs, registries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import labels as L
from sessionloom.operators import clusters as C
from sessionloom.operators.hierarchy import grid_clusters, hierarchical_clusters
from sessionloom.operators.regions import adapt_regions
from sessionloom.plans.oracle import FACTS, MESSAGES, SESSIONS, TAGS, TENANTS, VECTORS, with_
from sessionloom.plans.registry import query
from sessionloom.sources.catalog import facts, messages, table, tags, tenants, vectors
from sessionloom.sources.shared import saved

c = F.col


@query("C5_generic_clusters")
def c5(spark, d):
    return hierarchical_clusters(vectors(spark, d).select(c("vec_id").alias("id"), "v"), min_cluster_size=3, min_samples=2).groupBy("cluster").agg(F.count("*").alias("size"))


@query("C8_sub_clusters")
def c8(spark, d):
    # groups of ten and more are clustered on their own; smaller ones stay whole
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v", "label")
    large = rows.groupBy("label").count().where("count >= 10").select("label")
    found = hierarchical_clusters(rows.join(large, "label", "left_semi"), min_cluster_size=3, min_samples=2, by="label").select("id", "cluster")
    label = c("label").cast("string")
    part = F.when(c("cluster").isNull(), label).when(c("cluster") == -1, F.concat(label, F.lit("_mixed"))).otherwise(F.concat_ws("_sub_", label, c("cluster").cast("string")))
    return rows.select("id", "label").join(found, "id", "left").select("id", part.alias("part"))


@query("T10_refined_regions")
def t10(spark, d):
    rows = facts(spark, d).where("cluster_id IS NOT NULL").select("session_id", "cluster_id", "label")
    return C.refine_regions(rows).groupBy("region").agg(F.count("*").alias("size"))


@query("T10_adapted_regions")
def t10_adapted(spark, d):
    # a quarter of each cluster's vectors is a region to begin with; the log says how they are labelled
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v", F.concat_ws(":", c("label").cast("string"), (c("vec_id") % 4).cast("string")).alias("region"))
    told = facts(spark, d).select(c("session_id").alias("id"), "label", "confidence")
    found = adapt_regions(rows.join(told, "id", "left"))
    return found.select("id", "region", F.round("weight", 4).alias("weight"), F.round("conf", 4).alias("confidence"))


@query("T14_region_tables", with_(FACTS) + "SELECT cluster_id, label, count(*) AS n FROM facts WHERE cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2")
def t14(spark, d):
    from sessionloom.sources.shared import saved

    rows = facts(spark, d).where("cluster_id IS NOT NULL AND label IS NOT NULL")
    return saved(rows.groupBy("cluster_id", "label").agg(F.count("*").alias("n")), "region-labels")


@query("ML5_keyword_bootstrap", "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') THEN 'insult' WHEN contains(lower(text), 'licen') THEN 'licence' END AS label FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'licen')")
def ml5(spark, d):
    low = F.lower("text")
    label = F.when(low.contains("idiot"), "insult").when(low.contains("licen"), "licence")
    return table(spark, d, "documents").select("doc_id", label.alias("label")).where("label IS NOT NULL")


@query("ML12_clustering_search")
def ml12(spark, d):
    # every setting of the grid, read from one spanning tree for each number of samples; one without two clusters scores -1
    grid = [(m, s, e) for m in (3, 5, 8, 10, 15) for s in (1, 2, 3, 5) for e in (0.0, 0.01, 0.05, 0.1)]
    rows = vectors(spark, d).select(c("vec_id").alias("id"), "v")
    placed = saved(grid_clusters(rows, grid).select("run", "id", "cluster"), "grid-clusters")
    settings = spark.createDataFrame([(n, *g) for n, g in enumerate(grid)], "run long, min_cluster_size int, min_samples int, epsilon double")
    sizes = placed.groupBy("run").agg(F.count_distinct(F.when(c("cluster") != -1, c("cluster"))).alias("n_clusters"), F.count_if(c("cluster") == -1).alias("n_outliers"))
    scored = C.silhouettes(placed.join(rows, "id"), "cluster", id_col="id", by="run").groupBy("run").agg(F.avg("silhouette").alias("s"))
    score = F.when(c("n_clusters") > 1, F.round("s", 4)).otherwise(-1.0).alias("silhouette")
    return settings.join(sizes, "run").join(scored, "run", "left").select("min_cluster_size", "min_samples", "epsilon", "n_clusters", "n_outliers", score)


@query("Q8_analysis_mode", with_(FACTS) + "SELECT tenant_id, CASE WHEN count(*) FILTER (method = 'HUMAN_REVIEW') = 0 THEN 'full' WHEN count(*) FILTER (review_status = 'pending') > 50 THEN 'representatives' ELSE 'new_only' END AS mode FROM facts GROUP BY tenant_id")
def q8(spark, d):
    human, pending = F.count_if(c("method") == "HUMAN_REVIEW"), F.count_if(c("review_status") == "pending")
    return facts(spark, d).groupBy("tenant_id").agg(F.when(human == 0, "full").when(pending > 50, "representatives").otherwise("new_only").alias("mode"))


@query("X20_names", with_(TENANTS) + "SELECT tenant_id, lower(regexp_replace(tenant_name, '[ -]', '_', 'g')) || '_' || CAST(tenant_id AS STRING) AS collection FROM tenants")
def x20(spark, d):
    return tenants(spark, d).select("tenant_id", F.concat(F.lower(F.regexp_replace("tenant_name", "[ -]", "_")), F.lit("_"), c("tenant_id").cast("string")).alias("collection"))


@query("SNK11_debug_export", with_(FACTS) + "SELECT method, count(*) AS n FROM facts GROUP BY method")
def snk11(spark, d):
    from sessionloom.sources.shared import fresh_path

    path = fresh_path(spark, "debug")
    facts(spark, d).select("session_id", "method").write.json(path)
    return spark.read.schema("session_id long, method string").json(path).groupBy("method").agg(F.count("*").alias("n"))


@query("SNK13_typed_json", with_(FACTS) + "SELECT session_id, '{\"label\":\"' || label || '\",\"tenant\":' || CAST(tenant_id AS STRING) || '}' AS line FROM facts WHERE label <> ''")
def snk13(spark, d):
    return facts(spark, d).where("label <> ''").select("session_id", F.to_json(F.struct("label", c("tenant_id").alias("tenant"))).alias("line"))


@query("Z5_tag_upsert", with_(TAGS) + "SELECT coalesce(t.tag_id, n.tag_id) AS tag_id, coalesce(n.tag_name, t.tag_name) AS tag_name FROM tags t FULL JOIN (SELECT CAST(n_nationkey AS BIGINT) + 20 AS tag_id, 'renamed' AS tag_name FROM nation WHERE n_nationkey < 8) n USING (tag_id)")
def z5(spark, d):
    from sessionloom.sources.merge import upsert

    new = table(spark, d, "nation").where("n_nationkey < 8").select((c("n_nationkey").cast("long") + 20).alias("tag_id"), F.lit("renamed").alias("tag_name"))
    return upsert(tags(spark, d).select("tag_id", "tag_name"), new, ["tag_id"])


@query("Z9_default_tags", with_(TAGS) + "SELECT tag_name FROM tags UNION ALL SELECT 'altro' WHERE NOT EXISTS (SELECT 1 FROM tags WHERE tag_name = 'altro')")
def z9(spark, d):
    have = tags(spark, d).select("tag_name")
    return have.unionByName(spark.sql("SELECT 'altro' AS tag_name").join(have, "tag_name", "left_anti"))


@query("Z11_tenant_by_slug", with_(TENANTS) + "SELECT tenant_id FROM tenants WHERE is_active AND tenant_slug = 'europe' OR is_active AND tenant_slug = 'asia'")
def z11(spark, d):
    return tenants(spark, d).where("is_active AND tenant_slug IN ('europe', 'asia')").select("tenant_id")


@query("Z12_sync_report", with_(TENANTS) + "SELECT CASE WHEN t.tenant_id IS NULL THEN 'new' WHEN r.id IS NULL THEN 'gone' WHEN t.tenant_name <> r.name THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM tenants t FULL JOIN (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey BETWEEN 2 AND 9) r ON t.tenant_id = r.id GROUP BY 1")
def z12(spark, d):
    remote = table(spark, d, "nation").where("n_nationkey BETWEEN 2 AND 9").select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name"))
    change = F.when(c("tenant_id").isNull(), "new").when(c("id").isNull(), "gone").when(c("tenant_name") != c("name"), "changed").otherwise("same")
    return tenants(spark, d).join(remote, c("tenant_id") == c("id"), "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("Z16_can_train_first", with_(FACTS) + "SELECT tenant_id, count(*) FILTER (method = 'MANUAL') >= 5 AS ready FROM facts GROUP BY tenant_id")
def z16(spark, d):
    return facts(spark, d).groupBy("tenant_id").agg((F.count_if(c("method") == "MANUAL") >= 5).alias("ready"))


@query("Z17_threshold_override", with_(FACTS) + "SELECT session_id FROM facts WHERE uncertainty > .9 OR novelty > .95")
def z17(spark, d):
    from sessionloom.operators.decisions import Gate, gate_reasons

    strict = Gate(confidence=0.0, disagreement=1.0, uncertainty=0.9, novelty=0.95)
    reasons = gate_reasons(F.lit(1.0), F.lit(0.0), c("uncertainty"), c("novelty"), strict)
    return facts(spark, d).where(reasons != "").select("session_id")


@query("Z19_pipeline_report", with_(MESSAGES, SESSIONS) + "SELECT count(*) AS n_sessions, count(*) >= 3 AS enough, count(*) FILTER (full_text = '') AS n_without_text FROM sessions")
def z19(spark, d):
    from sessionloom.operators.sessions import fold_sessions

    return fold_sessions(messages(spark, d)).agg(F.count("*").alias("n_sessions"), (F.count("*") >= 3).alias("enough"), F.count_if(c("full_text") == "").alias("n_without_text"))


@query("Z23_memory_age", with_(FACTS) + "SELECT label, max(ts) >= TIMESTAMP '2024-01-30 00:00:00' AS valid FROM facts WHERE label IS NOT NULL GROUP BY label")
def z23(spark, d):
    return facts(spark, d).where("label IS NOT NULL").groupBy("label").agg(F.expr("max(ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY").alias("valid"))


@query("Z24_context_text", with_(FACTS, TAGS) + "SELECT session_id, text || ' [CATEGORIA: ' || tag_name || coalesce(' - ' || tag_description, '') || ']' AS text FROM facts JOIN tags ON tag_id = session_id % 25")
def z24(spark, d):
    rows = facts(spark, d).withColumn("tag_id", c("session_id") % 25).join(tags(spark, d), "tag_id")
    note = F.concat(F.lit(" [CATEGORIA: "), "tag_name", F.coalesce(F.concat(F.lit(" - "), "tag_description"), F.lit("")), F.lit("]"))
    return rows.select("session_id", F.concat("text", note).alias("text"))


@query("Z27_domain_labels", with_(TAGS) + "SELECT lower(tag_name) AS label, max(coalesce(tag_description, '')) AS description FROM tags WHERE is_active GROUP BY 1")
def z27(spark, d):
    return tags(spark, d).where("is_active").groupBy(L.normalise_plain(c("tag_name")).alias("label")).agg(F.max(F.coalesce("tag_description", F.lit(""))).alias("description"))


@query("Z32_region_info", with_(FACTS) + "SELECT cluster_id, count(*) AS size, count(DISTINCT label) AS n_labels, starts_with(cluster_id, 'outlier_') AS is_outlier FROM facts WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def z32(spark, d):
    return facts(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("label").alias("n_labels"), c("cluster_id").startswith("outlier_").alias("is_outlier"))


@query("Z33_projection")
def z33(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors(spark, d).select("vec_id", array_to_vector("v").alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(F.abs(c("p")[0]), 4).alias("x"), F.round(F.abs(c("p")[1]), 4).alias("y"))


@query("Z35_tag_suggestion", with_(VECTORS) + ", parts AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vectors), means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL), cent AS (SELECT label, list(x ORDER BY i) AS w FROM means GROUP BY label) SELECT vec_id, round(max(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w))), 4) AS best FROM vectors CROSS JOIN cent GROUP BY vec_id")
def z35(spark, d):
    from sessionloom.operators.vectors import centroids, nearest

    asked = vectors(spark, d).select(c("vec_id").alias("query_id"), "v")
    cent = centroids(vectors(spark, d), "label").select(c("label").alias("id"), c("centroid").alias("v"))
    return nearest(asked, cent, 1).select(c("query_id").alias("vec_id"), F.round("similarity", 4).alias("best"))


@query("Z42_supervision_log", with_(FACTS) + "SELECT count(*) AS n FROM facts WHERE method = 'HUMAN_REVIEW'")
def z42(spark, d):
    from sessionloom.sources.jsonl import append_json
    from sessionloom.sources.shared import fresh_path

    path = fresh_path(spark, "supervision")
    rows = facts(spark, d).where("method = 'HUMAN_REVIEW'").select("session_id", "label")
    append_json(rows.where("session_id % 2 = 0"), path)
    append_json(rows.where("session_id % 2 = 1"), path)
    return spark.read.schema("session_id long, label string").json(path).agg(F.count("*").alias("n"))


@query("Z43_vector_statistics", with_(VECTORS) + "SELECT vec_id, round(list_avg(v), 4) AS mean, round(list_max(v), 4) AS highest, round(list_min(v), 4) AS lowest FROM vectors")
def z43(spark, d):
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return vectors(spark, d).select("vec_id", F.round(mean, 4).alias("mean"), F.round(F.array_max("v"), 4).alias("highest"), F.round(F.array_min("v"), 4).alias("lowest"))


@query("Z44_asked_pairs", with_(FACTS) + "SELECT least(ml_label, llm_label) AS a, greatest(ml_label, llm_label) AS b, count(*) AS n FROM facts WHERE ml_label <> llm_label GROUP BY 1, 2")
def z44(spark, d):
    # each pair of labels is asked about once, in either order
    return facts(spark, d).where("ml_label <> llm_label").groupBy(F.least("ml_label", "llm_label").alias("a"), F.greatest("ml_label", "llm_label").alias("b")).agg(F.count("*").alias("n"))


@query("SRC7_decision_log", with_(FACTS) + "SELECT session_id, label AS human_decision FROM facts WHERE method = 'HUMAN_REVIEW' AND label IS NOT NULL")
def src7(spark, d):
    from sessionloom.sources.jsonl import append_json, read_decisions
    from sessionloom.sources.shared import fresh_path

    path = fresh_path(spark, "decisions")
    rows = facts(spark, d).where("method = 'HUMAN_REVIEW'").select(c("session_id").cast("string").alias("session_id"), c("label").alias("human_decision"))
    append_json(rows, path)
    return read_decisions(spark, path).select(c("session_id").cast("long").alias("session_id"), "human_decision")


@query("API13_missing_prompts", with_(TAGS, TENANTS) + "SELECT tenant_id, required FROM tenants CROSS JOIN (SELECT unnest(['nation_0', 'nation_7', 'absent']) AS required) EXCEPT SELECT tenant_id, tag_name FROM tags")
def api13(spark, d):
    required = spark.sql("SELECT explode(array('nation_0', 'nation_7', 'absent')) AS tag_name")
    every = tenants(spark, d).select("tenant_id").crossJoin(F.broadcast(required))  # a fixed list for each tenant
    return every.join(tags(spark, d).select("tenant_id", "tag_name"), ["tenant_id", "tag_name"], "left_anti").select("tenant_id", c("tag_name").alias("required"))



class FirstWordScorer:
    """A scorer for tests: a text's label is its most common longer word."""

    def classify(self, texts):
        out = []
        for text in texts:
            words = [w for w in text.lower().split() if w.isalpha() and len(w) > 3]
            best = max(sorted(set(words)), key=words.count, default="altro")
            out.append((best, 0.9 if words.count(best) > 1 else 0.6, "most common word"))
        return out


@query("API1_classify_all")
def api1(spark, d):
    from sessionloom.engine import Engine

    engine = Engine(FirstWordScorer())
    return engine.classify(engine.sessions(messages(spark, d)))


@query("API3_review_cases")
def api3(spark, d):
    from sessionloom.engine import Engine

    engine = Engine(FirstWordScorer())
    return engine.review_queue(engine.classify(engine.sessions(messages(spark, d)))).select("session_id", "label", "reasons")


@query("SRC6_tenant_scope", with_(FACTS) + "SELECT session_id, label FROM facts WHERE tenant_id = 3")
def src6(spark, d):
    from sessionloom.sources.catalog import for_tenant

    return for_tenant(facts(spark, d), 3).select("session_id", "label")


@query("SNK9_append_decision", with_(FACTS) + "SELECT session_id, label FROM facts WHERE review_status IN ('resolved', 'completed') AND label IS NOT NULL")
def snk9(spark, d):
    from sessionloom.sources.jsonl import append_json
    from sessionloom.sources.shared import fresh_path

    path = fresh_path(spark, "log")
    rows = facts(spark, d).select("session_id", "label", "review_status")
    for status in ("resolved", "completed"):
        append_json(rows.where(c("review_status") == status).select("session_id", "label"), path)
    return spark.read.schema("session_id long, label string").json(path).where("label IS NOT NULL")


@query("SNK12_saved_model")
def snk12(spark, d):
    from pyspark.ml import PipelineModel

    from sessionloom.operators.models import fit_voters, soft_vote
    from sessionloom.sources.shared import fresh_path

    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", c("role").alias("label"))
    path = fresh_path(spark, "model")
    fit_voters(rows.where("conv_id % 4 <> 0"), features=64).write().overwrite().save(path)
    return soft_vote(PipelineModel.load(path), rows.where("conv_id % 4 = 0"), ["conv_id", "turn"]).select("conv_id", "turn", "label")


@query("L2_label_groups")
def l2(spark, d):
    import difflib

    import pandas as pd

    def group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["tag_name"].unique())
        parts = C.linkage_groups(names, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
        return pd.DataFrame({"tenant_id": key[0], "label": names, "part": parts})

    # each tenant's vocabulary apart
    return tags(spark, d).select("tenant_id", "tag_name").groupBy("tenant_id").applyInPandas(group, "tenant_id long, label string, part long")


@query("API2_client_status", with_(FACTS, TENANTS) + "SELECT tenant_name, is_active, count(session_id) AS n, round(avg(confidence), 4) AS mean_confidence, count(CASE WHEN review_status = 'pending' THEN 1 END) AS pending FROM tenants LEFT JOIN facts USING (tenant_id) GROUP BY ALL")
def api2(spark, d):
    by_tenant = facts(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if(c("review_status") == "pending").alias("pending"))
    joined = tenants(spark, d).join(by_tenant, "tenant_id", "left")
    return joined.select("tenant_name", "is_active", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", F.coalesce("pending", F.lit(0)).alias("pending"))


@query("API4_tenant_labels", with_(FACTS) + "SELECT label, method, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM facts WHERE tenant_id = 1 AND label IS NOT NULL GROUP BY GROUPING SETS ((label), (label, method))")
def api4(spark, d):
    from sessionloom.sources.catalog import for_tenant

    for_tenant(facts(spark, d), 1).where("label IS NOT NULL").createOrReplaceTempView("loom_tenant_facts")
    return spark.sql("SELECT label, method, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM loom_tenant_facts GROUP BY GROUPING SETS ((label), (label, method))")


@query("API5_all_sessions", with_(MESSAGES, SESSIONS, FACTS) + "SELECT s.session_id, s.n_messages, CASE WHEN f.review_status = 'pending' THEN 'in_review' WHEN f.review_status = 'auto_classified' THEN 'automatic' WHEN f.review_status IN ('resolved', 'completed') THEN 'reviewed' ELSE 'available' END AS status FROM sessions s LEFT JOIN facts f USING (session_id)")
def api5(spark, d):
    from sessionloom.operators.sessions import fold_sessions

    status = F.when(c("review_status") == "pending", "in_review").when(c("review_status") == "auto_classified", "automatic").when(c("review_status").isin("resolved", "completed"), "reviewed").otherwise("available")
    joined = fold_sessions(messages(spark, d)).select("session_id", "n_messages").join(facts(spark, d).select("session_id", "review_status"), "session_id", "left")
    return joined.select("session_id", "n_messages", status.alias("status"))


@query("API6_available_tags", with_(FACTS, TAGS) + ", u AS (SELECT label, count(*) AS n, round(avg(confidence), 4) AS conf FROM facts WHERE label <> '' GROUP BY 1) SELECT coalesce(label, tag_name) AS tag, coalesce(n, 0) AS n, conf FROM u FULL JOIN (SELECT DISTINCT tag_name FROM tags WHERE is_active) t ON label = tag_name")
def api6(spark, d):
    used = facts(spark, d).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("conf"))
    known = tags(spark, d).where("is_active").select("tag_name").distinct()
    return used.join(known, c("label") == c("tag_name"), "full").select(F.coalesce("label", "tag_name").alias("tag"), F.coalesce("n", F.lit(0)).alias("n"), "conf")


@query("API9_prompt_status", with_(TAGS) + "SELECT tenant_id, count(*) AS n, count(CASE WHEN is_active THEN 1 END) AS active, count(tag_description) AS described FROM tags GROUP BY tenant_id")
def api9(spark, d):
    return tags(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count("tag_description").alias("described"))


@query("API11_example_placeholder", with_(TAGS) + "SELECT tenant_id, 'Esempi:' || chr(10) || string_agg('- ' || tag_name, chr(10) ORDER BY tag_id) AS filled FROM tags WHERE is_active GROUP BY tenant_id")
def api11(spark, d):
    from sessionloom.plans.scalars import render

    lines = tags(spark, d).where("is_active").groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("tag_id", F.concat(F.lit("- "), "tag_name").alias("line")))).alias("x"))
    return lines.select("tenant_id", render(F.lit("Esempi:\n{{examples}}"), {"examples": F.array_join("x.line", "\n")}).alias("filled"))


@query("Z18_training_selection", with_(FACTS) + "SELECT count(*) >= 5 AS enough, count(DISTINCT cluster_id) AS n_clusters, count(*) FILTER (label <> '' AND label <> 'altro') AS n_labelled FROM facts")
def z18(spark, d):
    labelled = (c("label") != "") & (c("label") != "altro")
    return facts(spark, d).agg((F.count("*") >= 5).alias("enough"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_if(labelled).alias("n_labelled"))


@query("T13_tuned_parameters", with_(FACTS) + "SELECT CASE WHEN o > .4 THEN 4 WHEN k < 3 THEN 4 WHEN o < .05 THEN 6 ELSE 5 END AS min_cluster_size FROM (SELECT avg(CASE WHEN cluster_id IS NULL OR cluster_id = '-1' OR starts_with(cluster_id, 'outlier_') THEN 1.0 ELSE 0.0 END) AS o, count(DISTINCT cluster_id) AS k FROM facts)")
def t13(spark, d):
    outlier = c("cluster_id").isNull() | (c("cluster_id") == "-1") | c("cluster_id").startswith("outlier_")
    seen = facts(spark, d).agg(F.avg(outlier.cast("double")).alias("o"), F.count_distinct("cluster_id").alias("k")).first()
    found = C.tuned({"min_cluster_size": 5, "min_samples": 3}, seen["o"], seen["k"])
    return spark.range(1).select(F.lit(found["min_cluster_size"]).alias("min_cluster_size"))
