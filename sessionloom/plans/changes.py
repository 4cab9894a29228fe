"""Queries of upserts, deletions and lookups: the tables they leave behind, and the small dimension operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.plans.oracle import FACTS, TAGS, TENANTS, with_
from sessionloom.plans.registry import query
from sessionloom.sources import merge as M
from sessionloom.sources.catalog import facts, table, tags, tenants

c = F.col

BASE = "SELECT session_id, tenant_id, label, round(confidence, 6) AS confidence, review_status FROM facts"


def base(spark, d):
    return facts(spark, d).select("session_id", "tenant_id", "label", F.round("confidence", 6).alias("confidence"), "review_status")


SNK1_SQL = with_(FACTS) + f", base AS ({BASE} WHERE session_id % 3 <> 0), batch AS ({BASE} WHERE session_id % 2 = 0) SELECT coalesce(b.session_id, n.session_id) AS session_id, coalesce(b.tenant_id, n.tenant_id) AS tenant_id, coalesce(upper(n.label), b.label) AS label, coalesce(n.confidence, b.confidence) AS confidence, coalesce(b.review_status, n.review_status) AS review_status FROM base b FULL JOIN batch n ON b.session_id = n.session_id AND b.tenant_id = n.tenant_id"


@query("SNK1_upsert_classification", SNK1_SQL)
def snk1(spark, d):
    batch = base(spark, d).where("session_id % 2 = 0").withColumn("label", F.upper("label"))
    return M.upsert(base(spark, d).where("session_id % 3 <> 0"), batch, ["session_id", "tenant_id"], keep=("review_status",))


@query("SNK1_upsert_by_bucket", SNK1_SQL)
def snk1_buckets(spark, d):
    # the same change of a table in buckets, of which only those of the batch are read and written
    from sessionloom.sources import buckets as B
    from sessionloom.sources.shared import fresh_path

    keys, path, old = ["session_id", "tenant_id"], fresh_path(spark, "upserts"), base(spark, d).where("session_id % 3 <> 0")
    B.create_buckets(old, path, keys)
    B.upsert_buckets(base(spark, d).where("session_id % 2 = 0").withColumn("label", F.upper("label")), path, old.schema, keys, keep=("review_status",))
    return B.read_buckets(spark, path, old.schema)


@query("SNK2_upsert_by_session", with_(FACTS) + f", base AS ({BASE} WHERE session_id % 3 <> 1), batch AS (SELECT session_id, 'fixed' AS label FROM facts WHERE session_id % 5 = 0) SELECT coalesce(b.session_id, n.session_id) AS session_id, b.tenant_id, coalesce(n.label, b.label) AS label, b.confidence, b.review_status FROM base b FULL JOIN batch n USING (session_id)")
def snk2(spark, d):
    batch = facts(spark, d).where("session_id % 5 = 0").select("session_id", F.lit("fixed").alias("label"))
    return M.upsert(base(spark, d).where("session_id % 3 <> 1"), batch, ["session_id"])


@query("SNK3_upsert_by_tag", with_(FACTS, TAGS) + ", base AS (SELECT session_id, session_id % 25 AS tag_id, round(confidence, 6) AS confidence FROM facts WHERE session_id % 4 <> 0), batch AS (SELECT f.session_id, t.tag_id, .5 AS confidence FROM facts f JOIN tags t ON t.tag_id = f.session_id % 20 WHERE t.is_active AND f.session_id % 2 = 0) SELECT coalesce(b.session_id, n.session_id) AS session_id, coalesce(b.tag_id, n.tag_id) AS tag_id, coalesce(n.confidence, b.confidence) AS confidence FROM base b FULL JOIN batch n ON b.session_id = n.session_id AND b.tag_id = n.tag_id")
def snk3(spark, d):
    old = facts(spark, d).where("session_id % 4 <> 0").select("session_id", (c("session_id") % 25).alias("tag_id"), F.round("confidence", 6).alias("confidence"))
    named = facts(spark, d).where("session_id % 2 = 0").withColumn("tag_id", c("session_id") % 20).join(tags(spark, d).where("is_active").select("tag_id"), "tag_id")
    return M.upsert(old, named.select("session_id", "tag_id", F.lit(0.5).alias("confidence")), ["session_id", "tag_id"])


@query("SNK4_insert_if_absent", with_(FACTS, TAGS) + ", new AS (SELECT DISTINCT tenant_id, upper(label) AS tag_name FROM facts WHERE label <> '' UNION SELECT 0, 'NATION_0' UNION SELECT 0, 'nation_0') SELECT tenant_id, tag_name FROM tags UNION ALL SELECT tenant_id, min(tag_name) FROM new n WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.tenant_id = n.tenant_id AND t.tag_name = lower(n.tag_name)) GROUP BY tenant_id, lower(tag_name)")
def snk4(spark, d):
    new = facts(spark, d).where("label <> ''").select("tenant_id", F.upper("label").alias("tag_name")).union(spark.sql("SELECT 0L, explode(array('NATION_0', 'nation_0'))"))
    return M.insert_if_absent(tags(spark, d).select("tenant_id", "tag_name"), new, [c("tenant_id"), F.lower("tag_name")], ["tenant_id", "tag_name"])


@query("SNK5_tenant_sync", with_(TENANTS) + ", remote AS (SELECT CAST(n_nationkey AS BIGINT) AS tenant_id, n_name AS tenant_name, n_nationkey % 2 = 1 AS is_active FROM nation WHERE n_nationkey BETWEEN 3 AND 8) SELECT coalesce(t.tenant_id, r.tenant_id) AS tenant_id, coalesce(r.tenant_name, t.tenant_name) AS tenant_name, coalesce(r.is_active, t.is_active) AS is_active FROM tenants t FULL JOIN remote r USING (tenant_id)")
def snk5(spark, d):
    remote = table(spark, d, "nation").where("n_nationkey BETWEEN 3 AND 8").select(c("n_nationkey").cast("long").alias("tenant_id"), c("n_name").alias("tenant_name"), (c("n_nationkey") % 2 == 1).alias("is_active"))
    return M.upsert(tenants(spark, d).drop("tenant_slug"), remote, ["tenant_id"])


@query("SNK6_delete_tenant", with_(FACTS) + "SELECT count(*) AS n_left, (SELECT count(*) FROM facts WHERE tenant_id = 2) AS n_deleted FROM facts WHERE tenant_id <> 2")
def snk6(spark, d):
    left, gone = M.delete_where(facts(spark, d), c("tenant_id") == 2)
    return left.agg(F.count("*").alias("n_left")).crossJoin(gone)  # one row each


@query("SNK7_mark_for_review", with_(FACTS) + f", base AS ({BASE} WHERE session_id % 3 <> 0), ids AS (SELECT event_id AS session_id FROM events WHERE event_id % 10 = 0) SELECT coalesce(b.session_id, i.session_id) AS session_id, b.tenant_id, b.label, b.confidence, CASE WHEN i.session_id IS NULL THEN b.review_status ELSE 'pending' END AS review_status FROM base b FULL JOIN ids i USING (session_id)")
def snk7(spark, d):
    marks = table(spark, d, "events").where("event_id % 10 = 0").select(c("event_id").alias("session_id"), F.lit("pending").alias("review_status"))
    return M.upsert(base(spark, d).where("session_id % 3 <> 0"), marks, ["session_id"])


@query("SNK8_resolve_review", with_(FACTS) + f", base AS ({BASE}) SELECT session_id, tenant_id, CASE WHEN review_status = 'pending' AND session_id % 2 = 0 THEN 'human' ELSE label END AS label, CASE WHEN review_status = 'pending' AND session_id % 2 = 0 THEN greatest(.9, coalesce(confidence, 0)) ELSE confidence END AS confidence, CASE WHEN review_status = 'pending' AND session_id % 2 = 0 THEN 'completed' ELSE review_status END AS review_status FROM base")
def snk8(spark, d):
    rows = base(spark, d)
    decisions = rows.where("session_id % 2 = 0").select("session_id", F.lit("human").alias("label"), F.greatest(F.lit(0.9), F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.lit("completed").alias("review_status"))
    return M.upsert(rows, decisions, ["session_id"], only=c("b.review_status") == "pending")


@query("SNK10_chat_training_lines", with_(FACTS) + """SELECT session_id, '{"messages":[{"role":"user","content":"' || left(text, 500) || '"},{"role":"assistant","content":"' || label || '"}]}' AS line FROM facts WHERE label <> '' AND length(text) >= 10""")
def snk10(spark, d):
    from sessionloom.sources.jsonl import chat_lines

    rows = facts(spark, d).where("label <> '' AND length(text) >= 10")
    return rows.select("session_id", chat_lines(F.left("text", F.lit(500)), c("label")).alias("line"))


@query("SNK14_table_copy", with_(FACTS) + "SELECT tenant_id, count(*) AS n FROM facts GROUP BY tenant_id")
def snk14(spark, d):
    from sessionloom.sources.shared import saved

    return saved(facts(spark, d).select("session_id", "tenant_id"), "backup").groupBy("tenant_id").agg(F.count("*").alias("n"))


# -- small dimension operators ------------------------------------------------------


@query("Z1_tenant_resolve", with_(TENANTS) + ", asked(name) AS (VALUES ('asia'), ('AFRICA'), ('Middle East'), ('europe'), ('nowhere')) SELECT name, (SELECT tenant_id FROM tenants WHERE is_active AND (tenant_name = name OR tenant_slug = name OR lower(tenant_name) = lower(name)) ORDER BY (tenant_name = name OR tenant_slug = name) DESC, tenant_id LIMIT 1) AS tenant_id FROM asked")
def z1(spark, d):
    asked = spark.sql("SELECT explode(array('asia', 'AFRICA', 'Middle East', 'europe', 'nowhere')) AS name")
    # by name or slug as they are, or else by name in lower case
    pair = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
    known = tenants(spark, d).where("is_active").select("tenant_id", F.inline(F.array(pair(c("tenant_name"), 1), pair(c("tenant_slug"), 1), pair(F.lower("tenant_name"), 2))))
    met = asked.select("name", F.inline(F.array(pair(c("name"), 1), pair(F.lower("name"), 2)))).join(known, ["key", "kind"], "left")
    return met.groupBy("name").agg(F.min_by("tenant_id", F.when(c("tenant_id").isNotNull(), F.struct("kind", "tenant_id"))).alias("tenant_id"))


@query("Z2_tenant_reference", with_(TENANTS) + ", asked(name) AS (VALUES ('0b1c2d3e-1111-2222-3333-444455556666'), ('ASIA'), ('short-id')) SELECT name, CASE WHEN length(name) > 20 AND contains(name, '-') THEN name ELSE (SELECT CAST(tenant_id AS STRING) FROM tenants WHERE tenant_name = name) END AS ref FROM asked")
def z2(spark, d):
    asked = spark.sql("SELECT explode(array('0b1c2d3e-1111-2222-3333-444455556666', 'ASIA', 'short-id')) AS name")
    met = asked.join(tenants(spark, d), c("tenant_name") == c("name"), "left")
    return met.select("name", F.when((F.length("name") > 20) & c("name").contains("-"), c("name")).otherwise(c("tenant_id").cast("string")).alias("ref"))


@query("Z3_tenant_info", with_(TENANTS) + "SELECT * FROM tenants WHERE tenant_id = 2")
def z3(spark, d):
    return tenants(spark, d).where("tenant_id = 2")


@query("Z4_active_tenants", with_(TENANTS) + "SELECT tenant_id, upper(left(tenant_slug, 1)) || substr(tenant_slug, 2) AS title FROM tenants WHERE is_active")
def z4(spark, d):
    return tenants(spark, d).where("is_active").select("tenant_id", F.initcap(F.replace("tenant_slug", F.lit("_"), F.lit("_"))).alias("title")).orderBy("title")


@query("Z6_slug_lookup", with_(FACTS, TENANTS) + "SELECT tenant_slug, count(*) AS n FROM facts JOIN tenants USING (tenant_id) GROUP BY 1")
def z6(spark, d):
    return facts(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n")).join(tenants(spark, d), "tenant_id").select("tenant_slug", "n")


@query("Z7_tag_reactivation", with_(TAGS) + ", new(tenant_id, tag_name, tag_description) AS (SELECT CAST(n_regionkey AS BIGINT), upper(n_name), 'again' FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 9, 'FRESH', 'made') SELECT coalesce(t.tenant_id, n.tenant_id) AS tenant_id, coalesce(t.tag_name, lower(n.tag_name)) AS tag_name, CASE WHEN t.is_active THEN t.tag_description ELSE coalesce(n.tag_description, t.tag_description) END AS tag_description, coalesce(t.is_active, FALSE) OR n.tag_name IS NOT NULL AS is_active FROM tags t FULL JOIN new n ON t.tenant_id = n.tenant_id AND t.tag_name = lower(n.tag_name)")
def z7(spark, d):
    new = table(spark, d, "nation").where("n_nationkey % 3 = 2").select(c("n_regionkey").cast("long").alias("tenant_id"), F.upper("n_name").alias("tag_name"), F.lit("again").alias("tag_description")).union(spark.sql("SELECT 9L, 'FRESH', 'made'"))
    batch = new.select("tenant_id", F.lower("tag_name").alias("tag_name"), "tag_description", F.lit(True).alias("is_active"))
    # an active match stays as it is, an inactive one is set active with the new description
    return M.upsert(tags(spark, d).drop("tag_id"), batch, ["tenant_id", "tag_name"], only=~c("b.is_active"))


@query("Z8_all_tags", with_(TAGS) + "SELECT tag_id, tag_name FROM tags WHERE is_active")
def z8(spark, d):
    return tags(spark, d).where("is_active").select("tag_id", "tag_name").orderBy("tag_name")


@query("Z10_table_exists", "SELECT TRUE AS there")
def z10(spark, d):
    tags(spark, d).createOrReplaceTempView("loom_tags")
    return spark.range(1).select(F.lit(spark.catalog.tableExists("loom_tags")).alias("there"))


@query("Z13_manual_queue", with_(FACTS) + "SELECT session_id, CAST(.5 AS DOUBLE) AS uncertainty, CAST(.3 AS DOUBLE) AS novelty, '-1' AS cluster_id FROM facts WHERE session_id IN (3, 5, 8)")
def z13(spark, d):
    return facts(spark, d).where("session_id IN (3, 5, 8)").select("session_id", F.lit(0.5).alias("uncertainty"), F.lit(0.3).alias("novelty"), F.lit("-1").alias("cluster_id"))


@query("Z14_human_to_fact", with_(FACTS) + "SELECT session_id, CASE WHEN toxic IS NOT NULL THEN CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END ELSE label END AS label, CASE WHEN toxic IS NOT NULL THEN 'HUMAN_REVIEW' ELSE method END AS method FROM facts LEFT JOIN labels ON doc_id = session_id")
def z14(spark, d):
    human = table(spark, d, "labels").where("toxic IS NOT NULL").select(c("doc_id").alias("session_id"), F.when(c("toxic") == 1, "toxic").otherwise("clean").alias("label"), F.lit("HUMAN_REVIEW").alias("method"))
    rows = facts(spark, d).select("session_id", "label", "method")
    return M.upsert(rows, human.join(rows, "session_id", "left_semi"), ["session_id"])


@query("Z20_given_sessions", with_(FACTS) + "SELECT session_id, coalesce(llm_conf < .7, TRUE) AS review FROM facts WHERE session_id IN (SELECT item_id FROM benchmark)")
def z20(spark, d):
    ids = table(spark, d, "benchmark").select(c("item_id").alias("session_id"))
    return facts(spark, d).join(ids, "session_id", "left_semi").select("session_id", F.coalesce(c("llm_conf") < 0.7, F.lit(True)).alias("review"))


@query("Z21_normalised_weights", "SELECT round(llm / (llm + ml), 4) AS llm, round(ml / (llm + ml), 4) AS ml FROM (SELECT .9 AS llm, .3 AS ml)")
def z21(spark, d):
    return spark.sql("SELECT CAST(.9 AS DOUBLE) AS a, CAST(.3 AS DOUBLE) AS b").select(F.round(c("a") / (c("a") + c("b")), 4).alias("llm"), F.round(c("b") / (c("a") + c("b")), 4).alias("ml"))


@query("Z22_latest_model", with_(TAGS) + "SELECT tenant_id, max('model_' || tag_name) AS model FROM tags GROUP BY tenant_id")
def z22(spark, d):
    return tags(spark, d).groupBy("tenant_id").agg(F.max(F.concat(F.lit("model_"), "tag_name")).alias("model"))


@query("Z25_example_merge", with_(FACTS) + ", curated AS (SELECT 'click' AS label, 'curated click' AS text UNION ALL SELECT 'view', 'curated view'), real AS (SELECT label, arg_max(text, {'c': confidence, 's': -session_id}) AS text FROM facts WHERE label <> '' AND confidence IS NOT NULL GROUP BY label) SELECT label, text, 'curated' AS source FROM curated UNION ALL SELECT label, text, 'real' FROM real WHERE label NOT IN (SELECT label FROM curated)")
def z25(spark, d):
    curated = spark.sql("SELECT * FROM VALUES ('click', 'curated click'), ('view', 'curated view') AS t(label, text)")
    real = facts(spark, d).where("label <> '' AND confidence IS NOT NULL").groupBy("label").agg(F.max_by("text", F.struct("confidence", -c("session_id"))).alias("text"))
    return curated.withColumn("source", F.lit("curated")).unionByName(real.join(curated, "label", "left_anti").withColumn("source", F.lit("real")))


@query("Z26_label_list", with_(TAGS) + "SELECT tenant_id, string_agg(tag_name, '|' ORDER BY tag_name) AS labels FROM tags WHERE is_active GROUP BY tenant_id")
def z26(spark, d):
    # a tenant's tags are a vocabulary of bounded size
    return tags(spark, d).where("is_active").groupBy("tenant_id").agg(F.array_join(F.array_sort(F.collect_list("tag_name")), "|").alias("labels"))


@query("Z28_health", "SELECT event_type AS phase, round(avg(value), 4) AS mean_time, CASE WHEN count(*) FILTER (user_id % 8 = 0) / count(*) > .1 THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY 1")
def z28(spark, d):
    rate = F.count_if(c("user_id") % 8 == 0) / F.count("*")
    return table(spark, d, "events").groupBy(c("event_type").alias("phase")).agg(F.round(F.avg("value"), 4).alias("mean_time"), F.when(rate > 0.1, "degraded").otherwise("healthy").alias("health"))


@query("Z29_tag_descriptions", with_(TAGS) + "SELECT tag_id, coalesce(tag_description, 'Conversazioni su ' || tag_name) AS description FROM tags")
def z29(spark, d):
    return tags(spark, d).select("tag_id", F.coalesce("tag_description", F.concat(F.lit("Conversazioni su "), "tag_name")).alias("description"))


@query("Z30_balanced_examples", with_(FACTS) + "SELECT session_id, label FROM (SELECT session_id, label, row_number() OVER (PARTITION BY label ORDER BY session_id) AS rn FROM facts WHERE label <> '') WHERE rn <= 3 ORDER BY session_id LIMIT 15")
def z30(spark, d):
    order = Window.partitionBy("label").orderBy("session_id")
    return facts(spark, d).where("label <> ''").withColumn("rn", F.row_number().over(order)).where("rn <= 3").orderBy("session_id").limit(15).select("session_id", "label")


@query("Z36_first_run", with_(FACTS, TAGS) + "SELECT tenant_id, NOT EXISTS (SELECT 1 FROM tags t WHERE t.tenant_id = f.tenant_id AND t.is_active) AS first_run FROM facts f GROUP BY tenant_id")
def z36(spark, d):
    active = tags(spark, d).where("is_active").select("tenant_id").distinct().withColumn("has", F.lit(True))
    return facts(spark, d).select("tenant_id").distinct().join(active, "tenant_id", "left").select("tenant_id", c("has").isNull().alias("first_run"))


@query("Z38_update_with_history", with_(TAGS) + "SELECT tag_id, tag_description AS old, 'new ' || tag_name AS description FROM tags WHERE tag_id % 5 = 0")
def z38(spark, d):
    new = tags(spark, d).where("tag_id % 5 = 0").select("tag_id", F.concat(F.lit("new "), "tag_name").alias("description"))
    return tags(spark, d).select("tag_id", c("tag_description").alias("old")).join(new, "tag_id")


@query("Z39_prompt_list", with_(TAGS) + "SELECT tenant_id, tag_name, left(tag_description, 100) AS preview FROM tags")
def z39(spark, d):
    return tags(spark, d).select("tenant_id", "tag_name", F.left("tag_description", F.lit(100)).alias("preview")).orderBy("tenant_id", "tag_name", "preview")


@query("Z40_tool_array", with_(TAGS) + "SELECT tag_id, '[\"a\",\"t' || CAST(tag_id AS STRING) || '\"]' AS tools FROM tags")
def z40(spark, d):
    before = F.from_json(F.lit('["a","b"]'), "array<string>")
    after = F.concat(F.filter(before, lambda x: x != "b"), F.array(F.concat(F.lit("t"), c("tag_id").cast("string"))))
    return tags(spark, d).select("tag_id", F.to_json(after).alias("tools"))


@query("Z41_copy_from_template", with_(TAGS) + "SELECT 4 AS tenant_id, coalesce(o.tag_name, t.tag_name) AS tag_name, coalesce(t.tag_description, o.tag_description) AS tag_description FROM (SELECT * FROM tags WHERE tenant_id = 4) o FULL JOIN (SELECT tag_name, tag_description FROM tags WHERE tenant_id = 0) t USING (tag_name)")
def z41(spark, d):
    rows = tags(spark, d).select("tenant_id", "tag_name", "tag_description")
    return M.upsert(rows.where("tenant_id = 4"), rows.where("tenant_id = 0").withColumn("tenant_id", F.lit(4).cast("long")), ["tenant_id", "tag_name"]).withColumn("tenant_id", c("tenant_id").cast("int"))


@query("Z45_decision_history", with_(FACTS) + "SELECT session_id FROM facts WHERE method = 'HUMAN_REVIEW' ORDER BY ts DESC, session_id DESC LIMIT 1000")
def z45(spark, d):
    return facts(spark, d).where("method = 'HUMAN_REVIEW'").orderBy(F.desc("ts"), F.desc("session_id")).limit(1000).select("session_id")
