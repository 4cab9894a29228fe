"""Queries over messages and sessions, and the filters, joins, windows, sorts and set operations of the classification log."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.operators import sessions as S
from sessionloom.plans.oracle import FACTS, MESSAGES, SESSIONS, TAGS, TENANTS, with_
from sessionloom.plans.registry import query
from sessionloom.sources.catalog import facts, messages, table, tags, tenants

# -- scans and sessions -------------------------------------------------------------

SCAN = "SELECT session_id, position, said_by, message FROM messages"


@query("SRC2_message_scan", with_(MESSAGES) + SCAN + " WHERE said_by IN ('USER', 'AGENT')")
def src2(spark, d):
    return S.speaker_messages(messages(spark, d)).orderBy("session_id", "position", "said_by")


@query("SRC3_one_session", with_(MESSAGES) + SCAN + " WHERE session_id = 7")
def src3(spark, d):
    return messages(spark, d).where("session_id = 7").orderBy("position")


@query("SRC4_period_scan", "SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 00:00:00' AND props IS NOT NULL AND props <> ''")
def src4(spark, d):
    start, end = F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-07 00:00:00").cast("timestamp")
    return table(spark, d, "events").where(F.col("ts").cast("timestamp").between(start, end) & F.col("props").isNotNull() & (F.col("props") != "")).select("event_id", "user_id", "event_type", "value")


@query("SRC5_top_sessions", with_(MESSAGES) + SCAN + " WHERE session_id IN (SELECT DISTINCT session_id FROM messages ORDER BY session_id LIMIT 20)")
def src5(spark, d):
    return S.top_sessions(messages(spark, d), 20)


@query("SRC8_count_lines", "SELECT count(*) AS n_lines FROM documents WHERE trim(text) <> ''")
def src8(spark, d):
    return table(spark, d, "documents").where("trim(text) <> ''").agg(F.count("*").alias("n_lines"))


@query("A1_session_fold", with_(MESSAGES, SESSIONS) + "SELECT session_id, n_messages, n_user, n_agent, first_position, last_position, full_text FROM sessions")
def a1(spark, d):
    return S.fold_sessions(messages(spark, d)).drop("messages")


TRIVIAL = ", lengths AS (SELECT session_id, avg(length(message)) AS mean_length FROM messages WHERE said_by IN ('USER', 'AGENT') GROUP BY session_id)\n"
#: With words of the test data, as its language is invented.
GREETING, WELCOME = r"(?i)^\s*(the|of)\b.*$", r"(?i)(th|er)"


@query("F10_drop_trivial_sessions", with_(MESSAGES, SESSIONS) + TRIVIAL + """
SELECT s.session_id, n_messages FROM sessions s JOIN lengths USING (session_id)
WHERE NOT (mean_length < 40 AND n_messages < 5)
AND NOT (n_messages < 3 AND n_user = 1 AND n_agent <= 1
    AND EXISTS (SELECT 1 FROM ranked r WHERE r.session_id = s.session_id AND said_by = 'USER' AND regexp_matches(message, '^\\s*(the|of)\\b.*$', 'i'))
    AND EXISTS (SELECT 1 FROM ranked r WHERE r.session_id = s.session_id AND said_by = 'AGENT' AND regexp_matches(message, '(th|er)', 'i')))
""")
def f10(spark, d):
    return S.drop_trivial_sessions(S.fold_sessions(messages(spark, d)), GREETING, WELCOME, short=40).select("session_id", "n_messages")


@query("A2_session_statistics", with_(MESSAGES, SESSIONS) + """
, m AS (SELECT n_messages v, row_number() OVER (ORDER BY n_messages) r, count(*) OVER () n FROM sessions),
l AS (SELECT CAST(length(full_text) AS BIGINT) v, row_number() OVER (ORDER BY length(full_text)) r, count(*) OVER () n FROM sessions)
SELECT count(*) AS n_sessions, round(avg(n_messages), 4) AS mean_messages, min(n_messages) AS min_messages, max(n_messages) AS max_messages,
    round(avg(length(full_text)), 4) AS mean_length, CAST(min(length(full_text)) AS BIGINT) AS min_length, CAST(max(length(full_text)) AS BIGINT) AS max_length,
    round(avg(n_user), 4) AS mean_user, CAST(sum(n_user) AS BIGINT) AS total_user, round(avg(n_agent), 4) AS mean_agent, CAST(sum(n_agent) AS BIGINT) AS total_agent,
    (SELECT v FROM m WHERE r = n // 2 + 1) AS median_messages, (SELECT v FROM l WHERE r = n // 2 + 1) AS median_length
FROM sessions
""")
def a2(spark, d):
    return S.session_statistics(S.fold_sessions(messages(spark, d)))


@query("F1_speaker_filter", with_(MESSAGES) + "SELECT said_by, count(*) AS n FROM messages WHERE said_by IN ('USER', 'AGENT') GROUP BY said_by")
def f1(spark, d):
    return S.speaker_messages(messages(spark, d)).groupBy("said_by").agg(F.count("*").alias("n"))


@query("F11_engaged_sessions", with_(MESSAGES, SESSIONS) + "SELECT session_id, n_user FROM sessions WHERE n_user > 1")
def f11(spark, d):
    return S.engaged(S.fold_sessions(messages(spark, d))).select("session_id", "n_user")


@query("W1_drop_first_messages", with_(MESSAGES, SESSIONS) + "SELECT session_id, position, said_by FROM ranked WHERE rn > 2")
def w1(spark, d):
    order = Window.partitionBy("session_id").orderBy("position", "said_by")
    return S.speaker_messages(messages(spark, d)).withColumn("rn", F.row_number().over(order)).where("rn > 2").select("session_id", "position", "said_by")


@query("X1_prefixed_text", with_(MESSAGES, SESSIONS) + "SELECT session_id, md5(full_text) AS text_md5 FROM sessions")
def x1(spark, d):
    return S.fold_sessions(messages(spark, d)).select("session_id", F.md5("full_text").alias("text_md5"))


@query("X2_greeting", with_(MESSAGES) + "SELECT session_id, position, regexp_matches(message, '^\\s*(the|of)\\b.*$', 'i') AS greets, regexp_matches(message, '(th|er)', 'i') AS welcomes FROM messages")
def x2(spark, d):
    return messages(spark, d).select("session_id", "position", F.col("message").rlike(GREETING).alias("greets"), F.col("message").rlike(WELCOME).alias("welcomes"))


@query("S1_message_order", with_(MESSAGES) + "SELECT session_id, string_agg(said_by || ':' || CAST(position AS STRING), ' ' ORDER BY position, said_by) AS message_order FROM messages WHERE said_by IN ('USER', 'AGENT') GROUP BY session_id")
def s1(spark, d):
    return S.fold_sessions(messages(spark, d)).select("session_id", F.array_join(F.transform("messages", lambda m: F.concat(m["said_by"], F.lit(":"), m["position"].cast("string"))), " ").alias("message_order"))


# -- filters of the classification log ----------------------------------------------


def simple(name: str, where: str, columns: str, order: str = "", limit: int | None = None) -> None:
    """Register a filter in SQL that Spark and DuckDB share, with an optional order and limit."""
    tail = (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")

    @query(name, with_(FACTS) + f"SELECT {columns} FROM facts WHERE {where}{tail}")
    def run(spark, d):
        rows = facts(spark, d).where(where)
        if order:
            rows = rows.orderBy(*(_order(c) for c in order.split(", ")))
        return (rows.limit(limit) if limit else rows).selectExpr(*re.split(r", (?![^(]*\))", columns))


def _order(part: str):
    column, _, way = part.partition(" ")
    return F.desc(column) if way.startswith("DESC") else F.asc(column)


simple("F2_status_filter", "review_status IN ('auto_classified', 'resolved', 'completed', 'not_required')", "session_id, review_status, label")
simple("F3_by_label", "label = 'click' AND confidence IS NOT NULL", "session_id, label, round(confidence, 4) AS confidence", "confidence DESC, session_id", 50)
simple("F4_pending_review", "review_status = 'pending'", "session_id, label", "session_id DESC", 100)
simple("F12_in_cluster", "cluster_id IS NOT NULL AND propagated_from IS NULL", "session_id, cluster_id")
simple("F13_valid_label", "label IS NOT NULL AND label <> '' AND label <> 'altro'", "session_id, label")
simple("F14_recent_examples", "confidence >= 0.7 AND label <> 'altro' AND text IS NOT NULL AND length(text) BETWEEN 10 AND 200 AND ts >= TIMESTAMP '2024-01-24 00:00:00'", "session_id, label, round(confidence, 4) AS confidence", "confidence DESC, session_id", 20)
simple("F16_training_quality", "llm_conf >= 0.7 AND llm_label IS NOT NULL AND llm_label <> '' AND llm_label <> 'altro'", "session_id, llm_label")
simple("F17_validated", "method IN ('HUMAN_REVIEW', 'MANUAL') AND confidence >= 0.7", "session_id, method, label")
simple("F18_outlier_candidates", "confidence < 0.5 OR label IN ('outlier', 'altro')", "session_id, label, round(confidence, 4) AS confidence")
simple("S2_newest_first", "label = 'view'", "session_id, user_id", "session_id DESC", 25)
simple("M1_last_days", "ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS", "session_id, tenant_id")
simple("M2_cache_alive", "TIMESTAMP '2024-01-31 00:00:00' - ts <= INTERVAL 24 HOURS", "session_id, label")

QUEUE = """CASE WHEN review_status = 'pending' AND (is_representative IS NULL OR is_representative) THEN 'representative'
    WHEN propagated_from IS NOT NULL AND NOT coalesce(is_representative, FALSE) THEN 'propagated'
    WHEN cluster_id IS NULL OR cluster_id = '-1' OR cluster_id LIKE 'outlier!_%' ESCAPE '!' THEN 'outlier' END"""


@query("F5_review_queue", with_(FACTS) + f"SELECT session_id, {QUEUE} AS queue FROM facts WHERE {QUEUE} IS NOT NULL")
def f5(spark, d):
    rep = (F.col("review_status") == "pending") & (F.col("is_representative").isNull() | F.col("is_representative"))
    propagated = F.col("propagated_from").isNotNull() & ~F.col("is_representative").eqNullSafe(F.lit(True))
    outlier = F.col("cluster_id").isNull() | (F.col("cluster_id") == "-1") | F.col("cluster_id").rlike("^outlier_")
    queue = F.when(rep, "representative").when(propagated, "propagated").when(outlier, "outlier")
    return facts(spark, d).select("session_id", queue.alias("queue")).where("queue IS NOT NULL")


@query("F6_fallback_projection", with_(FACTS) + "SELECT session_id, coalesce(label, llm_label, ml_label, 'altro') AS shown FROM facts")
def f6(spark, d):
    return facts(spark, d).select("session_id", F.coalesce("label", "llm_label", "ml_label", F.lit("altro")).alias("shown"))


@query("F7_propagated_display", with_(FACTS) + """SELECT session_id,
    CASE WHEN propagated_from IS NOT NULL THEN coalesce(nullif(ml_label, ''), label) ELSE ml_label END AS ml_shown,
    round(CASE WHEN propagated_from IS NOT NULL THEN coalesce(nullif(ml_conf, 0), confidence) ELSE ml_conf END, 4) AS ml_conf_shown FROM facts""")
def f7(spark, d):
    propagated = F.col("propagated_from").isNotNull()
    label = F.when(propagated, F.coalesce(F.nullif("ml_label", F.lit("")), "label")).otherwise(F.col("ml_label"))
    conf = F.when(propagated, F.coalesce(F.nullif("ml_conf", F.lit(0.0)), "confidence")).otherwise(F.col("ml_conf"))
    return facts(spark, d).select("session_id", label.alias("ml_shown"), F.round(conf, 4).alias("ml_conf_shown"))


def session_type(missing: str):
    """Representative, propagated or outlier; ``missing`` for the rest."""
    outlier = F.col("cluster_id").isNull() | (F.col("cluster_id") == "-1") | F.col("cluster_id").rlike("^outlier_")
    return F.when(F.coalesce("is_representative", F.lit(False)), "representative").when(F.col("propagated_from").isNotNull(), "propagated").when(outlier, "outlier").otherwise(missing)


TYPE = "CASE WHEN coalesce(is_representative, FALSE) THEN 'representative' WHEN propagated_from IS NOT NULL THEN 'propagated' WHEN cluster_id IS NULL OR cluster_id = '-1' OR starts_with(cluster_id, 'outlier_') THEN 'outlier' ELSE '%s' END"


@query("F8_session_type_written", with_(FACTS) + f"SELECT session_id, {TYPE % 'outlier'} AS session_type FROM facts")
def f8(spark, d):
    return facts(spark, d).select("session_id", session_type("outlier").alias("session_type"))


@query("F9_session_type_read", with_(FACTS) + f"SELECT session_id, {TYPE % 'unknown'} AS session_type FROM facts")
def f9(spark, d):
    return facts(spark, d).select("session_id", session_type("unknown").alias("session_type"))


@query("F15_diverse_examples", with_(FACTS) + """SELECT session_id, label FROM (
    SELECT session_id, label, confidence, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, session_id) AS rn FROM facts
    WHERE review_status IS DISTINCT FROM 'pending' AND label IS NOT NULL AND confidence IS NOT NULL) WHERE rn = 1 ORDER BY confidence DESC, session_id LIMIT 4""")
def f15(spark, d):
    rows = facts(spark, d).where(~F.col("review_status").eqNullSafe(F.lit("pending")) & F.col("label").isNotNull() & F.col("confidence").isNotNull())
    best = rows.groupBy("label").agg(F.max_by(F.struct("session_id", "confidence"), F.struct("confidence", -F.col("session_id"))).alias("b")).select("label", "b.*")
    return best.orderBy(F.desc("confidence"), "session_id").limit(4).select("session_id", "label")


@query("F19_tag_exists", with_(FACTS, TAGS) + "SELECT DISTINCT f.label, t.tag_name IS NOT NULL AS known FROM facts f LEFT JOIN (SELECT DISTINCT tag_name FROM tags UNION SELECT 'click') t ON f.label = t.tag_name")
def f19(spark, d):
    known = tags(spark, d).select("tag_name").union(spark.sql("SELECT 'click'")).distinct()
    labels = facts(spark, d).select("label").distinct()
    return labels.join(known, labels["label"] == known["tag_name"], "left").select("label", F.col("tag_name").isNotNull().alias("known"))


@query("F20_any_label", with_(FACTS) + "SELECT user_id FROM facts GROUP BY user_id HAVING bool_or(label = 'signup') AND bool_or(review_status = 'pending')")
def f20(spark, d):
    rows = facts(spark, d).groupBy("user_id").agg(F.collect_set("label").alias("labels"), F.collect_set("review_status").alias("states"))
    return rows.where(F.array_contains("labels", "signup") & F.array_contains("states", "pending")).select("user_id")


@query("F21_tag_search", with_(FACTS) + "SELECT label, count(*) AS n FROM facts WHERE contains(lower(label), 'i') GROUP BY label")
def f21(spark, d):
    found = facts(spark, d).where(F.lower("label").contains("i")).groupBy("label").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc(F.col("label").startswith("i")), F.desc("n"), "label")


@query("F22_label_list", with_(FACTS) + "SELECT DISTINCT label FROM facts WHERE label IS NOT NULL ORDER BY label")
def f22(spark, d):
    return facts(spark, d).select("label").where("label IS NOT NULL").distinct().orderBy("label")


# -- joins --------------------------------------------------------------------------


@query("J1_inner_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 45")
def j1(spark, d):
    lines, orders = table(spark, d, "lineitem").where("l_quantity > 45"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("J2_scalar_lookup", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3) AS nation FROM customer")
def j2(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("nation"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "nation")


@query("J3_session_join", "SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def j3(spark, d):
    lines, orders = table(spark, d, "lineitem").select("l_orderkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("n_lines"))


@query("J4_tenant_join", with_(FACTS, TENANTS) + "SELECT session_id, tenant_name FROM facts JOIN tenants USING (tenant_id) WHERE tenant_slug = 'asia'")
def j4(spark, d):
    return facts(spark, d).join(tenants(spark, d).where("tenant_slug = 'asia'"), "tenant_id").select("session_id", "tenant_name")


@query("J5_tag_join", with_(FACTS, TAGS) + "SELECT tag_name, count(*) AS n, round(avg(confidence), 3) AS mean_confidence FROM facts JOIN tags ON session_id % 25 = tag_id GROUP BY tag_name")
def j5(spark, d):
    rows = facts(spark, d).withColumn("tag_id", F.col("session_id") % 25)
    return rows.join(tags(spark, d).select("tag_id", "tag_name"), "tag_id").groupBy("tag_name").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@query("J6_active_view", with_(TENANTS, TAGS) + "SELECT tag_name, tenant_name FROM tags t JOIN tenants n ON t.tenant_id = n.tenant_id WHERE t.is_active AND n.is_active")
def j6(spark, d):
    tags(spark, d).createOrReplaceTempView("loom_tags")
    tenants(spark, d).createOrReplaceTempView("loom_tenants")
    return spark.sql("SELECT tag_name, tenant_name FROM loom_tags t JOIN loom_tenants n ON t.tenant_id = n.tenant_id WHERE t.is_active AND n.is_active")


@query("J7_new_only", with_(FACTS) + "SELECT session_id FROM facts WHERE session_id NOT IN (SELECT session_id FROM facts WHERE review_status = 'resolved')")
def j7(spark, d):
    rows = facts(spark, d).select("session_id", "review_status")
    return rows.select("session_id").join(rows.where("review_status = 'resolved'").select("session_id"), "session_id", "left_anti")


@query("J8_in_list", with_(FACTS) + "SELECT session_id, label FROM facts WHERE session_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j8(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("session_id"))
    return facts(spark, d).join(ids, "session_id", "left_semi").select("session_id", "label")


@query("J9_decision_texts", with_(FACTS) + """
, best AS (SELECT label, arg_max(text, {'c': confidence, 's': -session_id}) AS best_text FROM facts WHERE confidence IS NOT NULL AND label IS NOT NULL GROUP BY label)
SELECT l.doc_id, coalesce(f.text, b.best_text, 'Richiesta relativa a ' || CASE l.quality WHEN 1 THEN 'click' ELSE 'view' END) AS text
FROM labels l LEFT JOIN (SELECT * FROM facts WHERE session_id % 3 = 0) f ON l.doc_id = f.session_id LEFT JOIN best b ON b.label = CASE l.quality WHEN 1 THEN 'click' ELSE 'view' END""")
def j9(spark, d):
    rows = facts(spark, d)
    decisions = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "click").otherwise("view").alias("decision"))
    best = rows.where("confidence IS NOT NULL AND label IS NOT NULL").groupBy("label").agg(F.max_by("text", F.struct("confidence", -F.col("session_id"))).alias("best_text"))
    known = rows.where("session_id % 3 = 0").select(F.col("session_id").alias("doc_id"), "text")
    joined = decisions.join(known, "doc_id", "left").join(best, F.col("decision") == F.col("label"), "left")
    return joined.select("doc_id", F.coalesce("text", "best_text", F.concat(F.lit("Richiesta relativa a "), "decision")).alias("text"))


@query("J10_training_examples", with_(FACTS) + "SELECT f.session_id, f.label, d.lang FROM facts f JOIN documents d ON f.session_id = d.doc_id WHERE f.label IN (SELECT event_type FROM events) AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.session_id)")
def j10(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), "lang")
    valid = table(spark, d, "events").select(F.col("event_type").alias("label")).distinct()
    decided = table(spark, d, "labels").select(F.col("doc_id").alias("session_id"))
    return facts(spark, d).join(docs, "session_id").join(valid, "label", "left_semi").join(decided, "session_id", "left_semi").select("session_id", "label", "lang")


@query("J11_session_status", with_(FACTS) + """
SELECT user_id, CASE WHEN count(*) FILTER (review_status = 'pending') > 0 THEN 'in_review' WHEN count(*) FILTER (review_status = 'auto_classified') > 0 THEN 'auto' ELSE 'available' END AS status,
    list_sort(list(DISTINCT label) FILTER (label IS NOT NULL))::STRING[] AS labels FROM facts GROUP BY user_id""")
def j11(spark, d):
    rows = facts(spark, d)
    pending = rows.where("review_status = 'pending'").select("user_id", F.lit(True).alias("pending")).distinct()
    auto = rows.where("review_status = 'auto_classified'").select("user_id", F.lit(True).alias("auto")).distinct()
    status = F.when(F.col("pending"), "in_review").when(F.col("auto"), "auto").otherwise("available")
    labels = rows.groupBy("user_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return labels.join(pending, "user_id", "left").join(auto, "user_id", "left").select("user_id", status.alias("status"), "labels")


@query("J12_suggested_tags", with_(FACTS) + """
, used AS (SELECT label, count(*) AS n FROM facts GROUP BY label), dim AS (SELECT DISTINCT event_type AS tag FROM events UNION ALL SELECT 'unused')
SELECT tag, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'used_frequently' ELSE 'available' END AS source FROM dim LEFT JOIN used ON tag = label""")
def j12(spark, d):
    used = facts(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    dim = table(spark, d, "events").select(F.col("event_type").alias("tag")).distinct().union(spark.sql("SELECT 'unused'"))
    joined = dim.join(used, F.col("tag") == F.col("label"), "left")
    return joined.select("tag", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "used_frequently").otherwise("available").alias("source")).orderBy(F.desc("n"), "tag")


@query("J13_propagate_label", with_(FACTS) + """
, reps AS (SELECT cluster_id, arg_max(label, {'c': confidence, 's': -session_id}) AS cluster_label FROM facts WHERE is_representative AND cluster_id IS NOT NULL AND confidence IS NOT NULL AND label IS NOT NULL GROUP BY cluster_id)
SELECT session_id, cluster_label FROM facts JOIN reps USING (cluster_id)""")
def j13(spark, d):
    rows = facts(spark, d)
    reps = rows.where("is_representative AND cluster_id IS NOT NULL AND confidence IS NOT NULL AND label IS NOT NULL").groupBy("cluster_id").agg(F.max_by("label", F.struct("confidence", -F.col("session_id"))).alias("cluster_label"))
    return rows.join(reps, "cluster_id").select("session_id", "cluster_label")


# -- windows, sorts, paging, sets ---------------------------------------------------


def ranked(name: str, partition: str, order: str, n: int, where: str = "confidence IS NOT NULL") -> None:
    """Register a top-n of each group."""

    @query(name, with_(FACTS) + f"SELECT session_id, {partition} FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rn FROM facts WHERE {where}) WHERE rn <= {n}")
    def run(spark, d):
        window = Window.partitionBy(partition).orderBy(*(_order(c) for c in order.split(", ")))
        return facts(spark, d).where(where).withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n).select("session_id", partition)


ranked("W2_top_samples", "label", "confidence DESC, ts DESC, session_id", 50)
ranked("W3_newest_per_label", "label", "ts DESC, session_id DESC", 50)
ranked("S6_candidates_per_label", "ml_label", "ml_conf DESC, session_id", 5, "ml_label IS NOT NULL")
ranked("R3_first_representatives", "cluster_id", "session_id", 3, "cluster_id IS NOT NULL")


@query("W4_global_cap", with_(FACTS) + "SELECT session_id FROM facts WHERE label IS NOT NULL ORDER BY ts DESC, session_id DESC LIMIT (SELECT CASE WHEN count(*) > 700 THEN count(*) - 100 ELSE count(*) END FROM facts WHERE label IS NOT NULL)")
def w4(spark, d):
    # what is evicted is bounded by a parameter; the rest is all that is not among the oldest
    rows = facts(spark, d).where("label IS NOT NULL").select("session_id", "ts")
    evict = rows.orderBy("ts", "session_id").limit(100)
    over = rows.agg((F.count("*") > 700).alias("over"))
    return rows.join(evict.crossJoin(over).where("over").select("session_id"), "session_id", "left_anti").select("session_id")


@query("W6_best_candidate", with_(FACTS) + "SELECT user_id, arg_max(session_id, {'c': confidence, 's': -session_id}) AS best_session FROM facts WHERE confidence IS NOT NULL GROUP BY user_id")
def w6(spark, d):
    return facts(spark, d).where("confidence IS NOT NULL").groupBy("user_id").agg(F.max_by("session_id", F.struct("confidence", -F.col("session_id"))).alias("best_session"))


BUDGET = """, clusters AS (SELECT cluster_id, count(*) AS size, round(avg(confidence), 6) AS conf FROM facts WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
plan AS (SELECT *, CASE WHEN size <= 3 THEN size WHEN size <= 10 THEN 3 WHEN size <= 50 THEN 4 ELSE 5 END AS base FROM clusters)
"""


@query("W7_review_budget", with_(FACTS) + BUDGET + "SELECT cluster_id, size, CAST(greatest(0, least(base, 60 - coalesce(sum(base) OVER (ORDER BY size DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS slots FROM plan")
def w7(spark, d):
    from sessionloom.operators.clusters import review_budget

    sizes = facts(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return review_budget(sizes, 60).select("cluster_id", "size", "slots")


@query("W8_percentage", with_(FACTS) + "SELECT label, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM facts GROUP BY label")
def w8(spark, d):
    counts = facts(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy(F.lit(0))), 2).alias("pct"))


@query("W9_latest_version", with_(TAGS) + "SELECT tenant_id, tag_name FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY tag_id DESC) AS rn FROM tags WHERE is_active) WHERE rn = 1")
def w9(spark, d):
    return tags(spark, d).where("is_active").groupBy("tenant_id").agg(F.max_by("tag_name", "tag_id").alias("tag_name"))


W10_SQL = """, phased AS (SELECT session_id, label, confidence, CASE WHEN confidence >= .7 THEN 1 WHEN confidence >= .4 THEN 2 ELSE 3 END AS phase FROM facts WHERE confidence IS NOT NULL AND label IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, session_id) AS rn FROM phased)
SELECT session_id, label FROM ranked ORDER BY rn, phase, confidence DESC, session_id LIMIT 8"""


@query("W10_label_diverse", with_(FACTS) + W10_SQL)
def w10(spark, d):
    phase = F.when(F.col("confidence") >= 0.7, 1).when(F.col("confidence") >= 0.4, 2).otherwise(3)
    window = Window.partitionBy("label").orderBy(F.desc("confidence"), "session_id")
    rows = facts(spark, d).where("confidence IS NOT NULL AND label IS NOT NULL").withColumn("phase", phase).withColumn("rn", F.row_number().over(window)).where("rn <= 8")
    return rows.orderBy("rn", "phase", F.desc("confidence"), "session_id").limit(8).select("session_id", "label")


@query("W11_cache_trim", with_(FACTS) + "SELECT session_id FROM facts ORDER BY ts DESC, session_id DESC LIMIT (SELECT CASE WHEN count(*) > 1000 THEN 800 ELSE count(*) END FROM facts)")
def w11(spark, d):
    rows = facts(spark, d).select("session_id", "ts")
    over = rows.limit(1001).count() > 1000
    return (rows.orderBy(F.desc("ts"), F.desc("session_id")).limit(800) if over else rows).select("session_id")


@query("S3_paging", with_(FACTS) + "SELECT session_id, label FROM facts ORDER BY session_id LIMIT 20 OFFSET 40")
def s3(spark, d):
    return facts(spark, d).orderBy("session_id").offset(40).limit(20).select("session_id", "label")


@query("S7_array_top", "SELECT vec_id, list_transform(list_slice(list_reverse_sort(CAST(embedding AS DOUBLE[])), 1, 3), lambda x: round(x, 5)) AS top3 FROM embeddings")
def s7(spark, d):
    from sessionloom.sources.catalog import vectors

    return vectors(spark, d).select("vec_id", F.transform(F.slice(F.sort_array("v", asc=False), 1, 3), lambda x: F.round(x, 5)).alias("top3"))


@query("S8_cluster_order", with_(FACTS) + BUDGET + "SELECT cluster_id, size, round(conf, 4) AS conf, row_number() OVER (ORDER BY size DESC, cluster_id) AS by_size, row_number() OVER (ORDER BY conf, cluster_id) AS by_conf FROM plan")
def s8(spark, d):
    # one row for each cluster
    rows = facts(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.avg("confidence"), 6).alias("conf"))
    number = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long")
    return rows.select("cluster_id", "size", F.round("conf", 4).alias("conf"), number(F.desc("size"), "cluster_id").alias("by_size"), number(F.asc("conf"), F.asc("cluster_id")).alias("by_conf"))


@query("U1_difference", "SELECT event_id AS id FROM events EXCEPT SELECT doc_id FROM documents")
def u1(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id")).subtract(table(spark, d, "documents").select("doc_id"))


@query("U2_member_union", with_(FACTS) + "SELECT session_id FROM facts WHERE cluster_id = '3' UNION SELECT session_id FROM facts WHERE label = 'click'")
def u2(spark, d):
    rows = facts(spark, d)
    return rows.where("cluster_id = '3'").select("session_id").union(rows.where("label = 'click'").select("session_id")).distinct()


@query("U3_union_all", with_(FACTS) + "SELECT session_id, 'new' AS origin FROM facts WHERE cluster_id = '-1' UNION ALL SELECT session_id, 'old' FROM facts WHERE starts_with(cluster_id, 'outlier_')")
def u3(spark, d):
    rows = facts(spark, d)
    return rows.where("cluster_id = '-1'").select("session_id", F.lit("new").alias("origin")).unionByName(rows.where("startswith(cluster_id, 'outlier_')").select("session_id", F.lit("old").alias("origin")))


@query("U4_concatenate", with_(FACTS) + "SELECT session_id, list_filter([label, ml_label, llm_label], lambda x: x IS NOT NULL) AS labels FROM facts")
def u4(spark, d):
    return facts(spark, d).select("session_id", F.array_compact(F.concat(F.array("label"), F.array("ml_label", "llm_label"))).alias("labels"))


@query("U5_first_wins", with_(FACTS) + "SELECT text, min(session_id) AS session_id FROM facts GROUP BY text")
def u5(spark, d):
    return facts(spark, d).groupBy("text").agg(F.min("session_id").alias("session_id"))
