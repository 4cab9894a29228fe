"""Queries of models, tuning and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.operators import models as M
from sessionloom.operators import topics as T
from sessionloom.plans.oracle import FACTS, TAGS, with_
from sessionloom.plans.registry import query
from sessionloom.sources.catalog import facts, table, tags
from sessionloom.sources.shared import saved

c = F.col


@query("ML1_embedding")
def ml1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", M.embed(c("text"), M.HashingEmbedder(32)).alias("v"))
    return docs.select("doc_id", F.size("v").alias("dimension"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


@query("ML2_soft_vote")
def ml2(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", c("role").alias("label"))
    model = M.fit_voters(rows.where("conv_id % 3 <> 0"), features=256, margins=True)
    return M.soft_vote(model, rows.where("conv_id % 3 = 0"), ["conv_id", "turn"]).withColumn("confidence", F.round("confidence", 4))


@query("ML3_description_features", with_(FACTS, TAGS) + "SELECT session_id, concat_ws(' ', text, tag_description) AS features FROM facts LEFT JOIN tags ON tag_id = session_id % 30")
def ml3(spark, d):
    # tags are looked up by an id known at prediction time, so that no label leaks into the features
    rows = facts(spark, d).withColumn("tag_id", c("session_id") % 30)
    return rows.join(tags(spark, d).select("tag_id", "tag_description"), "tag_id", "left").select("session_id", F.concat_ws(" ", "text", "tag_description").alias("features"))


@query("ML4_training_guard", with_(FACTS) + "SELECT tenant_id, count(DISTINCT label) >= 2 AND count(*) >= 5 AS can_train FROM facts WHERE label <> '' GROUP BY tenant_id")
def ml4(spark, d):
    return facts(spark, d).where("label <> ''").groupBy("tenant_id").agg(((F.count_distinct("label") >= 2) & (F.count("*") >= 5)).alias("can_train"))


@query("ML6_retrain_set", with_(FACTS) + "SELECT session_id, label, 'new' AS origin FROM facts WHERE method = 'MANUAL' AND label <> '' UNION ALL SELECT session_id, label, 'old' FROM facts WHERE method = 'AUTOMATIC' AND label <> ''")
def ml6(spark, d):
    rows = facts(spark, d).where("label <> ''")
    return rows.where("method = 'MANUAL'").select("session_id", "label", F.lit("new").alias("origin")).unionByName(rows.where("method = 'AUTOMATIC'").select("session_id", "label", F.lit("old").alias("origin")))


@query("ML7_training_texts", with_(FACTS) + "SELECT l.doc_id, f.text, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label FROM labels l JOIN facts f ON l.doc_id = f.session_id WHERE length(f.text) >= 20")
def ml7(spark, d):
    decisions = table(spark, d, "labels").select("doc_id", F.when(c("quality") == 1, "good").otherwise("bad").alias("label"))
    return decisions.join(facts(spark, d), c("doc_id") == c("session_id")).where(F.length("text") >= 20).select("doc_id", "text", decisions["label"])


@query("ML8_topics")
def ml8(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    found = M.topics(rows, k=4).transform(rows)
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("topic_probabilities")
    return found.select("conv_id", "turn", (F.array_position(p, F.array_max(p)) - 1).alias("topic"))


@query("ML9_topic_words", "SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rn FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) > 3 GROUP BY lang, word) WHERE rn <= 5")
def ml9(spark, d):
    from pyspark.sql import Window

    words = table(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") > 3)
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where("rn <= 5").drop("rn")


# a document's topic is its vector's cluster; those without a vector are unseen
TOPICS = """topics AS (SELECT vec_id AS doc_id, CAST(label AS BIGINT) AS topic FROM embeddings),
counts AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY 1, 2),
by_topic AS (SELECT topic, term, sum(n) AS n FROM counts JOIN topics USING (doc_id) GROUP BY 1, 2), words AS (SELECT topic, sum(n) AS words FROM by_topic GROUP BY 1),
terms AS (SELECT topic, term, n / words * ln(1 + (SELECT avg(words) FROM words) / f) AS weight FROM by_topic JOIN words USING (topic) JOIN (SELECT term, sum(n) AS f FROM by_topic GROUP BY 1) USING (term)),
scores AS (SELECT doc_id, topic, sum(c.n * weight) / any_value(size) AS score FROM counts c JOIN terms USING (term) JOIN (SELECT doc_id, sum(n) AS size FROM counts GROUP BY 1) USING (doc_id) GROUP BY 1, 2)
"""


def topic_model(spark, d):
    """(counts, topics, terms) of the documents."""
    counts = saved(T.term_counts(table(spark, d, "documents"), "doc_id", "text"), "term-counts")
    topics = table(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), c("label").cast("long").alias("topic"))
    return counts, topics, saved(T.topic_terms(counts, topics, "doc_id"), "terms")


@query("ML9_topic_terms", with_(TOPICS) + "SELECT topic, term, round(weight, 6) AS weight FROM terms QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) <= 10")
def ml9_terms(spark, d):
    _, _, terms = topic_model(spark, d)
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term"))
    return terms.withColumn("k", place).where("k <= 10").select("topic", "term", F.round("weight", 6).alias("weight"))


@query("ML9_typical_texts", with_(TOPICS) + "SELECT topic, doc_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, doc_id) AS INT) AS place FROM scores JOIN topics USING (doc_id, topic) QUALIFY place <= 3")
def ml9_texts(spark, d):
    counts, topics, terms = topic_model(spark, d)
    return T.typical_texts(counts, topics, terms, "doc_id")


@query("ML8_topic_shares", with_(TOPICS) + "SELECT doc_id, topic, round(score / sum(score) OVER (PARTITION BY doc_id), 6) AS share FROM scores")
def ml8_shares(spark, d):
    counts, _, terms = topic_model(spark, d)
    return T.topic_shares(counts, terms, "doc_id").withColumn("share", F.round("share", 6))


@query("ML8_topic_features")
def ml8_features(spark, d):
    counts, topics, terms = topic_model(spark, d)
    # topics are as many as clusters of the vectors
    names = [r["topic"] for r in topics.select("topic").distinct().orderBy("topic").collect()]
    found = T.topic_features(T.topic_shares(counts, terms, "doc_id"), table(spark, d, "documents"), names, "doc_id", components=3)
    return found.withColumn("reduced", F.transform("reduced", lambda x: F.round(x, 6)))


GRID = "unnest(range(2, 20)) AS t"


@query("ML10_threshold_search", with_(FACTS) + ", hits AS (SELECT llm_conf, llm_label = event AS hit FROM (SELECT f.*, e.event_type AS event FROM facts f JOIN events e ON e.event_id = f.session_id) WHERE llm_conf IS NOT NULL), grid AS (SELECT t / 20.0 AS threshold FROM (SELECT " + GRID + ")) SELECT threshold, count(*) FILTER (llm_conf >= threshold) AS accepted, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (llm_conf >= threshold), 4) AS accuracy FROM hits CROSS JOIN grid GROUP BY threshold")
def ml10(spark, d):
    truth = table(spark, d, "events").select(c("event_id").alias("session_id"), c("event_type").alias("event"))
    hits = facts(spark, d).where("llm_conf IS NOT NULL").join(truth, "session_id").groupBy("llm_conf").agg(F.count("*").alias("n"), F.count_if(c("llm_label") == c("event")).alias("hit"))
    # a fixed grid of 18 thresholds meets the counts of each confidence, which have two decimals
    grid = spark.range(2, 20).select((c("id") / 20).alias("threshold"))
    met = hits.crossJoin(F.broadcast(grid)).where("llm_conf >= threshold")
    found = met.groupBy("threshold").agg(F.sum("n").alias("accepted"), F.round(F.sum("hit") / F.sum("n"), 4).alias("accuracy"))
    return grid.join(found, "threshold", "left").select("threshold", F.coalesce("accepted", F.lit(0)).alias("accepted"), "accuracy")


@query("ML11_weight_search", with_(FACTS) + ", g AS (SELECT t / 10.0 AS w FROM (SELECT unnest(range(1, 10)) AS t)), s AS (SELECT w, CASE WHEN round(w * llm_conf, 9) > round((1 - w) * ml_conf, 9) THEN llm_label ELSE ml_label END = label AS hit FROM facts CROSS JOIN g WHERE llm_conf IS NOT NULL AND ml_conf IS NOT NULL AND label <> '') SELECT w AS weight, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM s GROUP BY w")
def ml11(spark, d):
    rows = facts(spark, d).where("llm_conf IS NOT NULL AND ml_conf IS NOT NULL AND label <> ''")
    tried = F.array(*(F.struct(F.lit(k / 10).alias("weight"), (F.when(F.round(c("llm_conf") * (k / 10), 9) > F.round(c("ml_conf") * (1 - F.lit(k / 10)), 9), c("llm_label")).otherwise(c("ml_label")) == c("label")).cast("double").alias("hit")) for k in range(1, 10)))
    return rows.select(F.explode(tried).alias("x")).groupBy("x.weight").agg(F.round(F.avg("x.hit"), 4).alias("accuracy"))


@query("ML13_metrics", with_(FACTS) + ", r AS (SELECT f.llm_label AS g, e.event_type AS t FROM facts f JOIN events e ON e.event_id = f.session_id WHERE f.llm_label IS NOT NULL), p AS (SELECT t, count(*) AS support, count(*) FILTER (t = g) AS hit, (SELECT count(*) FROM r x WHERE x.g = r.t) AS guessed FROM r GROUP BY t), m AS (SELECT *, coalesce(hit / nullif(guessed, 0), 0) AS pr, hit / support AS re FROM p) SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(sum(pr * support) / sum(support), 4) AS precision, round(sum(re * support) / sum(support), 4) AS recall, round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 4) AS f1 FROM m")
def ml13(spark, d):
    truth = table(spark, d, "events").select(c("event_id").alias("session_id"), c("event_type").alias("event"))
    rows = facts(spark, d).where("llm_label IS NOT NULL").join(truth, "session_id")
    found = M.classification_metrics(rows, "event", "llm_label")
    return found.select(*(F.round(x, 4).alias(x) for x in found.columns))


@query("ML14_finetune_set", with_(FACTS) + """SELECT session_id, '{"messages":[{"role":"user","content":"' || left(text, 500) || '"},{"role":"assistant","content":"' || label || '"}]}' AS line FROM facts WHERE method = 'HUMAN_REVIEW' AND label <> '' AND label <> 'altro' AND length(text) >= 10""")
def ml14(spark, d):
    from sessionloom.sources.jsonl import chat_lines

    rows = facts(spark, d).where("method = 'HUMAN_REVIEW' AND label <> '' AND label <> 'altro' AND length(text) >= 10")
    return rows.select("session_id", chat_lines(F.left("text", F.lit(500)), c("label")).alias("line"))


@query("ML14_finetune_top_up", with_(FACTS, TAGS) + """, own AS (SELECT user_id, session_id, '{"messages":[{"role":"user","content":"' || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END || '"},{"role":"assistant","content":"' || label || '"}]}' AS line FROM facts WHERE method = 'HUMAN_REVIEW' AND label <> '' AND label <> 'altro' AND length(trim(text)) >= 10),
few AS (SELECT user_id, count(*) AS n FROM own GROUP BY 1 HAVING count(*) < 20), curated AS (SELECT row_number() OVER (ORDER BY tag_id) AS k, '{"messages":[{"role":"user","content":"' || coalesce(tag_description, tag_name) || '"},{"role":"assistant","content":"' || tag_name || '"}]}' AS line FROM tags WHERE is_active)
SELECT user_id, 'human' AS source, line FROM own UNION ALL SELECT user_id, 'curated', line FROM few JOIN curated ON k <= 30 - n""")
def ml14_top_up(spark, d):
    # users with fewer than 20 examples of their own get curated ones, up to 30 in all
    from sessionloom.sources.jsonl import chat_lines

    rows = facts(spark, d).where("method = 'HUMAN_REVIEW' AND label <> '' AND label <> 'altro' AND length(trim(text)) >= 10")
    cut = F.when(F.length("text") > 500, F.concat(F.left("text", F.lit(500)), F.lit("..."))).otherwise(c("text"))
    own = rows.select("user_id", F.lit("human").alias("source"), chat_lines(cut, c("label")).alias("line"))
    few = own.groupBy("user_id").agg(F.count("*").alias("n")).where("n < 20").select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), 30 - c("n"))).alias("k"))
    # tags are a vocabulary that people keep
    curated = tags(spark, d).where("is_active").select(F.row_number().over(Window.orderBy("tag_id")).cast("long").alias("k"), chat_lines(F.coalesce("tag_description", "tag_name"), c("tag_name")).alias("line"))
    return own.unionAll(few.join(curated, "k").select("user_id", F.lit("curated").alias("source"), "line"))


@query("ML15_log_sync", with_(FACTS) + "SELECT count(*) FILTER (doc_id IS NULL) AS only_table, count(*) FILTER (session_id IS NULL) AS only_log, count(*) FILTER (doc_id IS NOT NULL AND session_id IS NOT NULL) AS both_sides FROM (SELECT session_id FROM facts WHERE method = 'HUMAN_REVIEW') f FULL JOIN labels l ON f.session_id = l.doc_id")
def ml15(spark, d):
    f = facts(spark, d).where("method = 'HUMAN_REVIEW'").select("session_id")
    joined = f.join(table(spark, d, "labels").select("doc_id"), c("session_id") == c("doc_id"), "full")
    return joined.agg(F.count_if(c("doc_id").isNull()).alias("only_table"), F.count_if(c("session_id").isNull()).alias("only_log"), F.count_if(c("doc_id").isNotNull() & c("session_id").isNotNull()).alias("both_sides"))


class LengthScorer:
    """A scorer for tests: short texts are ``short``, others ``long``."""

    def classify(self, texts):
        return [("short" if len(t) < 200 else "long", 0.9, f"{len(t)} characters") for t in texts]


@query("ML18_scored_texts", "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS label, CAST(.9 AS DOUBLE) AS confidence FROM documents")
def ml18(spark, d):
    return M.score_texts(table(spark, d, "documents"), "doc_id", "text", LengthScorer()).select("doc_id", "label", "confidence")
