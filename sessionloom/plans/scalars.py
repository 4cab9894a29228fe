"""Scalar functions on labels, texts, numbers, vectors, JSON and hashes, applied to the data."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import labels as L
from sessionloom.functions import numbers as N
from sessionloom.plans.oracle import FACTS, TAGS, VECTORS, with_
from sessionloom.plans.registry import query
from sessionloom.sources.catalog import facts, table, tags, vectors

#: Each document's whole text as a raw label, with capitals, punctuation and accents.
RAW = "text"


def raw(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("raw"))


def scalar(name: str, sql: str, make) -> None:
    """Register a function of the raw label."""

    @query(name, f"SELECT doc_id, {sql} AS out FROM (SELECT doc_id, {RAW} AS raw FROM documents)")
    def run(spark, d):
        return raw(spark, d).select("doc_id", make(F.col("raw")).alias("out"))


WS = r"'[ \t\n\x0B\f\r]+'"
scalar("X3_normalise_memory", rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), {WS}, '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')", L.normalise_memory)
PLAIN = rf"lower(regexp_replace(trim(regexp_replace(raw, '[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r]', '', 'g')), {WS}, '_', 'g'))"
scalar("X5_normalise_plain", PLAIN, L.normalise_plain)
scalar("X4_normalise_dedup", f"replace(replace(replace(replace(replace({PLAIN}, 'prenotazioni', 'prenotazione'), 'referti', 'ritiro_referti'), 'pagamenti', 'fatturazione'), 'contatti', 'orari_contatti'), 'informazioni', 'info')", L.normalise_dedup)
scalar("X10_topic_name", r"coalesce(nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(raw, '^\d+_', ''), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')), ''), 'sconosciuto')", L.clean_topic_name)
scalar("X12_preview", "CASE WHEN length(raw) > 20 THEN left(raw, 20) || '...' ELSE raw END", lambda c: L.preview(c, 20))
scalar("X17_domain_context", "CASE WHEN contains(lower(replace(raw, '_', ' ')), 'the') THEN replace(raw, '_', ' ') || ' article' WHEN contains(lower(replace(raw, '_', ' ')), 'und') THEN replace(raw, '_', ' ') || ' conjunction' ELSE replace(raw, '_', ' ') END", lambda c: L.rule_domain(c, {"the": "article", "und": "conjunction"}))
scalar("X13_context_hint", "CASE WHEN contains(lower(raw), 'th') AND (contains(lower(raw), 'er') OR contains(lower(raw), 'on')) THEN 'first' WHEN contains(lower(raw), 'de') OR contains(lower(raw), 'en') THEN 'second' END", lambda c: L.context_hint(c, [([["th"], ["er", "on"]], "first"), ([["de", "en"]], "second")]))
scalar("L12_length_fallback", "CAST(CASE WHEN length(trim(raw)) < 10 THEN 0.05 WHEN length(trim(raw)) > 500 THEN 0.15 ELSE 0.10 END AS DOUBLE)", L.length_fallback)
scalar("H1_cache_key", "md5(concat_ws('|', raw, 'context', 'model', '0.1'))", lambda c: N.cache_key(c, F.lit("context"), F.lit("model"), F.lit("0.1")))
scalar("H2_session_hash", "left(md5(raw), 16)", lambda c: F.left(F.md5(c), F.lit(16)))


@query("X11_summary", """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text
    WHEN len(p) <= 2 THEN left(text, 300) || '...'
    WHEN length(p[1] || '. [...] ' || CASE WHEN trim(p[-1]) <> '' THEN p[-1] ELSE p[-2] END) > 300 THEN left(text, 297) || '...'
    ELSE p[1] || '. [...] ' || CASE WHEN trim(p[-1]) <> '' THEN p[-1] ELSE p[-2] END END AS summary
FROM (SELECT doc_id, text, string_split(text, '.') AS p FROM documents)""")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", L.summarise(F.col("text")).alias("summary"))


@query("X6_resolve_label", with_(FACTS) + """, near AS (SELECT label, CASE WHEN label IN ('click', 'view', 'purchase', 'altro') THEN label WHEN label = 'signup' THEN 'purchase' WHEN label = 'error' THEN 'altro' ELSE 'altro' END AS resolved FROM facts)
SELECT label, resolved, count(*) AS n FROM near WHERE label IS NOT NULL GROUP BY 1, 2""")
def x6(spark, d):
    resolved = L.resolve_label(F.col("label"), ["click", "view", "purchase", "altro"], {"signup": "purchase"}, {"info_": ["err"]})
    return facts(spark, d).where("label IS NOT NULL").select("label", resolved.alias("resolved")).groupBy("label", "resolved").agg(F.count("*").alias("n"))


@query("X7_edit_distance", with_(TAGS) + "SELECT a.tag_name AS a, b.tag_name AS b, CAST(levenshtein(a.tag_name, b.tag_name) AS BIGINT) AS distance FROM tags a JOIN tags b ON a.tag_id < b.tag_id AND a.tenant_id = b.tenant_id")
def x7(spark, d):
    a, b = tags(spark, d).alias("a"), tags(spark, d).alias("b")
    joined = a.join(b, (F.col("a.tenant_id") == F.col("b.tenant_id")) & (F.col("a.tag_id") < F.col("b.tag_id")))
    return joined.select(F.col("a.tag_name").alias("a"), F.col("b.tag_name").alias("b"), F.levenshtein("a.tag_name", "b.tag_name").cast("long").alias("distance"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of two labels matches in order (Ratcliff and Obershelp); there is no built-in for it."""
    return pd.Series([round(difflib.SequenceMatcher(None, x or "", y or "").ratio(), 6) for x, y in zip(a, b, strict=True)])


def tag_pairs(spark, d):
    """Pairs of one tenant's tags, which are few, with their likeness."""
    t = tags(spark, d).select("tenant_id", "tag_id", L.normalise_plain(F.col("tag_name")).alias("name"))
    a, b = t.toDF("tenant_id", "a_id", "a"), t.toDF("tenant_id", "b_id", "b")
    return a.join(b, "tenant_id").where("a_id < b_id").withColumn("ratio", sequence_ratio("a", "b"))


@query("X8_sequence_ratio")
def x8(spark, d):
    return tag_pairs(spark, d).select("a", "b", "ratio")


@query("X9_near_duplicate_labels")
def x9(spark, d):
    return near_groups(tag_pairs(spark, d), tags(spark, d).select("tenant_id", F.col("tag_id").alias("id")), 0.85)


def near_groups(pairs, members, threshold: float):
    """Greedy groups in order of id: a label joins the first earlier group head that it is near to; not transitive."""

    def group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        near = {}
        for a, b, r in zip(pdf["a_id"], pdf["b_id"], pdf["ratio"], strict=True):
            if r >= threshold:
                near.setdefault(b, []).append(a)
        head: dict = {}
        for i in sorted({*pdf["a_id"], *pdf["b_id"]}):
            head[i] = next((h for h in sorted(near.get(i, [])) if head.get(h) == h), i)
        return pd.DataFrame({"tenant_id": key[0], "id": list(head), "head": list(head.values())})

    # the labels of one tenant are a vocabulary of bounded size
    found = pairs.select("tenant_id", "a_id", "b_id", "ratio").groupBy("tenant_id").applyInPandas(group, "tenant_id long, id long, head long")
    return members.join(found, ["tenant_id", "id"], "left").select("tenant_id", "id", F.coalesce("head", "id").alias("head"))


KEYWORDS = {"articles": ["the", "der", "die", "le", "la"], "endings": ["tion", "ing", "ung", "ment"], "rare": ["zzz"]}


def keyword_scores(text, keywords: dict[str, list[str]]):
    """Occurrences of each category's keywords in a text, as (score, order, category)."""
    low = F.lower(text)
    return [F.struct(sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0)).alias("score"), F.lit(-k).alias("k"), F.lit(c).alias("category")) for k, (c, words) in enumerate(keywords.items())]


def occurrences(words: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(lower(text), '{w}'))" for w in words)


def frequent_words(texts, id_col: str, text_col: str, most: int = 3):
    """(id, words): a text's most frequent words of more than three letters, ties by place; texts without one give no row."""
    words = texts.select(id_col, F.posexplode(F.split(F.lower(text_col), r"[ \t\n\f\r\x0B]+")).alias("at", "w")).where(F.length("w") > 3)
    counts = words.groupBy(id_col, "w").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "at"))
    top = counts.withColumn("k", place).where(F.col("k") <= most)
    return top.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), ", ").alias("words"))


@query("X14_keyword_category", f"""WITH scored AS (SELECT doc_id, text, {occurrences(KEYWORDS['articles'])} AS a, {occurrences(KEYWORDS['endings'])} AS e FROM documents),
words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r\\x0B]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r\\x0B]+'), 1) AS pos FROM scored WHERE a = 0 AND e = 0),
counts AS (SELECT doc_id, w, count(*) AS n, min(pos) AS pos FROM words WHERE length(w) > 3 GROUP BY 1, 2),
top AS (SELECT doc_id, string_agg(w, ', ' ORDER BY n DESC, pos) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM counts) WHERE k <= 3 GROUP BY 1)
SELECT doc_id, CASE WHEN a >= e AND a > 0 THEN 'articles' WHEN e > 0 THEN 'endings' WHEN words IS NOT NULL THEN 'Argomento: ' || words ELSE 'Cluster ' || CAST(doc_id AS VARCHAR) END AS category FROM scored LEFT JOIN top USING (doc_id)""")
def x14(spark, d):
    # texts without any keyword are named by their most frequent words, else by their number
    best = F.greatest(*keyword_scores(F.col("text"), KEYWORDS))
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(best["score"] > 0, best["category"]).alias("found"))
    rest = frequent_words(docs.where("found is null"), "doc_id", "text")
    named = F.coalesce("found", F.concat(F.lit("Argomento: "), "words"), F.concat(F.lit("Cluster "), F.col("doc_id").cast("string")))
    return docs.drop("text").join(rest, "doc_id", "left").select("doc_id", named.alias("category"))


@query("X15_keyword_presence", "SELECT doc_id, CASE WHEN a >= e AND a > 0 THEN 'articles' WHEN e > 0 THEN 'endings' ELSE 'altro' END AS tag FROM (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in KEYWORDS["articles"]) + " AS a, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in KEYWORDS["endings"]) + " AS e FROM documents)")
def x15(spark, d):
    low = F.lower("text")
    best = F.greatest(*(F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-k).alias("k"), F.lit(c).alias("category")) for k, (c, words) in enumerate(KEYWORDS.items())))
    return table(spark, d, "documents").withColumn("best", best).select("doc_id", F.when(F.col("best.score") > 0, F.col("best.category")).otherwise("altro").alias("tag"))


PATTERNS = {"access": [r"th.*er", r"idiot"], "booking": [r"qu[ae]\s+de", r"verpf"], "info": [r"^\s*the\b"]}


#: Categories tried in turn where no intent is found.
FALLBACK = {"contact": [r"@", r"tel"], "numbers": [r"[0-9]{2}"]}


@query("X16_regex_intents", "WITH found AS (SELECT doc_id, t, list_filter([CASE WHEN regexp_matches(t, 'th.*er') OR regexp_matches(t, 'idiot') THEN 'access' END, CASE WHEN regexp_matches(t, 'qu[ae]\\s+de') OR regexp_matches(t, 'verpf') THEN 'booking' END, CASE WHEN regexp_matches(t, '^\\s*the\\b') THEN 'info' END], lambda x: x IS NOT NULL) AS intents FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, CASE WHEN len(intents) > 0 THEN intents WHEN contains(t, '@') OR contains(t, 'tel') THEN ['contact'] WHEN regexp_matches(t, '[0-9]{2}') THEN ['numbers'] ELSE ['altro'] END AS intents FROM found")
def x16(spark, d):
    t = F.lower("text")
    hit = lambda ps: F.coalesce(reduce(lambda a, b: a | b, (t.rlike(p) for p in ps)), F.lit(False))
    found = F.array_compact(F.array(*(F.when(hit(ps), name) for name, ps in PATTERNS.items())))
    other = F.coalesce(*(F.when(hit(ps), F.array(F.lit(name))) for name, ps in FALLBACK.items()), F.array(F.lit("altro")))
    return table(spark, d, "documents").select("doc_id", F.when(F.size(found) > 0, found).otherwise(other).alias("intents"))


@query("X18_match_bucket", with_(FACTS) + "SELECT session_id, CASE WHEN llm_conf >= .95 THEN 'exact' WHEN llm_conf >= .85 THEN 'high' WHEN llm_conf >= .7 THEN 'medium' WHEN llm_conf >= .5 THEN 'low' ELSE 'none' END AS bucket FROM facts")
def x18(spark, d):
    return facts(spark, d).select("session_id", L.match_bucket(F.col("llm_conf")).alias("bucket"))


@query("X19_word_overlap", "SELECT d.conv_id, d.turn, b.item_id, CAST(len(list_filter(regexp_split_to_array(lower(b.text), '[ \\t\\n\\f\\r\\x0B]+'), lambda w: length(w) > 3 AND contains(lower(d.text), w))) AS DOUBLE) + CASE WHEN abs(length(d.text) - length(b.text)) < 50 THEN 0.5 ELSE 0.0 END AS score FROM conversations d CROSS JOIN benchmark b")
def x19(spark, d):
    # every message against the stated set of examples, whose different words are looked for once in each message
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3)
    examples = table(spark, d, "benchmark").select("item_id", F.length("text").alias("size"), words.alias("words"))
    known = examples.select(F.explode("words").alias("word")).agg(F.array_sort(F.collect_set("word")).alias("known"))  # one row
    numbered = examples.crossJoin(F.broadcast(known)).select("item_id", "size", F.transform("words", lambda w: F.array_position("known", w).cast("int")).alias("at"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small tables are one file, and pairs are many
    said = table(spark, d, "conversations").select("conv_id", "turn", "text").repartition(parts, "conv_id", "turn").select("conv_id", "turn", F.lower("text").alias("low"), F.length("text").alias("length"))
    held = said.crossJoin(F.broadcast(known)).select("conv_id", "turn", "length", F.transform("known", lambda w: F.contains(F.col("low"), w)).alias("found"))
    close = F.when(F.abs(F.col("length") - F.col("size")) < 50, 0.5).otherwise(0.0)
    return held.crossJoin(F.broadcast(numbered)).select("conv_id", "turn", "item_id", (F.size(F.filter("at", lambda k: F.element_at("found", k))) + close).alias("score"))


@query("X21_template", with_(FACTS) + "SELECT session_id, 'Label ' || coalesce(label, '{{label}}') || ' for ' || CAST(user_id AS STRING) || ' in {{missing}}' AS prompt FROM facts")
def x21(spark, d):
    return facts(spark, d).select("session_id", render(F.lit("Label {{label}} for {{user}} in {{missing}}"), {"label": F.col("label"), "user": F.col("user_id").cast("string")}).alias("prompt"))


def render(template, values: dict):
    """A template with its ``{{name}}`` filled in; names without a value stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("{{" + name + "}}")))
    return template


@query("X22_joined_examples", with_(TAGS) + "SELECT tenant_id, string_agg(tag_description, chr(10) || chr(10) ORDER BY tag_id) AS examples FROM tags WHERE tag_description IS NOT NULL GROUP BY tenant_id")
def x22(spark, d):
    rows = tags(spark, d).where("tag_description IS NOT NULL").groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("tag_id", "tag_description"))).alias("x"))
    return rows.select("tenant_id", F.array_join("x.tag_description", "\n\n").alias("examples"))


@query("X23_append_note", with_(TAGS) + "SELECT tag_id, coalesce(tag_description, '') || ' [checked]' AS notes FROM tags")
def x23(spark, d):
    return tags(spark, d).select("tag_id", F.concat(F.coalesce("tag_description", F.lit("")), F.lit(" [checked]")).alias("notes"))


@query("X24_synthetic_text", with_(FACTS) + "SELECT session_id, CASE label WHEN 'altro' THEN 'Ho una domanda generale sui vostri servizi.' ELSE 'Richiesta relativa a ' || label || '. Potete aiutarmi?' END AS text FROM facts WHERE label IS NOT NULL")
def x24(spark, d):
    known = F.create_map(F.lit("altro"), F.lit("Ho una domanda generale sui vostri servizi."))
    return facts(spark, d).where("label IS NOT NULL").select("session_id", F.coalesce(known[F.col("label")], F.format_string("Richiesta relativa a %s. Potete aiutarmi?", "label")).alias("text"))


@query("X25_canonical_label", with_(FACTS) + "SELECT session_id, CASE WHEN label IN ('click', 'view') THEN 'interaction' WHEN label IN ('signup', 'purchase') THEN 'conversion' ELSE label END AS label FROM facts")
def x25(spark, d):
    rules = spark.sql("SELECT * FROM VALUES ('click', 'interaction'), ('view', 'interaction'), ('signup', 'conversion'), ('purchase', 'conversion') AS t(source, target)")
    return facts(spark, d).join(rules, F.col("label") == F.col("source"), "left").select("session_id", F.coalesce("target", "label").alias("label"))


# -- numbers ------------------------------------------------------------------------

#: Three class probabilities for each session, from its predictions.
P = "[ml_conf / 2, (1 - ml_conf) / 2, CAST(0.5 AS DOUBLE)]"


def probabilities(spark, d):
    p = F.array(F.col("ml_conf") / 2, (1 - F.col("ml_conf")) / 2, F.lit(0.5))
    return facts(spark, d).where("ml_conf IS NOT NULL").select("session_id", p.alias("p"))


H = "list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * log2(x)))"


@query("M3_entropy", with_(FACTS) + f"SELECT session_id, round({H}, 4) AS h FROM (SELECT session_id, {P} AS p FROM facts WHERE ml_conf IS NOT NULL)")
def m3(spark, d):
    return probabilities(spark, d).select("session_id", F.round(N.entropy(F.col("p")), 4).alias("h"))


@query("M4_normalised_entropy", with_(FACTS) + f"SELECT session_id, round(list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * log2(x + 1e-10))) / log2(3), 4) AS u FROM (SELECT session_id, {P} AS p FROM facts WHERE ml_conf IS NOT NULL)")
def m4(spark, d):
    return probabilities(spark, d).select("session_id", F.round(N.normalised_entropy(F.col("p")), 4).alias("u"))


@query("M5_conflict_severity", with_(FACTS) + f"SELECT session_id, round(least(1.0, least({H} / log2(3), 1.0) * 0.4 + (1 - list_max(p)) * 0.4 + (2.0 / 3) * 0.2), 4) AS severity FROM (SELECT session_id, {P} AS p FROM facts WHERE ml_conf IS NOT NULL)")
def m5(spark, d):
    return probabilities(spark, d).select("session_id", F.round(N.conflict_severity(F.col("p")), 4).alias("severity"))


@query("M6_decile", with_(FACTS) + "SELECT session_id, CAST(floor(round(ml_conf * 10, 6)) * 10 AS BIGINT) AS decile FROM facts WHERE ml_conf IS NOT NULL")
def m6(spark, d):
    return facts(spark, d).where("ml_conf IS NOT NULL").select("session_id", (F.floor(F.round(F.col("ml_conf") * 10, 6)) * 10).alias("decile"))


@query("M7_clamp", with_(FACTS) + "SELECT session_id, round(greatest(0, least(1, ml_conf * 2 - 0.5)), 4) AS c FROM facts WHERE ml_conf IS NOT NULL")
def m7(spark, d):
    return facts(spark, d).where("ml_conf IS NOT NULL").select("session_id", F.round(N.clamp(F.col("ml_conf") * 2 - 0.5), 4).alias("c"))


@query("M8_round", with_(FACTS) + "SELECT session_id, round(ml_conf / 3, 3) AS r FROM facts WHERE ml_conf IS NOT NULL")
def m8(spark, d):
    return facts(spark, d).where("ml_conf IS NOT NULL").select("session_id", F.round(F.col("ml_conf") / 3, 3).alias("r"))


# -- vectors ------------------------------------------------------------------------

COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("V1_cosine", with_(VECTORS) + f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS similarity FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def v1(spark, d):
    a = vectors(spark, d).select(F.col("vec_id").alias("a"), F.col("v").alias("x"))
    b = vectors(spark, d).select(F.col("vec_id").alias("b"), F.col("v").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(N.cosine(F.col("x"), F.col("y")), 4).alias("similarity"))


CENTROIDS = ", parts AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vectors), means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL), centroids AS (SELECT label, list(x ORDER BY i) AS c FROM means GROUP BY label), far AS (SELECT vec_id, label, sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM vectors JOIN centroids USING (label))\n"


@query("V3_centroid_distance", with_(VECTORS) + CENTROIDS + "SELECT vec_id, round(distance, 4) AS distance FROM far")
def v3(spark, d):
    from sessionloom.operators.vectors import centroid_distances

    return centroid_distances(vectors(spark, d), "label").select("vec_id", F.round("distance", 4).alias("distance"))


@query("V4_radius", with_(VECTORS) + CENTROIDS + "SELECT label, round(quantile_cont(distance, 0.75), 4) AS radius FROM far GROUP BY label")
def v4(spark, d):
    from sessionloom.operators.vectors import centroid_distances, percentiles

    return percentiles(centroid_distances(vectors(spark, d), "label"), "label", "distance", 0.75, "radius").select("label", F.round("radius", 4).alias("radius"))


@query("W5_closest_to_centroid", with_(VECTORS) + CENTROIDS + "SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS rn FROM far) WHERE rn <= 3")
def w5(spark, d):
    from sessionloom.operators.vectors import centroid_distances

    order = Window.partitionBy("label").orderBy(F.round("distance", 9), "vec_id")
    return centroid_distances(vectors(spark, d), "label").withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("label", "vec_id")


@query("V6_affinity", with_(VECTORS) + CENTROIDS + "SELECT vec_id, round(greatest(0.1, 1 - distance / (2 * r)), 4) AS affinity FROM far JOIN (SELECT label, quantile_cont(distance, 0.75) AS r FROM far GROUP BY label) USING (label)")
def v6(spark, d):
    from sessionloom.operators.vectors import centroid_distances, percentiles

    far = centroid_distances(vectors(spark, d), "label")
    return far.join(percentiles(far, "label", "distance", 0.75, "r"), "label").select("vec_id", F.round(N.affinity(F.col("distance"), F.col("r")), 4).alias("affinity"))


def label_maps(spark, d):
    """The label distribution of each cluster, as a map."""
    counts = facts(spark, d).where("cluster_id IS NOT NULL AND label IS NOT NULL").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.col("n").cast("double"))))).alias("m")).select("cluster_id", N.to_unit_sum(F.col("m")).alias("m"))


DIST = ", c AS (SELECT cluster_id, label, count(*) AS n FROM facts WHERE cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2), p AS (SELECT cluster_id, label, n / sum(n) OVER (PARTITION BY cluster_id) AS p FROM c)\n"


@query("V5_bhattacharyya", with_(FACTS) + DIST + "SELECT b.cluster_id, round(sum(sqrt(a.p * b.p)), 4) AS overlap FROM p a JOIN p b ON a.label = b.label WHERE a.cluster_id = '1' GROUP BY b.cluster_id")
def v5(spark, d):
    maps = label_maps(spark, d)
    one = maps.where("cluster_id = '1'").select(F.col("m").alias("q"))  # a single row
    return maps.crossJoin(F.broadcast(one)).select("cluster_id", F.round(N.bhattacharyya(F.col("m"), F.col("q")), 4).alias("overlap"))


@query("V7_unit_sum", with_(FACTS) + DIST + "SELECT cluster_id, label, round(p, 4) AS p FROM p")
def v7(spark, d):
    return label_maps(spark, d).select("cluster_id", F.explode("m").alias("label", "p")).withColumn("p", F.round("p", 4))


@query("V8_concatenated_features", with_(VECTORS) + "SELECT vec_id, CAST(len(list_concat(v, [CAST(label AS DOUBLE), CAST(1 AS DOUBLE)])) AS BIGINT) AS width, round(list_sum(list_concat(v, [CAST(label AS DOUBLE), CAST(1 AS DOUBLE)])), 4) AS total FROM vectors")
def v8(spark, d):
    both = vectors(spark, d).select("vec_id", F.concat("v", F.array(F.col("label").cast("double"), F.lit(1.0))).alias("f"))
    return both.select("vec_id", F.size("f").cast("long").alias("width"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# -- JSON and hashes ----------------------------------------------------------------

RESPONSE = """CASE session_id % 4 WHEN 0 THEN '{"predicted_label": "' || event_type || '", "confidence": 1.4, "motivation": ""}' WHEN 1 THEN 'Sure: {"predicted_label": "' || event_type || '", "confidence": 0.5, "motivation": "seen"} done' WHEN 2 THEN '{"predicted_label": "' || event_type || '", "confidence": 0.25,}' ELSE 'I think ' || event_type || ' at 80%' END"""
RESPONSES = f", r AS (SELECT session_id, event_type, {RESPONSE} AS raw FROM (SELECT event_id AS session_id, event_type FROM events))\n"


def responses(spark, d):
    return table(spark, d, "events").selectExpr("event_id AS session_id", "event_type").selectExpr("session_id", "event_type", f"{RESPONSE} AS raw")


@query("JS1_repair_json", with_(FACTS) + RESPONSES + """SELECT session_id, CASE session_id % 4 WHEN 0 THEN raw WHEN 1 THEN regexp_extract(raw, '(\\{[^{}]*\\})', 1) WHEN 2 THEN replace(raw, ',}', '}') END AS repaired FROM r""")
def js1(spark, d):
    return responses(spark, d).select("session_id", N.repair_json(F.col("raw")).alias("repaired"))


@query("JS2_parse_response", with_(FACTS) + RESPONSES + """SELECT session_id, CASE WHEN session_id % 4 < 3 THEN event_type END AS label, CAST(CASE session_id % 4 WHEN 0 THEN 1 WHEN 1 THEN .5 WHEN 2 THEN .25 END AS DOUBLE) AS confidence, CASE session_id % 4 WHEN 1 THEN 'seen' WHEN 0 THEN 'Classificato come ' || event_type WHEN 2 THEN 'Classificato come ' || event_type END AS motivation FROM r""")
def js2(spark, d):
    rows = parsed(responses(spark, d))
    label = F.lower(F.trim("predicted_label"))
    motivation = F.coalesce(F.nullif(F.trim("motivation"), F.lit("")), F.concat(F.lit("Classificato come "), label))
    return rows.select("session_id", label.alias("label"), N.clamp(F.col("confidence")).alias("confidence"), motivation.alias("motivation")).withColumn("confidence", F.when(F.col("label").isNotNull(), F.col("confidence")))


def parsed(rows):
    """Responses with the fields of their repaired JSON; a response is repaired and parsed once, however many fields are used."""
    j = F.from_json(N.repair_json(F.col("raw")), "predicted_label string, confidence double, motivation string")
    return rows.select("*", F.inline(F.array(j)))


KNOWN = ["click", "view", "error", "signup", "purchase"]


@query("JS3_heuristic_parse", with_(FACTS) + RESPONSES + "SELECT session_id, event_type AS label, CAST(0.8 AS DOUBLE) AS confidence FROM r WHERE session_id % 4 = 3")
def js3(spark, d):
    low = F.lower("raw")
    named = F.filter(F.array(*map(F.lit, KNOWN)), lambda x: F.contains(low, x) | F.contains(low, F.replace(x, F.lit("_"), F.lit(" "))))
    number = F.nullif(F.regexp_extract("raw", r"(\d+\.?\d*)%?", 1), F.lit("")).cast("double")
    share = N.clamp(F.when(number > 1, number / 100).otherwise(number))
    # what no repair makes JSON of
    rows = parsed(responses(spark, d)).where("predicted_label IS NULL").select("session_id", "raw").withColumn("named", named)
    confidence = F.when(F.size("named") == 1, F.coalesce(share, F.lit(0.4))).when(F.size("named") > 1, 0.2).otherwise(0.1)
    return rows.select("session_id", F.when(F.size("named") == 1, F.get("named", F.lit(0))).otherwise("altro").alias("label"), confidence.alias("confidence"))


@query("JS4_extract_tag", with_(FACTS) + RESPONSES + "SELECT session_id, event_type AS tag FROM r")
def js4(spark, d):
    text = F.when(F.col("session_id") % 4 == 3, F.concat(F.lit("Tag: "), "event_type", F.lit(", sure"))).otherwise(F.col("raw"))
    keys = ("predicted_label", "label", "tag", "classification")
    rows = responses(spark, d).select("session_id", text.alias("text")).select("*", F.inline(F.array(F.from_json(N.repair_json(F.col("text")), ", ".join(f"{k} string" for k in keys)))))
    text, fields = F.col("text"), [F.col(k) for k in keys]
    patterns = [F.regexp_extract(text, p, 1) for p in (r"(?i)tag:\s*([^,\n]+)", r"(?i)etichetta:\s*([^,\n]+)", r"(?i)classif[ic]*azione:\s*([^,\n]+)", r"(?i)suggerisco:\s*([^,\n]+)")]
    found = F.coalesce(*(F.nullif(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("altro")) for c in [*fields, *patterns]), F.lit(""))
    return rows.select("session_id", found.alias("tag"))


@query("JS5_valid_schema", "SELECT event_id, json_valid(props) AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS valid FROM events")
def js5(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint").isNotNull(), F.lit(False)).alias("valid"))


@query("JS6_dotted_path", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS missing FROM events")
def js6(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("missing"))


@query("H3_hash_label")
def h3(spark, d):
    # a hash that is the same in every run, on purpose
    return table(spark, d, "documents").select("doc_id", F.pmod(F.xxhash64("text"), F.lit(5)).alias("bucket"))
