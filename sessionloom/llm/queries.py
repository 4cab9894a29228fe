"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .common import fresh_path, likely_in, load, saved
from .divergence import divergence
from .exact_dedup import exact_duplicates
from .fingerprints import fingerprints, with_next
from .html_extract import extract
from .language import held_out, identify, train
from .line_dedup import dedup_lines
from .merkle import concatenated, folded, leaf_hash, merkle_manifest
from .mixing import mix
from .simhash import components_of
from .toxicity import score, train as train_toxicity
from .url_filter import judge_urls
from .warc import read_warc, records_of_pages, write_warc

__all__ = ["oracle_sql", "queries"]


def tokenizer_path() -> str:
    """The vocabulary file the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    path = tokenizer_path()
    decoded = encode(load(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of them."""
    docs = load(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.where(~test))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


#: Explicit rules of the URL filter.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


#: Sites on which a line has to stand to count as boilerplate.
MIN_SITES = 3


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on several sites."""
    found = dedup_lines(load(spark, sf_dir, "documents"), MIN_SITES)
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars_kept"), F.col("lines_removed").cast("long").alias("lines_removed"), F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, pos, line, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS key
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), spread AS (
    SELECT key, min({{'d': doc_id, 'p': pos}}) AS first FROM lines WHERE key <> ''
    GROUP BY key HAVING count(DISTINCT coalesce('s' || source, '')) >= {MIN_SITES}
), marked AS (
    SELECT l.*, s.key IS NOT NULL AND s.first <> {{'d': l.doc_id, 'p': l.pos}} AS gone FROM lines l LEFT JOIN spread s USING (key)
), rebuilt AS (
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS lines_removed
    FROM marked GROUP BY doc_id
)
SELECT doc_id, length(r.text) AS n_chars_kept, coalesce(r.lines_removed, 0) AS lines_removed, sha256(r.text) AS text_sha256
FROM documents LEFT JOIN rebuilt r USING (doc_id)
"""


#: Score from which a text counts as toxic.
TOXIC_FROM = 0.7


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from two thirds of the labels."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    test = held_out(F.col("doc_id"), 3, 1)
    labels = load(spark, sf_dir, "labels").where(~test)
    found = score(docs, train_toxicity(docs.where(~test), labels), keep=["doc_id"])
    return found.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = components_of(load(spark, sf_dir, "documents"), words_per_shingle=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of identical texts of every document, and the one that stays."""
    return exact_duplicates(load(spark, sf_dir, "documents"))


#: Weights that sources take in turn, the mix's share of all words, and the most copies of a document.
MIX = {"weights": [3.0, 1.0, 2.0], "share": 1.5, "max_copies": 2}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    found = mix(load(spark, sf_dir, "documents"), **MIX)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document, and how far they agree."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edit = F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited")
    edited = with_next(docs, "doc_id", "text", ["doc_id", "text"]).select("doc_id", "next_doc_id", "text", n.cast("long").alias("n_chars"), edit)

    def rebuild(rows: DataFrame) -> DataFrame:
        """The texts of some rows and their edited texts, without reading the order of all rows again."""
        needed = saved(rows.select(F.explode(F.array("doc_id", "next_doc_id")).alias("doc_id")).distinct(), "needed")
        some = saved(docs.where(likely_in(needed, "doc_id", F.col("doc_id"))).join(needed, "doc_id", "left_semi"), "compared")
        following = some.select(F.col("doc_id").alias("next_doc_id"), F.col("text").alias("next_text"))
        return rows.join(some, "doc_id").join(following, "next_doc_id").select("doc_id", "text", edit)

    keep = ["doc_id", "next_doc_id", "n_chars", "edited_sha256"]
    found = fingerprints(edited.withColumn("edited_sha256", F.sha2("edited", 256)), {"text": "fingerprint", "edited": "edited_fingerprint"}, keep, rebuild=rebuild)
    led = with_next(found, "doc_id", "fingerprint", ["fingerprint"])
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return led.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back: responses, whose digests are those of the payloads read, and revisits."""
    path = fresh_path(spark, "warc")
    write_warc(records_of_pages(load(spark, sf_dir, "pages"), least_bytes=0), path)
    columns = ["record_id", "record_type", "payload_digest", "payload_length", "refers_to", "digest_ok"]
    found = read_warc(spark, path, columns).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.substring_index(c, ":", -1).cast("long")
    return found.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok")


OP11_SQL = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages
), bits AS (
    SELECT *, list_aggregate(list_transform(string_split(sha1(payload), ''), lambda d: right(bin(strpos('0123456789abcdef', d) + 15), 4)), 'string_agg', '') AS bits FROM payloads
)
SELECT page_id, octet_length(payload) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * k + j + 1, 1) AS INT) * CAST(2 ** (4 - j) AS INT))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN TRUE END AS digest_ok
FROM bits
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents, and the root that each one gives, a seventh of them after tampering."""
    docs = load(spark, sf_dir, "documents")
    leaf = lambda n_chars: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars") + 1))
    found = merkle_manifest(docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), tampered.alias("tampered")), "leaf", "lang", "doc_id", keep=["doc_id", "tampered"])
    told = found.select("doc_id", "leaf", "subroot", "root", F.sha2(concatenated(), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels, and each leaf's path with its proof so far, of trees given by (tree, i, leaf, node)."""
    return f"""
{name}_nodes(tree, level, i, h, n) AS (
    SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, i // 2
), {name}_paths(tree, leaf_i, level, i, node, proof) AS (
    SELECT tree, i, 0, i, node, '' FROM {leaves}
    UNION ALL
    SELECT p.tree, p.leaf_i, p.level + 1, p.i // 2,
           sha256(CASE WHEN s.h IS NULL THEN p.node WHEN p.i % 2 = 0 THEN p.node || s.h ELSE s.h || p.node END), p.proof || coalesce(s.h, '')
    FROM {name}_paths p JOIN {name}_nodes t ON t.tree = p.tree AND t.level = p.level AND t.i = p.i AND t.n > 1
    LEFT JOIN {name}_nodes s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, CAST(1 AS BIGINT))
), {name}_tops AS (
    SELECT p.tree, p.leaf_i, p.node, p.proof, t.h AS top FROM {name}_paths p JOIN {name}_nodes t ON t.tree = p.tree AND t.level = p.level AND t.n = 1
)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


# crc32 of a decimal id, bit by bit, as DuckDB has no function for it
OP12_SQL = f"""
WITH RECURSIVE crcs(doc_id, rest, crc) AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL
    SELECT doc_id, substr(rest, 2), list_reduce(list_prepend(xor(crc, CAST(ascii(rest) AS BIGINT)), [CAST(k AS BIGINT) for k in range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) FROM crcs WHERE rest <> ''
), hashed AS (
    SELECT doc_id, coalesce('s' || lang, '') AS tree, {{leaf}} AS leaf,
           CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 7 = 0 THEN {{tampered}} ELSE {{leaf}} END AS node
    FROM documents LEFT JOIN (SELECT doc_id, crc FROM crcs WHERE rest = '') USING (doc_id)
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), {_tree_sql("low", "leaves").strip()}, subroots AS (
    SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, tree AS own, h AS leaf, h AS node FROM low_nodes WHERE n = 1
), {_tree_sql("high", "subroots").strip()}, tampered AS (
    SELECT l.tree, l.i, s.i AS high_i, p.proof, 0 AS forest, p.node AS node FROM leaves l JOIN low_tops p ON p.tree = l.tree AND p.leaf_i = l.i JOIN subroots s ON s.own = l.tree
), rising(tree, i, level, high_i, node) AS (
    SELECT tree, i, 0, high_i, node FROM tampered
    UNION ALL
    SELECT r.tree, r.i, r.level + 1, r.high_i // 2, sha256(CASE WHEN s.h IS NULL THEN r.node WHEN r.high_i % 2 = 0 THEN r.node || s.h ELSE s.h || r.node END)
    FROM rising r JOIN high_nodes t ON t.level = r.level AND t.i = r.high_i AND t.n > 1 LEFT JOIN high_nodes s ON s.level = r.level AND s.i = xor(r.high_i, CAST(1 AS BIGINT))
)
SELECT l.doc_id, l.leaf, s.leaf AS subroot, h.top AS root, sha256(p.proof || h.proof) AS proof_sha256, r.node AS folded_root, r.node = h.top AS verified
FROM leaves l JOIN low_tops p ON p.tree = l.tree AND p.leaf_i = l.i JOIN subroots s ON s.own = l.tree JOIN high_tops h ON h.leaf_i = s.i
JOIN rising r ON r.tree = l.tree AND r.i = l.i AND r.level = (SELECT max(level) FROM high_nodes)
""".replace("{leaf}", f"sha256({' || '.join(map(_field_sql, ['doc_id', 'source', 'lang', 'n_chars', 'text']))})").replace("{tampered}", f"sha256({' || '.join(map(_field_sql, ['doc_id', 'source', 'lang', '(n_chars + 1)', 'text']))})")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that mark them."""
    return divergence(load(spark, sf_dir, "documents"), least=30, top=50)


OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sources AS (
    SELECT DISTINCT lang, source FROM docs
), dense AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total, l.v,
           1 + (1000000000 * (k.n + 5)) // CAST(l.total + 5 * l.v AS BIGINT) AS q
    FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), shares AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // CAST(total + 5 * v AS BIGINT) AS p, q FROM dense
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), found AS (
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    return {"op1_bpe": op1_bpe, "op2_html": op2_html, "op3_language": op3_language, "op4_url_filter": op4_url_filter, "op5_line_dedup": op5_line_dedup, "op6_toxicity": op6_toxicity, "op7_simhash": op7_simhash, "op8_mixing": op8_mixing, "op9_fingerprints": op9_fingerprints, "op10_exact_dedup": op10_exact_dedup, "op11_warc": op11_warc, "op12_merkle": op12_merkle, "op13_divergence": op13_divergence}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op5_line_dedup": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op11_warc": OP11_SQL, "op12_merkle": OP12_SQL, "op13_divergence": OP13_SQL}
