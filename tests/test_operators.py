"""Operators on small tables with hand-checked results, and against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import labels as L
from sessionloom.functions import numbers as N
from sessionloom.operators import clusters as C
from sessionloom.operators.density import density_clusters
from sessionloom.operators.graph import connected_components
from sessionloom.operators.sessions import drop_trivial_sessions, fold_sessions
from sessionloom.operators.vectors import nearest
from sessionloom.sources import jsonl, merge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fold_orders_messages_and_counts_null_texts_as_empty(spark):
    rows = [(1, 2, "AGENT", "b"), (1, 1, "USER", "a"), (1, 3, "USER", None), (1, 4, "AGENT", "d"), (2, 1, "SYSTEM", "x")]
    got = fold_sessions(spark.createDataFrame(rows, "session_id long, position long, said_by string, message string")).collect()
    assert [(r["session_id"], r["n_messages"], r["n_user"], r["full_text"]) for r in got] == [(1, 4, 2, "[UTENTE]  [ASSISTENTE] d")]


def test_trivial_sessions_go(spark):
    rows = [(1, 1, "USER", "Ciao"), (1, 2, "AGENT", "Sono l'assistente digitale, come posso aiutarti?"), (2, 1, "USER", "Vorrei prenotare una visita per domani mattina"), (3, 1, "USER", "ok")]
    got = drop_trivial_sessions(fold_sessions(spark.createDataFrame(rows, "session_id long, position long, said_by string, message string")))
    assert [r["session_id"] for r in got.collect()] == [2]


@pytest.mark.parametrize(("function", "label", "want"), [(L.normalise_memory, "  Già Fatto!  Due ", "gi_fatto_due"), (L.normalise_plain, "Già Fatto!", "già_fatto"), (L.normalise_dedup, "Prenotazioni visite", "prenotazione_visite"), (L.clean_topic_name, "0_a--b_", "a_b"), (L.clean_topic_name, "12_", "sconosciuto"), (L.clean_topic_name, None, "sconosciuto")])
def test_label_functions(spark, function, label, want):
    assert one(spark, function(F.lit(label).cast("string"))) == want


def test_resolve_label(spark):
    known, fixed, words = ["info_esami", "ritiro_referti", "altro"], {"medico": "parere_medico"}, {"ritiro_": ["ritira"]}
    got = [one(spark, L.resolve_label(F.lit(x), known, fixed, words)) for x in ("altro", "medico", "info_esame", "lui_ritira", "xyz")]
    assert got == ["altro", "parere_medico", "info_esami", "ritiro_referti", "altro"]


def test_repair_json(spark):
    got = [one(spark, N.repair_json(F.lit(x))) for x in ('{"a": 1}', 'so {"a": 1} there', "{a: 1}", '{"a": 1,}', "nothing", "")]
    assert [json.loads(x) if x else None for x in got] == [{"a": 1}] * 4 + [None, None]


def test_consensus_cases(spark):
    votes = [(1, 1, "a", 0.9), (1, 2, "a", 0.7), (1, 3, "b", 0.95), (2, 1, "a", 0.4), (2, 2, "b", 0.6), (3, 1, "a", 0.2), (4, 1, None, 0.9)]
    got = {r["cluster_id"]: (r["label"], round(r["confidence"], 4)) for r in C.consensus(spark.createDataFrame(votes, "cluster_id long, rep_id long, label string, confidence double")).collect()}
    assert got == {1: ("a", round(0.8 + (2 / 3 - 0.6) * 0.25, 4)), 2: ("b", 0.48), 3: ("a", 0.3)}


def test_review_budget(spark):
    sizes = [("a", 60), ("b", 20), ("c", 20), ("d", 2), ("e", 1)]
    got = {r["cluster_id"]: r["slots"] for r in C.review_budget(spark.createDataFrame(sizes, "cluster_id string, size long"), 11).collect()}
    assert got == {"a": 5, "b": 4, "c": 2, "d": 0, "e": 0}


def test_upsert_rules(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "y")], "k long, v string, w string")
    batch = spark.createDataFrame([(1, None, "z"), (2, "B", "z"), (3, "c", "z"), (None, "N", "z")], "k long, v string, w string")
    got = sorted(map(tuple, merge.upsert(base, batch, ["k"], keep=("w",)).collect()), key=str)
    assert got == sorted([(1, "a", "x"), (2, "B", "z"), (3, "c", "z"), (None, "N", "y")], key=str)
    only = merge.upsert(base, batch, ["k"], only=F.col("b.w").isNull())
    assert sorted(map(tuple, only.collect()), key=str) == sorted([(1, "a", "x"), (2, "B", "z"), (3, "c", "z"), (None, "n", "y")], key=str)


def test_replace_table_reads_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.replace_table(spark.range(5).toDF("k"), path)
    merge.replace_table(spark.read.parquet(path).where("k > 2"), path)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [3, 4]


def test_decision_log(spark, tmp_path):
    path = f"{tmp_path}/log.jsonl"
    with open(path, "w") as f:
        f.write('{"session_id": "s1", "human_decision": "a", "human_confidence": 0.9}\n\n{broken\n{"human_decision": "b"}\n{"session_id": "s1", "human_decision": "c"}\n')
    assert jsonl.count_lines(spark, path) == 4
    assert sorted(r["human_decision"] for r in jsonl.read_decisions(spark, path).collect()) == ["a", "c"]
    jsonl.append_json(spark.createDataFrame([("s2", "d")], "session_id string, human_decision string"), f"{tmp_path}/more")
    jsonl.append_json(spark.createDataFrame([("s3", "e")], "session_id string, human_decision string"), f"{tmp_path}/more")
    assert jsonl.read_decisions(spark, f"{tmp_path}/more").count() == 2


def test_components_against_brute_force(spark):
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: min(y for y in parent if root(y) == root(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, *edges[:3], (5, None)], "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    random = np.random.default_rng(7)
    centres = random.normal(size=(3, 8))
    rows = [(k * 20 + i, k, [float(x) for x in centres[k] * 5 + random.normal(size=8) * 0.3]) for k in range(3) for i in range(20)] + [(100 + i, 9, [float(x) for x in random.normal(size=8)]) for i in range(4)]
    return rows, spark.createDataFrame(rows, "id long, c long, v array<double>").repartition(3)


def test_nearest_against_brute_force(points):
    rows, df = points
    m = np.array([v for *_, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([r[0] for r in rows])
    got = {(r["query_id"], r["place"]): r["id"] for r in nearest(df.where("id < 5").withColumnRenamed("id", "query_id"), df, 4).collect()}
    for q in range(5):
        s = m @ m[list(ids).index(q)]
        order = sorted(range(len(ids)), key=lambda k: (-round(s[k], 12), ids[k]))
        assert [got[q, p] for p in (1, 2, 3, 4)] == [ids[k] for k in order[:4]]


def test_density_clusters_links_groups_of_copies_within_the_cut(spark):
    # every copy's nearest rows are its own copies; the third group is far away
    angles = [0.0] * 15 + [0.1] * 15 + [1.5] * 15
    df = spark.createDataFrame([(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angles)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in density_clusters(df, cut=0.2).collect()}
    assert got == {k: 0 if k < 30 else 30 for k in range(45)}


def test_density_clusters_finds_the_blobs(points):
    rows, df = points
    got = {r["id"]: r["cluster"] for r in density_clusters(df, quantile=0.9).collect()}
    for k in range(3):
        assert len({got[k * 20 + i] for i in range(20)} - {-1}) == 1
    assert len({got[0], got[20], got[40]}) == 3 and len(got) == len(rows)


def test_diverse_representatives_against_brute_force(points):
    rows, df = points
    got = {}
    for r in C.diverse_representatives(df, "c").collect():
        got.setdefault(r["c"], {})[r["rank"]] = r["id"]
    for k in (0, 1, 2, 9):
        members = [(i, np.array(v)) for i, c, v in rows if c == k]
        n = 4 if len(members) > 10 else 3
        centre = np.mean([v for _, v in members], axis=0)
        chosen = [min(members, key=lambda m: (round(float(np.linalg.norm(m[1] - centre)), 9), m[0]))]
        while len(chosen) < n:
            left = [m for m in members if m[0] not in {x[0] for x in chosen}]
            chosen.append(max(left, key=lambda m: (round(min(float(np.linalg.norm(m[1] - x[1])) for x in chosen), 9), -m[0])))
        assert [got[k][p + 1] for p in range(n)] == [m[0] for m in chosen]


def test_scorer_failure_keeps_the_batch(spark):
    from sessionloom.operators.models import score_texts

    class Failing:
        def classify(self, texts):
            raise RuntimeError("down")

    got = score_texts(spark.createDataFrame([(1, "a"), (2, None)], "i long, t string"), "i", "t", Failing()).collect()
    assert [(r["label"], r["confidence"]) for r in got] == [("altro", 0.1)] * 2


def test_streaming(spark, tmp_path):
    from sessionloom.streaming.incremental import capped_memory, label_counts, new_only

    rows = spark.range(200).selectExpr("id AS session_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS label", "0.5D AS confidence", "timestamp_seconds(id * 60) AS ts")
    path = f"{tmp_path}/in"
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(new_only(stream, rows.where("session_id < 150")), "append", "fresh").count() == 50
    counts = run(label_counts(stream), "complete", "counts")
    assert counts.agg(F.sum("n")).first()[0] == 200
    memory = {r["label"]: (r["n"], r["oldest"]) for r in run(capped_memory(stream, 10), "update", "memory").collect()}
    assert memory == {"a": (10, 180), "b": (10, 181)}


def test_regions_split_while_labels_conflict(spark):
    rows = [(k, "c1", "ab"[k % 2]) for k in range(20)] + [(100 + k, "c2", "a") for k in range(9)] + [(200 + k, "c3", "abcdefg"[k % 7]) for k in range(14)]
    got = {}
    for r in C.refine_regions(spark.createDataFrame(rows, "session_id long, cluster_id string, label string"), severe=0.6).collect():
        got.setdefault(r["region"], []).append(r["session_id"])
    assert {k: len(v) for k, v in got.items()} == {"c1:a": 10, "c1:b": 10, "c2": 9, "c3": 14}


def test_linkage_groups_and_tuning():
    same = lambda a, b: float(a[0] == b[0])
    assert C.linkage_groups(["a1", "b1", "a2", "b2", "a3"], same, 2) == [0, 1, 0, 1, 0]
    assert C.linkage_groups([], same) == [] and C.linkage_groups(["x"], same) == [0]
    assert C.tuned({"min_cluster_size": 5, "min_samples": 3}, 0.5, 10) == {"min_cluster_size": 4, "min_samples": 2}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables_of_vectors(spark, n):
    df = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(n)], "id long, v array<double>")
    assert density_clusters(df).count() == n
    assert nearest(df.withColumnRenamed("id", "query_id"), df, 5).count() == n * n
