"""The shared folder, strict reads, exact percentiles, merges and re-clustered outliers."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionloom.operators import clusters as C
from sessionloom.operators.density import density_clusters, recluster_outliers
from sessionloom.operators.graph import connected_components
from sessionloom.operators.vectors import nearest, percentiles
from sessionloom.plans import queries
from sessionloom.plans.registries import strict
from sessionloom.sources import shared


def test_saved_tables_are_released(spark):
    shared.release(spark)
    df = shared.saved(spark.range(5), "some")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.exists(path)
    assert shared.release(spark) == 1 and not os.path.exists(path)


def test_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"conf": type("Conf", (), {"get": lambda self, k, d=None: d})(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(session)


def test_strict_read_fails_where_nothing_is_there(spark):
    found = spark.createDataFrame([(1, "a")], "k long, v string")
    assert strict(found, spark.createDataFrame([(1,)], "k long"), ["k"], "prompt").collect()[0]["v"] == "a"
    with pytest.raises(PySparkException, match="no prompt for 2"):
        strict(found, spark.createDataFrame([(1,), (2,)], "k long"), ["k"], "prompt").collect()


@pytest.mark.parametrize("share", [0.0, 0.25, 0.75, 1.0])
def test_percentiles_are_exact(spark, share):
    random = np.random.default_rng(3)
    rows = [(0, float(x)) for x in random.normal(size=5000)] + [(1, float(x)) for x in random.integers(0, 4, 300)] + [(2, 5.0), (3, 1.0), (3, 2.0), (4, None)]
    got = {r["k"]: r["p"] for r in percentiles(spark.createDataFrame(rows, "k long, x double").repartition(4), "k", "x", share, "p").collect()}
    assert set(got) == {0, 1, 2, 3}
    for k in got:
        assert got[k] == pytest.approx(np.percentile([x for g, x in rows if g == k], 100 * share), abs=1e-12)


def test_nearest_in_many_blocks(spark, monkeypatch):
    from sessionloom.operators import vectors as V

    monkeypatch.setattr(V, "BLOCK", 16)
    random = np.random.default_rng(1)
    x = random.normal(size=(150, 8))
    df = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "id long, v array<double>, t int")
    got = nearest(df.withColumnRenamed("id", "query_id"), df, 3, "t").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 150, 7):
        near = sorted((k for k in range(150) if k % 2 == q % 2), key=lambda k: (-round(float(unit[q] @ unit[k]), 12), k))[:3]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])] == near


def test_best_pairs_are_disjoint(spark):
    rows = [("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.99), ("a", "e", 0.86), ("f", "g", 0.9), ("e", "f", 0.9)]
    got = {(r["a"], r["b"]) for r in C.disjoint_pairs(spark.createDataFrame(rows, "a string, b string, cosine double")).collect()}
    left, want = sorted(rows, key=lambda r: (-r[2], r[0], r[1])), set()
    while left:
        a, b, _ = left[0]
        want.add((a, b))
        left = [r for r in left if not {a, b} & {r[0], r[1]}]
    assert got == want
    regions = [("r1", "x", 0.8, 10, [1.0, 0.0]), ("r2", "x", 0.9, 4, [1.0, 0.1]), ("r3", "x", 0.9, 2, [1.0, 0.0]), ("r4", "y", 0.9, 10, [1.0, 0.0]), ("r5", "x", 0.6, 10, [1.0, 0.0]), ("r6", "x", 0.9, 10, [0.0, 1.0])]
    found = C.merge_candidates(spark.createDataFrame(regions, "region string, label string, share double, size long, centre array<double>")).collect()
    assert [(r["a"], r["b"]) for r in found] == [("r1", "r2"), ("r2", "r3")]


def test_outliers_of_earlier_runs_make_new_clusters(spark):
    random = np.random.default_rng(8)
    point = lambda angle: [float(np.cos(angle)), float(np.sin(angle))]
    # this run: a cluster, and three rows near to two outliers of earlier runs
    rows = [(k, point(random.normal() * 0.01)) for k in range(12)] + [(20 + k, point(1.489 - 0.001 * k)) for k in range(3)] + [(100 + k, point(1.5 - 0.001 * (30 - k))) for k in range(30)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    clusters = spark.createDataFrame([(k, 7 if k < 12 else -1) for k, _ in rows if k < 100], "id long, cluster long")
    history = spark.createDataFrame([(k,) for k, _ in rows if k >= 100], "id long")
    got = {r["id"]: r["cluster"] for r in recluster_outliers(clusters, history, vectors).collect()}
    # the twenty latest of the thirty earlier ones
    assert set(got) == {20, 21, 22} | set(range(110, 130)) and set(got.values()) <= {8, -1}
    assert [k for k in got if got[k] == -1] == [] or sum(c == 8 for c in got.values()) >= 20
    none = recluster_outliers(clusters.where("id < 21"), history.limit(0), vectors).collect()
    assert [tuple(r) for r in none] == [(20, -1)]


def test_density_clusters_against_brute_force(spark):
    random = np.random.default_rng(12)
    x = np.concatenate([random.normal(c, 0.05, size=(n, 2)) for c, n in (((3, 0), 30), ((0, 3), 25), ((-3, -3), 20), ((2, 2), 4))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    cut, near = 0.03, 3
    core = np.sort(d, axis=1)[:, near] <= cut
    label = {}
    for k in np.flatnonzero(core):
        stack = [k] if k not in label else []
        while stack:
            a = stack.pop()
            if a not in label:
                label[a] = k
                stack += [b for b in np.flatnonzero(core & (d[a] <= cut)) if b not in label]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {r["id"]: r["cluster"] for r in density_clusters(vectors, min_cluster_size=5, min_samples=near, cut=cut).collect()}
    sizes = {c: sum(v == c for v in got.values()) for c in set(got.values())}
    for k in label:
        same = [b for b in label if label[b] == label[k]]
        assert len({got[b] for b in same}) == 1
        assert got[k] == min(same) or sizes[-1] and len(same) < 5


def test_tables_of_random_planes_find_nearly_all_links(spark):
    random = np.random.default_rng(4)
    centres = random.normal(size=(12, 24))
    x = np.concatenate([c + random.normal(scale=0.12, size=(50, 24)) for c in centres] + [random.normal(size=(80, 24))])
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    exact, found = ({r["id"]: r["cluster"] for r in density_clusters(vectors, cut=0.2, tables=t, bucket=20).collect()} for t in (0, 16))
    assert len(set(exact.values())) == 13
    pairs = [(a, b) for a in exact for b in range(0, a, 7) if exact[a] == exact[b] != -1]
    assert sum(found[a] == found[b] != -1 for a, b in pairs) >= 0.9 * len(pairs)
    # and joins nothing that all pairs leave apart
    assert all(exact[k] == exact[found[k]] for k in found if found[k] != -1)


def test_linkage_is_average_linkage():
    near = {("a", "b"): 0.9, ("a", "c"): 0.2, ("b", "c"): 0.4, ("a", "d"): 0.1, ("b", "d"): 0.1, ("c", "d"): 0.35}
    got = C.linkage_groups(list("abcd"), lambda x, y: near[(x, y)], 2)
    assert got == [0, 0, 1, 1] and C.linkage_groups(["a"], None) == [0]


def test_label_queries_against_brute_force(spark, sf):
    import difflib

    for r in queries()["X8_sequence_ratio"](spark, sf).collect():
        assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio(), abs=1e-6)
    assert queries()["SRC10_saved_topics"](spark, sf).where("topic NOT BETWEEN 0 AND 3").count() == 0
    assert queries()["ML1_embedding"](spark, sf).where("dimension != 32 OR length != 1").count() == 0
    assert queries()["H3_hash_label"](spark, sf).where("bucket NOT BETWEEN 0 AND 4").count() == 0


def test_word_overlap_looks_for_words_once_in_a_message(spark, sf):
    from sessionloom import plans

    plan = plans.queries()["X19_word_overlap"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert not any("Contains" in line or "contains(" in line or "lower(" in line for line in plan[:join])


def test_tag_bootstrap_keeps_tags_of_medium_confidence(spark):
    from sessionloom import plans

    assert plans.queries()["Q15_tag_bootstrap"](spark, "/root/testdata/sf0.01").count() > 0


def test_scores_of_topics_move_no_counts_of_frequent_terms(spark, monkeypatch):
    from sessionloom.operators import topics as T

    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 3)], "id long, term string, n long")
    terms = spark.createDataFrame([(0, "a", 0.5), (1, "a", 0.25), (0, "b", 1.0), (1, "c", 2.0)], "topic long, term string, weight double")
    want = [(1, 0, 0.666667), (1, 1, 0.166667), (2, 0, 0.125), (2, 1, 1.5625)]
    # all terms, the one that two texts have, or none are frequent
    for most in (100, 3, 1):
        monkeypatch.setattr(T, "FREQUENT", most)
        assert sorted((r["id"], r["topic"], round(r["score"], 6)) for r in T._scores(counts, terms, "id").collect()) == want


def test_terms_are_counted_where_texts_lie(spark):
    from sessionloom.operators import topics as T

    found = T.term_counts(spark.createDataFrame([(1, "The cat. THE dog, a"), (2, None), (3, "x")], "id long, text string"), "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "cat", 1), (1, "dog", 1), (1, "the", 2)]


def test_saved_leaves_no_shuffle_files(spark):
    import time

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(shared.CLEANUP, "false")
    df = shared.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "some")
    assert df.count() == 7 and spark.conf.get(shared.CLEANUP, "false") == setting
    # the count above has a shuffle of its own, the write had one with as many rows as tasks and keys; files go a moment later
    for _ in range(50):
        if len({f.split("_")[1] for f in files() - before}) <= 1:
            break
        time.sleep(0.2)
    assert len({f.split("_")[1] for f in files() - before}) <= 1


def test_rounds_of_components_are_removed(spark):
    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    shared.release(spark)
    found = connected_components(chain)
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 41
    folder = shared.shared_dir(spark).removeprefix("file://")
    assert len(shared._written) == 1 and len([x for x in os.listdir(folder) if x.startswith("sessionloom-links")]) == 1


def test_components_end_without_a_round_that_confirms_them(spark, monkeypatch):
    from sessionloom.operators import graph

    rounds = []
    monkeypatch.setattr(graph, "_large_star", lambda edges, f=graph._large_star: rounds.append(1) or f(edges))
    ends = lambda rows: {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert ends([(1, 2), (3, 1), (5, 9), (2, 1)]) == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)} and rounds == []
    assert ends([(5, 1), (5, 9), (5, 7)]) == {(x, 1) for x in (1, 5, 7, 9)} and len(rounds) == 1


def test_blocks_are_multiplied_some_rows_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from sessionloom.operators import vectors as V

    random = np.random.default_rng(2)
    x, y = random.normal(size=(2048, 16)), random.normal(size=(2048, 16))

    class Met:
        def mapInArrow(self, function, schema):
            self.function = function
            return self

        withColumn = where = lambda self, *a: self

    def block(v):
        return pa.array([[{"i": k, "v": row.tolist()} for k, row in enumerate(v)]], pa.list_(pa.struct([("i", pa.int64()), ("v", pa.list_(pa.float64()))])))

    met, batch = Met(), pa.RecordBatch.from_arrays([block(x), block(y)], names=["q", "m"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(V, "block_pairs", lambda *a: met)
        frame = type("D", (), {"select": lambda self, *a: self})()
        patch.setattr(V, "F", type("F", (), {n: staticmethod(lambda *a: type("C", (), {"alias": lambda s, *a: s, "__le__": lambda s, o: s, "over": lambda s, *a: s})()) for n in ("lit", "col", "desc", "round", "row_number")}))
        patch.setattr(V, "Window", type("W", (), {"partitionBy": staticmethod(lambda *a: type("O", (), {"orderBy": lambda s, *a: s})())}))
        V.nearest(frame, frame, 5)
    tracemalloc.start()
    found = list(met.function(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    ids = np.concatenate([b.column("id").to_numpy() for b in found]).reshape(2048, 5)
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y)]
    assert (ids == np.argsort(-(unit[0] @ unit[1].T), axis=1)[:, :5]).all()
    # the product of two whole blocks alone has 34 MB
    assert most < 25
