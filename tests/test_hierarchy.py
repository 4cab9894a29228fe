"""The density hierarchy against a brute-force version on all pairs."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sessionloom.operators import hierarchy as H


def tree_of(w):
    """Edges of a minimum spanning tree of all pairs: the nearest vector outside joins, one at a time."""
    inside, outside, edges = [0], set(range(1, len(w))), []
    while outside:
        rest = sorted(outside)
        near = w[np.ix_(inside, rest)]
        a, b = np.unravel_index(near.argmin(), near.shape)
        edges.append((inside[a], rest[b]))
        outside.remove(rest[b])
        inside.append(rest[b])
    return edges


def parts_of(nodes, edges):
    near = {k: [] for k in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    left, found = set(nodes), []
    while left:
        part, todo = [], [left.pop()]
        while todo:
            part.append(todo.pop())
            todo += [b for b in near[part[-1]] if b in left]
            left.difference_update(near[part[-1]])
        found.append(sorted(part))
    return found


def brute(x, m, samples, epsilon, method):
    """(cluster, probability, outlier score) of each row, by taking whole components apart again and again."""
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * unit @ unit.T)), H.DIGITS)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min(samples, n - 1) - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    clusters, fell = {0: dict(nodes=range(n), birth=0.0, parent=None, rows=[])}, {}

    def leave(k, nodes, level):
        for p in nodes:
            fell[p] = (k, level)
            clusters[k]["rows"].append((level, 1))

    todo = [(0, list(range(n)), tree_of(w))]
    while todo:
        k, nodes, edges = todo.pop()
        joins = max(w[e] for e in edges)
        level = math.inf if joins == 0 else 1 / joins
        edges = [e for e in edges if w[e] < joins]
        parts = parts_of(nodes, edges)
        big = [p for p in parts if len(p) >= m]
        for p in parts:
            own = [e for e in edges if e[0] in set(p)] if len(p) >= m else []
            if len(p) < m:
                leave(k, p, level)
            elif len(big) == 1:
                todo.append((k, p, own))
            else:
                new = len(clusters)
                clusters[new] = dict(nodes=p, birth=level, parent=k, rows=[])
                clusters[k]["rows"].append((level, len(p)))
                todo.append((new, p, own))
    below = {k: [c for c in clusters if clusters[c]["parent"] == k] for k in clusters}
    worth, flag, last, own = {}, {}, {}, {}
    for k in sorted(clusters, reverse=True):
        c = clusters[k]
        worth[k] = sum((v - c["birth"]) * s for v, s in c["rows"])
        own[k] = max(v for v, _ in c["rows"])
        last[k] = max([own[k], *(last[b] for b in below[k])])
        under = sum(worth[b] for b in below[k])
        flag[k] = k != 0 and (not below[k] or worth[k] >= under)
        worth[k] = worth[k] if flag[k] or not below[k] else under
    chosen = {k for k in clusters if k and (not below[k] if method == "leaf" else flag[k])}
    moved = set()
    for k in chosen:
        if epsilon > 0 and clusters[k]["birth"] * epsilon > 1:
            while clusters[k]["birth"] * epsilon >= 1 and clusters[k]["parent"] != 0:
                k = clusters[k]["parent"]
        moved.add(k)
    out = []
    for p in range(n):
        k, level = fell[p]
        line = [k]
        while clusters[line[-1]]["parent"] is not None:
            line.append(clusters[line[-1]]["parent"])
        top = next((a for a in reversed(line) if a in moved), None)
        probability = 0.0 if top is None else 1.0 if own[top] == 0 or level == math.inf else min(level, own[top]) / own[top]
        score = 0.0 if last[k] == 0 or level == math.inf else 1.0 if last[k] == math.inf else (last[k] - level) / last[k]
        out.append((-1 if top is None else min(clusters[top]["nodes"]), round(probability, 6), round(score, 6)))
    return out


def blobs(seed, n, spread):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, 5))
    x = centres[random.integers(0, 6, n)] + random.normal(size=(n, 5)) * random.choice(spread, n)[:, None]
    x[-6:] = x[:3].repeat(2, axis=0)  # copies
    return x


@pytest.mark.parametrize(("seed", "n", "m", "samples", "epsilon", "method", "most"), [(1, 120, 5, 3, 0.0, "eom", 10**6), (2, 120, 3, 2, 0.0, "leaf", 40), (3, 100, 4, 1, 0.15, "leaf", 10**6), (4, 90, 3, 2, 0.3, "eom", 25)])
def test_hierarchy_against_brute_force(spark, seed, n, m, samples, epsilon, method, most):
    # small trees in one task, large ones by rounds and cuts
    x = blobs(seed, n, [0.05, 0.2, 0.6])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = H.hierarchical_clusters(df, m, samples, epsilon, method, most=most, tile=64).orderBy("id").collect()
    want = brute(x, m, samples, epsilon, method)
    assert [(r["cluster"], round(r["probability"], 6), round(r["outlier_score"], 6)) for r in got] == want
    assert len({c for c, _, _ in want}) > 2


def test_500_vectors_a_grid_and_groups(spark):
    x = blobs(7, 500, [0.05, 0.15, 0.4])
    df = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "id long, v array<double>, t int").repartition(4)
    grid = [(5, 3, 0.0), (10, 3, 0.0), (5, 1, 0.2)]
    got = H.grid_clusters(df, grid, by="t").collect()
    assert len(got) == 1500
    for run, (m, samples, epsilon) in enumerate(grid):
        mine = {r["id"]: r for r in got if r["run"] == run}
        for t in (0, 1):
            ids = range(t, 500, 2)
            for i, (cluster, probability, score) in zip(ids, brute(x[t::2], m, samples, epsilon, "eom"), strict=True):
                assert mine[i]["cluster"] == (-1 if cluster == -1 else ids[cluster]), (run, i)
                assert (mine[i]["probability"], mine[i]["outlier_score"]) == pytest.approx((probability, score), abs=2e-6)


def test_many_equal_vectors_part_at_once(spark):
    x = np.vstack([np.tile([1.0, 0, 0], (40, 1)), np.tile([0, 1.0, 0], (30, 1)), [[0, 0, 1.0]]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: (r["cluster"], r["probability"]) for r in H.hierarchical_clusters(df, 5, 2, most=8).collect()}
    assert got == {k: (0, 1.0) if k < 40 else (40, 1.0) if k < 70 else (-1, 0.0) for k in range(71)}


def test_alone_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0])], "id long, v array<double>")
    assert [tuple(r) for r in H.hierarchical_clusters(df).collect()] == [(5, -1, None, 0.0, 0.0)]
    assert H.hierarchical_clusters(df.limit(0)).count() == 0


def test_spanning_tree_by_rounds_is_that_of_one_task(spark):
    random = np.random.default_rng(0)
    edges = [(k % 3, int(a), int(b), float(random.integers(0, 20))) for k in range(900) if (a := random.integers(0, 60)) != (b := random.integers(0, 60))]
    df = spark.createDataFrame([(t, min(a, b), max(a, b), w) for t, a, b, w in edges], "tree long, u long, v long, w double").repartition(3)
    small, rounds = (sorted(map(tuple, H.spanning_tree(df, most).distinct().collect())) for most in (10**6, 20))
    assert small == rounds and len(small) == 3 * 59


def vectors_of(sf):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), [int(r["label"]) for r in rows]


def named(ids, found):
    return {i: -1 if c == -1 else ids[c] for i, (c, _, _) in zip(ids, found, strict=True)}


def test_clustering_queries_against_brute_force(spark, sf):
    from sessionloom.plans import queries

    ids, x, labels = vectors_of(sf)
    found = brute(x, 5, 3, 0.08, "eom")
    got = {r["id"]: r for r in queries()["C1_density_clusters"](spark, sf).collect()}
    assert {i: r["cluster"] for i, r in got.items()} == named(ids, found)
    for i, (_, probability, score) in zip(ids, found, strict=True):
        assert (got[i]["probability"], got[i]["outlier_score"]) == pytest.approx((probability, score), abs=1e-4)
    sizes = {r["cluster"]: r["size"] for r in queries()["C5_generic_clusters"](spark, sf).collect()}
    own = list(named(ids, brute(x, 3, 2, 0.0, "eom")).values())
    assert sizes == {c: own.count(c) for c in set(own)}
    parts = {r["id"]: r["part"] for r in queries()["C8_sub_clusters"](spark, sf).collect()}
    refined = {r["label"]: (r["n_parts"], r["n_outliers"]) for r in queries()["C4_refined_groups"](spark, sf).collect()}
    for t in set(labels):
        at = [k for k, y in enumerate(labels) if y == t]
        members = [ids[k] for k in at]
        if len(at) < 10:
            assert all(parts[i] == str(t) for i in members) and t not in refined
            continue
        sub = named(members, brute(x[at], 3, 2, 0.0, "eom"))
        assert {i: parts[i] for i in members} == {i: f"{t}_mixed" if c == -1 else f"{t}_sub_{c}" for i, c in sub.items()}
        own = [c for c, _, _ in brute(x[at], 5, 3, 0.0, "eom")]
        assert refined[t] == (len(set(own) - {-1}), own.count(-1))


def test_clustering_search_against_brute_force(spark, sf):
    from sessionloom.plans import queries

    ids, x, _ = vectors_of(sf)
    rows = queries()["ML12_clustering_search"](spark, sf).collect()
    assert len({(r["min_cluster_size"], r["min_samples"], r["epsilon"]) for r in rows}) == len(rows) == 80
    for r in rows:
        if r["epsilon"] not in (0.0, 0.1):
            continue
        own = np.array([c for c, _, _ in brute(x, r["min_cluster_size"], r["min_samples"], r["epsilon"], "eom")])
        kinds = sorted(set(own.tolist()) - {-1})
        assert (r["n_clusters"], r["n_outliers"]) == (len(kinds), int((own == -1).sum()))
        if len(kinds) > 1 and r["min_samples"] == 2:
            inside = x[own != -1]
            means = np.array([((inside[:, None, :] - x[own == c][None]) ** 2).sum(axis=2).mean(axis=1) for c in kinds]).T
            place = np.array([kinds.index(c) for c in own[own != -1]])
            n = np.array([(own == c).sum() for c in kinds])[place]
            a = means[np.arange(len(place)), place] * n / (n - 1)
            means[np.arange(len(place)), place] = np.inf
            b = means.min(axis=1)
            assert r["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=2e-4)


@pytest.mark.parametrize(("method", "epsilon"), [("eom", 0.0), ("leaf", 0.0), ("leaf", 0.3), ("eom", 0.25)])
def test_selection_in_one_task_equals_rounds_and_needs_none(spark, monkeypatch, method, epsilon):
    # each cluster but the last parts into a leaf and the next one, so there are as many rounds as clusters below each other
    chain = [(0, 9, 0, -1.0, None, None, None)]
    points = []
    for k in range(1, 6):
        up = (chain[0][2], chain[0][3]) if k == 1 else (k - 1, float(k - 1))
        chain += [(0, 9, k, float(k), *up, 20), (0, 9, 100 + k, float(k), *up, 5)]
        points += [(0, 1000 + k, k + 1.5, 100 + k, float(k)), (0, 2000 + k, k + 0.5, k, float(k))]
    clusters = spark.createDataFrame(chain, "run long, origin long, ck long, cb double, pk long, pb double, size long")
    fallen = spark.createDataFrame(points, "run long, node long, level double, ck long, cb double")
    settings = spark.createDataFrame([(0, method, epsilon)], "run long, method string, epsilon double")
    names, saved = [], H.saved
    monkeypatch.setattr(H, "saved", lambda df, name: (names.append(name), saved(df, name))[1])
    one = sorted(map(tuple, H.selected(clusters, fallen, settings).collect()))
    assert len(names) <= 3
    assert one == sorted(map(tuple, H.selected(clusters, fallen, settings, most=1).collect()))


def weights(edges):
    """The sorted lengths of a minimum spanning forest of edges (u, v, w)."""
    up, out = {}, []

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        if top(u) != top(v):
            up[top(u)] = top(v)
            out.append(round(w, 6))
    return out


def test_a_line_holds_the_longest_edges_of_a_forest():
    random = np.random.default_rng(2)
    # two trees of 30 nodes
    edges = [(k, k + 1 + int(random.integers(0, 30 - k % 31)), float(random.integers(1, 9))) for t in (0, 31) for k in range(t, t + 30)]
    line = H._line(pd.DataFrame(edges, columns=["u", "v", "w"]).assign(tree=5))
    place, gap = {i: p for i, p in zip(line["i"], line["pos"], strict=True)}, line["gap"].to_numpy()
    for a in range(62):
        far, todo = {a: 0.0}, [a]
        while todo:
            x = todo.pop()
            for u, v, w in edges:
                for p, q in ((u, v), (v, u)):
                    if p == x and q not in far:
                        far[q] = max(far[x], w)
                        todo.append(q)
        for b in range(62):
            if b != a:
                low, high = sorted((place[a], place[b]))
                assert gap[low + 1 : high + 1].max() == far.get(b, np.inf)


@pytest.mark.parametrize(("near", "sub"), [(3, 16), (1, 16), (3, 7)])
def test_pairs_closer_than_the_first_tree_hold_the_spanning_tree(monkeypatch, near, sub):
    # with one neighbour each the first tree is in many parts
    monkeypatch.setattr(H, "SUB", sub)
    x = blobs(4, 120, [0.05, 0.2, 0.6])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * unit @ unit.T)), H.DIGITS)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    rows = pd.DataFrame([(0, min(a, b), max(a, b), w[a, b], min(a, b), max(a, b)) for a in range(120) for b in map(int, np.argsort(d[a], kind="stable")[:near])], columns=["tree", "u", "v", "w", "cu", "cv"])
    first = H._kruskal(rows)
    line = H._line(first).set_index("i")
    tile = lambda k: [{"i": i, "v": [*x[i], core[i], float(r.pos), r.gap]} for i, r in line[line["pos"] // 40 == k].iterrows()]
    kind = pa.list_(pa.struct([("i", pa.int64()), ("v", pa.list_(pa.float64()))]))
    middle = max(r["v"][-1] for r in tile(1))
    pairs = [(k, m, middle if (k, m) == (0, 2) else 0.0) for k in range(3) for m in range(k, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 6), pa.array([tile(k) for k, _, _ in pairs], kind), pa.array([tile(m) for _, m, _ in pairs], kind), pa.array([k == m for k, m, _ in pairs]), pa.array([b for _, _, b in pairs])], names=["g", "q", "m", "same", "between"])
    found = [tuple(e.values())[1:] for part in H._closer(iter([batch])) for e in part.to_pylist()]
    assert all(w[u, v] == e for u, v, e in found)
    both = [*found, *first[["u", "v", "w"]].itertuples(index=False, name=None)]
    assert weights(both) == weights([(a, b, w[a, b]) for a in range(120) for b in range(a)])


def test_edges_that_cannot_better_the_first_tree_do_not_move(spark):
    x = np.random.default_rng(8).normal(size=(600, 6))
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "g long, id long, v array<double>").repartition(3)
    near = H.neighbours(df, H.NEIGHBOURS, tile=64).cache()
    cores = H.core_distances(df, near, [3]).drop("samples").cache()
    edges = H.tree_edges(df, cores, near, tile=64).select("u", "v", "w").collect()
    every = H.reachability_edges(df, cores, tile=64).select("u", "v", "w").collect()
    assert weights(map(tuple, edges)) == weights(map(tuple, every))
    assert len(edges) < 3 * 600 < len(every)
    # a group that no task can hold has no first tree
    assert weights(map(tuple, H.tree_edges(df, cores, near, tile=64, most=599).select("u", "v", "w").collect())) == weights(map(tuple, every))
