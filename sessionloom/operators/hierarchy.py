"""The density hierarchy of vectors: minimum spanning tree, condensed tree, selection, outlier scores.

Two vectors reach each other at the largest of their distance and their core
distances (that of the ``min_samples``-th neighbour). The minimum spanning tree
of these distances holds the whole hierarchy. It is found without all pairs in
one place: a first tree joins each vector to its nearest ones, all tiles of
vectors meet, and of a pair of tiles only those pairs go on that are closer than
the longest edge between them on the first tree, as no other can be in a minimum
spanning tree. Where that tree is too large for a task, or leaves parts
unconnected, tiles give the spanning tree of their own pairs, and Borůvka
rounds, in which each component takes its least outgoing edge, join what is left
until a task can hold it. The tree is condensed from
its longest edges down: a tree that no task can hold is cut at a distance, what
lies above is condensed with the parts below as weighted points, and the parts
follow as trees of their own. Equal distances count as one step, so the result
doesn't depend on the order of rows.

A ``run`` is one setting of the parameters. All runs of a grid go through the
same jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.graph import connected_components
from sessionloom.operators.vectors import DECIMALS, FEWEST_BLOCKS, _matrix, _unit, nearest, nearest_of
from sessionloom.sources.shared import saved

__all__ = ["condensed", "grid_clusters", "hierarchical_clusters", "selected", "spanning_tree"]

#: Most edges of a tree that one task holds, and most vectors of a tile.
MOST_EDGES, TILE, SUB = 1_000_000, 8192, 2048
#: Distances count to so many decimals.
DIGITS = 6
#: Fewest neighbours of each vector that the first tree is made of; more make it better, and change no result.
NEIGHBOURS = 8

Rows = Iterator[pa.RecordBatch]


# -- the minimum spanning tree ------------------------------------------------------


def _prim(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a minimum spanning tree of all pairs, given their distances."""
    n = len(w)
    best, come, left = w[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    best[0], left[0] = np.inf, False
    order = np.empty(max(0, n - 1), np.int64)
    for k in range(n - 1):
        at = int(best.argmin())
        order[k], best[at], left[at] = at, np.inf, False
        nearer = (w[at] < best) & left
        best[nearer], come[nearer] = w[at][nearer], at
    return come[order], order


def _prim_across(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_prim``, of pairs of a row and a column; columns are numbered after the rows."""
    rows, columns = w.shape
    n, across = rows + columns, np.ascontiguousarray(w.T)
    best, come, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    best[rows:], left[0] = w[0], False
    order = np.empty(n - 1, np.int64)
    for k in range(n - 1):
        at = int(best.argmin())
        order[k], best[at], left[at] = at, np.inf, False
        span, reach = (slice(rows, n), w[at]) if at < rows else (slice(0, rows), across[at - rows])
        nearer = (reach < best[span]) & left[span]
        best[span][nearer], come[span][nearer] = reach[nearer], at
    return come[order], order


def _far(av: np.ndarray, ac: np.ndarray, bv: np.ndarray, bc: np.ndarray) -> np.ndarray:
    """The distances at which vectors with cores reach each other."""
    return _reach(_unit(av) @ _unit(bv).T, ac[:, None], bc[None, :])


def _reach(cosine: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.round(np.maximum(np.sqrt(np.maximum(0.0, 2 - 2 * cosine)), np.maximum(one, other)), DIGITS)


def _inner(ids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, other = _prim(far)
    return ids[one], ids[other], far[one, other]


def _across(ids: np.ndarray, others: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, other = _prim_across(far)
    low, high = np.minimum(one, other), np.maximum(one, other) - len(ids)
    return ids[low], others[high], far[low, high]


def _edges(tree: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, w = (np.concatenate(z) for z in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(z) for z in (np.full(len(u), tree), np.minimum(u, v).astype(np.int64), np.maximum(u, v).astype(np.int64), w)], names=["tree", "u", "v", "w"])


def _tile_trees(batches: Rows) -> Rows:
    """Edges (tree, u, v, w) of the spanning trees of two tiles' pairs; a vector's last position is its core distance."""
    for batch in batches:
        for row in range(batch.num_rows):
            (ai, av), (bi, bv) = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
            same = batch.column("same")[row].as_py()
            found = []
            for x in range(0, len(ai), SUB):
                for y in range(x if same else 0, len(bi), SUB):
                    a, b = slice(x, x + SUB), slice(y, y + SUB)
                    far = _far(av[a, :-1], av[a, -1], bv[b, :-1], bv[b, -1])
                    found.append(_inner(ai[a], far) if same and x == y else _across(ai[a], bi[b], far))
            yield _edges(batch.column("g")[row].as_py(), found)


def _line(rows: pd.DataFrame) -> pd.DataFrame:
    """(tree, i, pos, gap): all ends of a forest (tree, u, v, w) in a line, with the ``gap`` before each.

    The longest edge between two of them on the forest is the largest gap
    between their places; what the forest doesn't connect is infinitely apart.
    """
    rows = rows.sort_values("w")
    names, ends = np.unique(np.concatenate([rows["u"], rows["v"]]), return_inverse=True)
    n, half = len(names), len(rows)
    above, last, after, gap = list(range(n)), list(range(n)), [-1] * n, [np.inf] * n
    # a component's top is its first, and a joined one is lined up behind the other
    for a, b, w in zip(ends[:half].tolist(), ends[half:].tolist(), rows["w"].tolist(), strict=True):
        while above[a] != a:
            above[a] = a = above[above[a]]
        while above[b] != b:
            above[b] = b = above[above[b]]
        above[b], after[last[a]], gap[b], last[a] = a, b, w, last[b]
    line = []
    for at in range(n):
        if above[at] == at:
            while at >= 0:
                line.append(at)
                at = after[at]
    return pd.DataFrame({"tree": rows["tree"].iloc[0], "i": names[line], "pos": np.arange(n), "gap": np.array(gap)[line]})


def _after(gap: np.ndarray) -> np.ndarray:
    """The largest gap behind each place of a part of the line, up to its end."""
    return np.append(np.maximum.accumulate(gap[:0:-1])[::-1], 0.0)


def _closer(batches: Rows) -> Rows:
    """Edges (tree, u, v, w) of two tiles' pairs that are closer than the longest edge between them on the first tree, or as many as hold a spanning tree of these.

    A vector's last three positions are its core distance, its place in the
    line of the first tree, and the gap before it. ``between`` is the largest
    gap of the tiles that lie between the two.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            same, between = (batch.column(c)[row].as_py() for c in ("same", "between"))
            (ai, av), (bi, bv) = ((i[o], v[o]) for i, v in (_matrix(batch.column(c)[row]) for c in ("q", "m")) for o in [np.argsort(v[:, -2])])
            au, bu = _unit(av[:, :-3]), _unit(bv[:, :-3])
            (ac, ag), (bc, bg) = ((v[:, -3], v[:, -1]) for v in (av, bv))
            found = []
            for x in range(0, len(ai), SUB):
                a = slice(x, x + SUB)
                for y in range(x if same else 0, len(bi), SUB):
                    b = slice(y, y + SUB)
                    if same and x == y:
                        found.append(_inner(ai[a], _far(au[a], ac[a], bu[b], bc[b])))
                        continue
                    rest = ag[x + SUB : y] if same else np.concatenate([ag[x + SUB :], [between], bg[:y]])
                    one, other = np.maximum(_after(ag[a]), rest.max(initial=0.0)), np.maximum.accumulate(bg[b])
                    cosine = au[a] @ bu[b].T
                    with np.errstate(over="ignore"):
                        least = (1 - z**2 / 2 - 1e-9 for z in (one, other))  # a little less than needed, as the exact test follows
                        k, m = np.nonzero(cosine >= np.minimum(next(least)[:, None], next(least)[None, :]))
                    # a spanning tree of all these pairs has fewer edges than there are vectors
                    if len(k) <= max(cosine.size // 16, sum(cosine.shape)):
                        w = _reach(cosine[k, m], ac[a][k], bc[b][m])
                        near = w < np.maximum(one[k], other[m])
                        k, m, w = k[near], m[near], w[near]
                    some = len(k) < sum(cosine.shape)
                    found.append((ai[a][k], bi[b][m], w) if some else _across(ai[a], bi[b], _reach(cosine, ac[a][:, None], bc[b][None, :])))
            yield _edges(batch.column("g")[row].as_py(), found)


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """(g, q, m, same): each two tiles of a group of rows (g, i, v) once, and each tile with itself.

    A tile is sent to as many places as its group has tiles.
    """
    sizes = _tile_counts(rows, tile).select("g", "n")
    dealt = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("i"), F.col("n")).cast("long"))
    return _met(dealt.groupBy("g", "b", "n").agg(F.collect_list(F.struct("i", "v")).alias("q"))).select("g", "q", "m", "same")


def _tile_counts(rows: DataFrame, tile: int) -> DataFrame:
    n = F.count("*")
    return rows.groupBy("g").agg(F.greatest(F.least(F.lit(FEWEST_BLOCKS), F.ceil(n / 64)), F.ceil(n / tile)).cast("long").alias("n"), n.alias("size"))


def _met(packed: DataFrame) -> DataFrame:
    """Both tiles are sent, as pairs dealt by the one of them alone would be few and uneven."""
    one = packed.select("g", F.col("b").alias("a"), "q", F.explode(F.sequence(F.col("b"), F.col("n") - 1)).alias("b"))
    other = packed.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("a"), "b", F.col("q").alias("m"))
    return one.join(other, ["g", "a", "b"]).withColumn("same", F.col("a") == F.col("b"))


def _line_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """As ``_tiles`` of rows (g, i, v, pos, gap), with ``between``; a tile is a part of the line, and an earlier one is ``q``."""
    dealt = rows.join(_tile_counts(rows, tile), "g").withColumn("b", F.floor(F.col("pos") * F.col("n") / F.col("size")).cast("long"))
    gaps = dealt.groupBy("g", "b").agg(F.max("gap").alias("gap")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("b", "gap"))).alias("gaps")).select("g", F.col("gaps.gap").alias("gaps"))
    packed = dealt.groupBy("g", "b", "n").agg(F.collect_list(F.struct("i", F.concat("v", F.array(F.col("pos").cast("double"), "gap")).alias("v"))).alias("q"))
    inner = F.array_max(F.slice("gaps", (F.col("a") + 2).cast("int"), F.greatest(F.lit(0), F.col("b") - F.col("a") - 1).cast("int")))
    # the largest gap of each tile: a short list for each group
    return _met(packed).join(gaps, "g").select("g", "q", "m", "same", F.coalesce(inner, F.lit(0.0)).alias("between"))


def _kruskal(rows: pd.DataFrame) -> pd.DataFrame:
    """The edges (tree, u, v, w) of rows (tree, u, v, w, cu, cv) that join different components cu and cv, shortest first."""
    rows = rows.sort_values(["w", "u", "v"])
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    keep = []
    for k, (a, b) in enumerate(zip(rows["cu"].tolist(), rows["cv"].tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            above[b] = a
            keep.append(k)
    return rows.iloc[keep][["tree", "u", "v", "w"]]


def spanning_tree(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """The edges (tree, u, v, w) of each tree's minimum spanning forest; of equally long ones those with the least ends.

    Trees of up to ``most`` edges are done in one task each. In larger ones each
    component takes its least outgoing edge, round by round, until so few edges
    join different components.
    """
    now = edges.select("tree", "u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv"))
    taken: list[DataFrame] = []
    while True:
        sizes = saved(now.groupBy("tree").agg(F.count("*").alias("n")), "tree-sizes")
        large = sizes.where(F.col("n") > most).select("tree")
        small = now.join(large, "tree", "left_anti").groupBy("tree").applyInPandas(_kruskal, "tree long, u long, v long, w double")
        taken.append(saved(small, "small-trees"))
        if large.isEmpty():
            break
        wide = now.join(large, "tree", "left_semi")
        edge = F.struct("w", "u", "v", "cu", "cv")
        ends = wide.select("tree", F.explode(F.array("cu", "cv")).alias("c"), edge.alias("e"))
        least = saved(ends.groupBy("tree", "c").agg(F.min("e").alias("e")).select("tree", "e.*").distinct(), "least-edges")
        taken.append(least.select("tree", "u", "v", "w"))
        joined = connected_components(least.select(F.struct("tree", "cu").alias("u"), F.struct("tree", F.col("cv").alias("cu")).alias("v")))
        name = joined.select(F.col("node.tree").alias("tree"), F.col("node.cu").alias("c"), F.col("component.cu").alias("to"))
        moved = wide.join(name.select("tree", F.col("c").alias("cu"), F.col("to").alias("tu")), ["tree", "cu"]).join(name.select("tree", F.col("c").alias("cv"), F.col("to").alias("tv")), ["tree", "cv"])
        open_edges = moved.where("tu <> tv").groupBy("tree", F.least("tu", "tv").alias("cu"), F.greatest("tu", "tv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        now = saved(open_edges.select("tree", "e.u", "e.v", "e.w", "cu", "cv"), "open-edges")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionAll(more)
    return out


def reachability_edges(vectors: DataFrame, cores: DataFrame, tile: int = TILE, within: DataFrame | None = None) -> DataFrame:
    """Edges (tree, u, v, w) that hold a minimum spanning tree of the mutual reachability of rows (g, id, v) with cores (g, id, core).

    ``within`` (id, _bucket) restricts pairs to those that share a bucket.
    """
    rows = vectors.join(cores, ["g", "id"]).select("g", F.col("id").alias("i"), F.concat("v", F.array("core")).alias("v"))
    if within is None:
        return _tiles(rows, tile).mapInArrow(_tile_trees, "tree long, u long, v long, w double")
    met = rows.join(within.withColumnRenamed("id", "i"), "i").select(F.struct("g", "_bucket").alias("gb"), "i", "v")
    named = met.select(F.xxhash64("gb").alias("g"), F.col("gb.g").alias("tree"), "i", "v")
    found = _tiles(named.select("g", "i", "v"), tile).mapInArrow(_tile_trees, "tree long, u long, v long, w double")
    of = rows.select(F.col("g").alias("tree"), F.col("i").alias("u"))
    # the tree is the group's, whatever bucket a pair was met in; a pair may be met in several
    return found.drop("tree").join(of, "u").select("tree", "u", "v", "w").distinct()


def tree_edges(vectors: DataFrame, cores: DataFrame, near: DataFrame, tile: int = TILE, most: int = MOST_EDGES) -> DataFrame:
    """As ``reachability_edges``, from neighbours (i, id, d): the first tree, and all edges that may better it.

    Groups of more than ``most`` vectors have no first tree.
    """
    small = saved(vectors.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("g"), "small-groups")
    of = cores.join(small, "g", "left_semi")
    side = lambda i, c: of.select(F.col("g").alias("tree"), F.col("id").alias(i), F.col("core").alias(c))
    met = near.groupBy(F.least("i", "id").alias("u"), F.greatest("i", "id").alias("v")).agg(F.min("d").alias("d"))
    met = met.join(side("u", "cu"), "u").join(side("v", "cv").drop("tree"), "v").select("tree", "u", "v", F.greatest("d", "cu", "cv").alias("w"))
    first = saved(spanning_tree(saved(met, "near-edges"), most), "first-tree")
    line = saved(first.groupBy("tree").applyInPandas(_line, "tree long, i long, pos long, gap double"), "line")
    rows = vectors.join(of, ["g", "id"]).select("g", F.col("id").alias("i"), F.concat("v", F.array("core")).alias("v")).join(line.withColumnRenamed("tree", "g"), ["g", "i"])
    found = first.unionAll(_line_tiles(rows, tile).mapInArrow(_closer, "tree long, u long, v long, w double"))
    large = vectors.join(small, "g", "left_anti")
    return found if large.isEmpty() else found.unionAll(reachability_edges(large, cores, tile))


# -- the condensed tree -------------------------------------------------------------

#: What condensing gives: clusters with their parents, and points (or parts) that fall out of a cluster or stay in it.
CONDENSED = "run long, origin long, tree long, kind string, node long, level double, ck long, cb double, pk long, pb double, size long"


def _merges(rows: pd.DataFrame) -> tuple[list[int], list[int], list[list[int]], list[float], list[int], list[int]]:
    """Points' names and sizes; for each node of the hierarchy its children, height, size and least name. Equal heights are one node."""
    names = pd.unique(pd.concat([rows["u"], rows["v"]])).tolist()
    at = {x: k for k, x in enumerate(names)}
    sizes = [0] * len(names)
    for end, size in (("u", "su"), ("v", "sv")):
        for x, s in zip(rows[end].tolist(), rows[size].tolist(), strict=True):
            sizes[at[x]] = s
    children: list[list[int]] = [[] for _ in names]
    height, size, least = [-1.0] * len(names), list(sizes), list(names)
    above = list(range(len(names)))
    node = list(range(len(names)))
    for u, v, w in rows.sort_values("w")[["u", "v", "w"]].itertuples(index=False, name=None):
        a, b = at[u], at[v]
        while above[a] != a:
            above[a] = a = above[above[a]]
        while above[b] != b:
            above[b] = b = above[above[b]]
        x, y = node[a], node[b]
        if height[y] == w and (height[x] != w or len(children[y]) > len(children[x])):
            x, y = y, x
        if height[x] == w:
            into = x
            children[x] += children[y] if height[y] == w else [y]
            size[x], least[x] = size[x] + size[y], min(least[x], least[y])
        else:
            into = len(height)
            children.append([x, y])
            height.append(w)
            size.append(size[x] + size[y])
            least.append(min(least[x], least[y]))
        above[b] = a
        node[a] = into
    return names, sizes, children, height, size, least


def _level(distance: float) -> float:
    """The density at a distance; 0 where nothing joins."""
    return np.inf if distance == 0 else 0.0 if np.isinf(distance) else 1.0 / distance


def _condense(rows: pd.DataFrame) -> pd.DataFrame:
    """The condensed tree below the root cluster (rk, rb) of one tree (run, origin, tree, u, v, w, su, sv, rk, rb, least_size)."""
    run, origin, tree, rk, rb, m = (rows[c].iloc[0] for c in ("run", "origin", "tree", "rk", "rb", "least_size"))
    names, _, children, height, size, least = _merges(rows)
    out: list[tuple] = []
    todo = [(max(range(len(size)), key=lambda k: (size[k], k)), int(rk), float(rb))]
    while todo:
        at, ck, cb = todo.pop()
        if not children[at]:
            out.append(("stay", names[at], None, ck, cb, None, None, size[at]))
            continue
        level = _level(height[at])
        big = [c for c in children[at] if size[c] >= m]
        for c in big:
            key = (ck, cb)
            if len(big) > 1:
                key = (least[c], level)
                out.append(("cluster", None, None, *key, ck, cb, size[c]))
            todo.append((c, *key))
        falls = [c for c in children[at] if size[c] < m]
        while falls:
            c = falls.pop()
            if children[c]:
                falls += children[c]
            else:
                out.append(("out", names[c], level, ck, cb, None, None, size[c]))
    found = pd.DataFrame(out, columns=["kind", "node", "level", "ck", "cb", "pk", "pb", "size"])
    for c in ("node", "pk", "ck", "size"):
        found[c] = found[c].astype("Int64")
    found.insert(0, "tree", int(tree))
    found.insert(0, "origin", int(origin))
    found.insert(0, "run", int(run))
    return found


def condensed(edges: DataFrame, most: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters (run, origin, ck, cb, pk, pb, size) and points (run, node, level, ck, cb) of spanning trees (run, tree, u, v, w, least_size).

    ``origin`` is the spanning tree a cluster comes from, whatever parts it was condensed in.

    A cluster is named by its least member and the density (1 / distance) it
    begins at; a tree's root begins at -1. A point falls out of its last cluster
    at ``level``. Where a tree parts, parts of ``least_size`` points or more are
    clusters of their own if there are two or more of them; else what is left
    stays the same cluster.
    """
    one = F.lit(1).cast("long")
    root = Window.partitionBy("run", "tree")
    roots = edges.groupBy("run", "tree").agg(F.min(F.least("u", "v")).alias("rk"))
    now = edges.join(roots, ["run", "tree"]).select("run", F.col("tree").alias("origin"), "tree", "u", "v", "w", one.alias("su"), one.alias("sv"), "rk", F.lit(-1.0).alias("rb"), "least_size")
    clusters = [roots.select("run", F.col("tree").alias("origin"), F.col("rk").alias("ck"), F.lit(-1.0).alias("cb"), F.lit(None).cast("long").alias("pk"), F.lit(None).cast("double").alias("pb"), F.lit(None).cast("long").alias("size"))]
    points = []
    cluster = ["run", "origin", "ck", "cb", "pk", "pb", "size"]
    point = ["run", "node", "level", "ck", "cb"]
    while True:
        sizes = saved(now.groupBy("run", "tree").agg(F.count("*").alias("n")), "tree-sizes")
        large = sizes.where(F.col("n") > most)
        done = saved(now.join(large, ["run", "tree"], "left_anti").groupBy("run", "tree").applyInPandas(_condense, CONDENSED), "condensed")
        clusters.append(done.where("kind = 'cluster'").select(*cluster))
        points.append(done.where("kind = 'out'").select(*point))
        if large.isEmpty():
            break
        wide = now.join(large, ["run", "tree"])
        # about half of what a task can hold lies above the cut; where one distance has more edges than that, it is the top by itself
        share = F.greatest(F.lit(0.0), 1 - F.lit(most / 2) / F.max("n"))
        cuts = wide.groupBy("run", "tree").agg(F.percentile_approx("w", F.array(*(F.lit(k / 64) for k in range(65))), 10_000).alias("q"), share.alias("share"), F.max("w").alias("top"))
        cut = F.element_at("q", F.ceil(F.col("share") * 64).cast("int") + 1)
        cuts = saved(cuts.select("run", "tree", "top", cut.alias("cut")), "cuts")
        split = wide.join(cuts, ["run", "tree"])
        upper = split.where((F.col("w") > F.col("cut")) | (F.col("w") == F.col("top")))
        lower = saved(split.where((F.col("w") <= F.col("cut")) & (F.col("w") < F.col("top"))).drop("cut", "top", "n"), "lower-edges")
        at = lambda c: F.struct("run", "tree", F.col(c).alias("node"))
        parts = connected_components(lower.select(at("u").alias("u"), at("v").alias("v")))
        named = saved(parts.select("node.run", "node.tree", "node.node", F.col("component.node").alias("part")), "parts")
        ends = split.select("run", "tree", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("su").alias("s")), F.struct(F.col("v").alias("node"), F.col("sv").alias("s")))).alias("e")).select("run", "tree", "e.*").distinct()
        known = saved(ends.join(named, ["run", "tree", "node"], "left").withColumn("part", F.coalesce("part", "node")), "placed")
        weights = known.groupBy("run", "tree", "part").agg(F.sum("s").alias("weight"))
        heavy = saved(known.join(weights, ["run", "tree", "part"]).select("run", "tree", "node", "part", "weight"), "weighed")
        side = lambda e: heavy.select("run", "tree", F.col("node").alias(e), F.col("part").alias(f"p{e}"), F.col("weight").alias(f"w{e}"))
        tops = upper.join(side("u"), ["run", "tree", "u"]).join(side("v"), ["run", "tree", "v"])
        tops = tops.select("run", "origin", "tree", F.col("pu").alias("u"), F.col("pv").alias("v"), "w", F.col("wu").alias("su"), F.col("wv").alias("sv"), "rk", "rb", "least_size", "top", "cut")
        level_only = F.max("w").over(root) == F.min("w").over(root)
        tops = saved(tops.withColumn("level_only", level_only), "upper-edges")
        met = saved(tops.where("not level_only").drop("level_only", "top", "cut").groupBy("run", "tree").applyInPandas(_condense, CONDENSED).unionAll(_one_level(tops.where("level_only"))), "condensed")
        clusters.append(met.where("kind = 'cluster'").select(*cluster))
        falls = met.where("kind = 'out'").select("run", "tree", F.col("node").alias("part"), "level", "ck", "cb")
        points.append(known.join(falls, ["run", "tree", "part"]).select(*point))
        stays = met.where("kind = 'stay'").select("run", "tree", F.col("node").alias("part"), F.col("ck").alias("k"), F.col("cb").alias("b"))
        goes_on = lower.join(known.select("run", "tree", F.col("node").alias("u"), "part"), ["run", "tree", "u"]).join(stays, ["run", "tree", "part"])
        now = saved(goes_on.select("run", "origin", F.col("part").alias("tree"), "u", "v", "w", "su", "sv", F.col("k").alias("rk"), F.col("b").alias("rb"), "least_size"), "lower-trees")
    return saved(_union(clusters), "clusters"), saved(_union(points), "points")


def _one_level(edges: DataFrame) -> DataFrame:
    """As ``_condense``, where all edges have one length: any number of parts that part at once."""
    ends = edges.select("run", "origin", "tree", "w", "rk", "rb", "least_size", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("su").alias("size")), F.struct(F.col("v").alias("node"), F.col("sv").alias("size")))).alias("e"))
    parts = ends.select("run", "origin", "tree", "w", "rk", "rb", "least_size", "e.*").distinct()
    big = F.col("size") >= F.col("least_size")
    counts = parts.groupBy("run", "tree").agg(F.count_if(big).alias("big"))
    level = F.when(F.col("w") == 0, float("inf")).when(F.col("w") == float("inf"), 0.0).otherwise(1 / F.col("w"))
    known = parts.join(counts, ["run", "tree"]).withColumn("level", level)
    none = lambda kind: F.lit(None).cast(kind)
    falls = known.where(~big).select("run", "origin", "tree", F.lit("out").alias("kind"), "node", "level", F.col("rk").alias("ck"), F.col("rb").alias("cb"), none("long").alias("pk"), none("double").alias("pb"), "size")
    several = F.col("big") > 1
    key, birth = F.when(several, F.col("node")).otherwise(F.col("rk")).alias("ck"), F.when(several, F.col("level")).otherwise(F.col("rb")).alias("cb")
    stays = known.where(big).select("run", "origin", "tree", F.lit("stay").alias("kind"), "node", none("double").alias("level"), key, birth, none("long").alias("pk"), none("double").alias("pb"), "size")
    born = known.where(big & several).select("run", "origin", "tree", F.lit("cluster").alias("kind"), none("long").alias("node"), none("double").alias("level"), F.col("node").alias("ck"), F.col("level").alias("cb"), F.col("rk").alias("pk"), F.col("rb").alias("pb"), "size")
    return falls.unionAll(stays).unionAll(born)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


# -- selection ----------------------------------------------------------------------

KEY = ["run", "ck", "cb"]


def _worth(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """Clusters with their own ``worth``, ``own_last`` (the density at which all that leaves them is gone) and ``below`` (how many clusters they part into).

    A cluster is worth the sum, over what leaves it, of the density it leaves at
    less the one the cluster begins at.
    """
    born = F.greatest(F.col("cb"), F.lit(0.0))
    own = points.groupBy(*KEY).agg(F.sum(F.col("level") - born).alias("s"), F.max("level").alias("far"))
    below = clusters.where("pk is not null").select("run", F.col("pk").alias("ck"), F.col("pb").alias("cb"), F.col("cb").alias("birth"), "size")
    gone = below.groupBy(*KEY).agg(F.sum((F.col("birth") - born) * F.col("size")).alias("gone"), F.max("birth").alias("gone_far"), F.count("*").alias("below"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    every = clusters.join(own, KEY, "left").join(gone, KEY, "left")
    return every.select(*clusters.columns, (zero("s") + zero("gone")).alias("worth"), F.greatest(zero("far"), zero("gone_far")).alias("own_last"), F.coalesce("below", F.lit(0)).alias("below"))


#: What selection gives of each cluster: its topmost chosen ancestor (tk, tb), when all that leaves that one is gone, and when all below the cluster itself is.
MAPPED = "run long, ck long, cb double, tk long, tb double, most double, last double"


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """MAPPED of the clusters of one tree (run, ck, cb, pk, pb, worth, own_last, below, method, epsilon), as ``_chosen_by_rounds`` finds it."""
    rows = rows.sort_values(["cb", "ck"], ignore_index=True)  # what is above begins earlier
    ck, cb, worth, last = (rows[c].tolist() for c in ("ck", "cb", "worth", "own_last"))
    own_last, leaf, n = list(last), [b == 0 for b in rows["below"].tolist()], len(ck)
    place = {key: k for k, key in enumerate(zip(ck, cb, strict=True))}
    rooted = rows["pk"].isna().tolist()
    up = [-1 if r else place[(int(a), b)] for r, a, b in zip(rooted, rows["pk"].tolist(), rows["pb"].tolist(), strict=True)]
    sums, flag = [0.0] * n, [False] * n
    for k in range(n - 1, -1, -1):
        flag[k] = up[k] >= 0 and (leaf[k] or worth[k] >= sums[k])
        if not leaf[k] and not flag[k]:
            worth[k] = sums[k]
        if up[k] >= 0:
            sums[up[k]] += worth[k]
            last[up[k]] = max(last[up[k]], last[k])
    method, epsilon = rows["method"].iloc[0], float(rows["epsilon"].iloc[0])
    rest, climbed = [False] * n, [False] * n
    for k in range(n):
        if not (leaf[k] and up[k] >= 0 if method == "leaf" else flag[k]):
            continue
        if not (epsilon > 0 and cb[k] * epsilon > 1):
            rest[k] = True
            continue
        at = k
        while not climbed[at]:  # else it has been followed to its end
            if up[up[at]] < 0:
                rest[at] = True
                break
            climbed[at], at = True, up[at]
            if cb[at] * epsilon < 1:
                rest[at] = True
                break
    top = [-1] * n
    for k in range(n):
        top[k] = top[up[k]] if up[k] >= 0 and top[up[k]] >= 0 else k if rest[k] else -1
    some = np.array(top, np.int64)
    there, at = some >= 0, np.maximum(some, 0)
    pick = lambda of: pd.Series(np.array(of)[at]).where(there)
    return pd.DataFrame({"run": rows["run"], "ck": ck, "cb": cb, "tk": pd.Series(np.array(ck, np.int64)[at]).astype("Int64").where(there), "tb": pick(cb), "most": pick(own_last), "last": last})


def _valued(every: DataFrame) -> DataFrame:
    """Clusters of ``_worth`` with ``last`` (the density at which all below is gone), and ``flag``: worth more than its clusters below, from the leaves up.

    Rounds go by height, each over the clusters whose clusters below are done.
    """
    kept = [c for c in every.columns if c not in ("worth", "own_last", "below")]
    done = saved(every.where("below = 0").select(*kept, "worth", "own_last", F.col("own_last").alias("last"), F.col("pk").isNotNull().alias("flag"), F.lit(True).alias("leaf")), "valued")
    parts, waiting = [done], every.where("below > 0")
    sums = None
    while True:
        new = parts[-1].where("pk is not null").groupBy("run", F.col("pk").alias("ck"), F.col("pb").alias("cb")).agg(F.count("*").alias("seen"), F.sum("worth").alias("sum"), F.max("last").alias("deep"))
        sums = new if sums is None else sums.unionAll(new).groupBy(*KEY).agg(F.sum("seen").alias("seen"), F.sum("sum").alias("sum"), F.max("deep").alias("deep"))
        sums = saved(sums, "sums")
        ready = waiting.join(sums, KEY).where("below = seen")
        keeps = (F.col("worth") >= F.col("sum")) & F.col("pk").isNotNull()
        found = saved(ready.select(*kept, F.when(keeps, F.col("worth")).otherwise(F.col("sum")).alias("worth"), "own_last", F.greatest("own_last", "deep").alias("last"), keeps.alias("flag"), F.lit(False).alias("leaf")), "valued")
        if found.isEmpty():
            break
        parts.append(found)
        sums = sums.join(found.select(*KEY), KEY, "left_anti")
        # written, so that rounds don't pile up in the plan
        waiting = saved(waiting.join(found.select(*KEY), KEY, "left_anti"), "waiting")
    return saved(_union(parts), "valued")


def _chosen_by_rounds(every: DataFrame) -> DataFrame:
    """MAPPED of clusters of ``_worth`` with their method and epsilon, of trees that no task can hold."""
    valued = _valued(every)
    # chosen ones that begin too close climb
    chosen = valued.where(F.when(F.col("method") == "leaf", F.col("leaf") & F.col("pk").isNotNull()).otherwise(F.col("flag")))
    slim = saved(valued.select(*KEY, "pk", "pb", "epsilon", F.col("own_last").alias("own_last"), "last"), "slim")
    parent = slim.select("run", F.col("ck").alias("pk"), F.col("cb").alias("pb"), F.col("pk").alias("gk"), F.col("pb").alias("gb"))
    sits = chosen.where((F.col("epsilon") <= 0) | (F.col("cb") * F.col("epsilon") <= 1)).select(*KEY)
    climbs = saved(chosen.where((F.col("epsilon") > 0) & (F.col("cb") * F.col("epsilon") > 1)).select(*KEY, "pk", "pb", "epsilon"), "climbing")
    at_rest = [sits]
    while not climbs.isEmpty():
        up = climbs.join(parent, ["run", "pk", "pb"])
        at_rest.append(up.where("gk is null").select(*KEY))
        moved = up.where("gk is not null").select("run", F.col("pk").alias("ck"), F.col("pb").alias("cb"), F.col("gk").alias("pk"), F.col("gb").alias("pb"), "epsilon").distinct()
        at_rest.append(moved.where(F.col("cb") * F.col("epsilon") < 1).select(*KEY))
        climbs = saved(moved.where(F.col("cb") * F.col("epsilon") >= 1), "climbing")
    flags = saved(_union(at_rest).distinct().withColumn("flag", F.lit(True)), "flags")
    # every cluster's topmost chosen ancestor, by doubling
    state = slim.join(flags, KEY, "left").select(*KEY, F.col("pk").alias("ak"), F.col("pb").alias("ab"), F.when(F.col("flag"), F.col("ck")).alias("tk"), F.when(F.col("flag"), F.col("cb")).alias("tb"))
    state = saved(state, "ancestors")
    while not state.where("ak is not null").isEmpty():
        above = state.select("run", F.col("ck").alias("ak"), F.col("cb").alias("ab"), F.col("ak").alias("nk"), F.col("ab").alias("nb"), F.col("tk").alias("uk"), F.col("tb").alias("ub"))
        step = state.join(above, ["run", "ak", "ab"], "left")
        state = saved(step.select(*KEY, F.col("nk").alias("ak"), F.col("nb").alias("ab"), F.coalesce("uk", "tk").alias("tk"), F.when(F.col("uk").isNotNull(), F.col("ub")).otherwise(F.col("tb")).alias("tb")), "ancestors")
    lasts = slim.select("run", F.col("ck").alias("tk"), F.col("cb").alias("tb"), F.col("own_last").alias("most"))
    return state.select(*KEY, "tk", "tb").join(lasts, ["run", "tk", "tb"], "left").join(slim.select(*KEY, "last"), KEY).select(*KEY, "tk", "tb", "most", "last")


def selected(clusters: DataFrame, points: DataFrame, settings: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(run, node, level, cluster, probability, outlier_score) for the points of ``condensed``.

    ``settings`` has (run, method, epsilon): ``eom`` takes the clusters that are
    worth more than the clusters below them, ``leaf`` those that have none; a
    cluster that begins at less than ``epsilon`` gives way to its nearest
    ancestor that begins at more, or to the last one before the root. A root is
    no cluster. ``cluster`` is the least member of the cluster, or -1. Trees of
    up to ``most`` clusters are chosen from in one task each, larger ones in
    rounds by height.
    """
    every = saved(_worth(clusters, points).join(F.broadcast(settings), "run"), "cluster-worth")
    large = saved(every.groupBy("run", "origin").agg(F.count("*").alias("n")).where(F.col("n") > most).select("run", "origin"), "large-trees")
    mapped = every.join(large, ["run", "origin"], "left_anti").groupBy("run", "origin").applyInPandas(_choose, MAPPED)
    if not large.isEmpty():
        mapped = mapped.unionAll(_chosen_by_rounds(every.join(large, ["run", "origin"], "left_semi")))
    mapped = saved(mapped, "mapped")
    known = points.join(mapped, KEY)
    level, most = F.col("level"), F.col("most")
    probability = F.when(F.col("tk").isNull(), 0.0).when((most == 0) | (level == float("inf")), 1.0).otherwise(F.least(level, most) / most)
    score = F.when((F.col("last") == 0) | (level == float("inf")), 0.0).when(F.col("last") == float("inf"), 1.0).otherwise((F.col("last") - level) / F.col("last"))
    return known.select("run", "node", "level", F.coalesce("tk", F.lit(-1)).alias("cluster"), probability.alias("probability"), score.alias("outlier_score"))


# -- all together -------------------------------------------------------------------


def neighbours(vectors: DataFrame, most: int, within: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(i, id, place, d): the ``most`` nearest of each row (g, id, v) in its group. ``within`` (id, _bucket) restricts them."""

    def both_ways(batches: Rows) -> Rows:
        for batch in batches:
            for row in range(batch.num_rows):
                q, m = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
                yield from nearest_of(q, m, most + 1)
                if not batch.column("same")[row].as_py():
                    yield from nearest_of(m, q, most + 1)

    if within is None:
        tiles = _tiles(vectors.select("g", F.col("id").alias("i"), "v"), tile)
        met = tiles.mapInArrow(both_ways, "query_id long, id long, similarity double").where("query_id <> id")
        near = met.select(F.col("query_id").alias("i"), "id", "similarity")
    else:
        rows = vectors.join(within, "id").withColumn("gb", F.xxhash64("g", "_bucket"))
        met = nearest(rows.select(F.col("id").alias("query_id"), "v", "gb"), rows.select("id", "v", "gb"), most + 1, "gb")
        near = met.where("query_id <> id").groupBy(F.col("query_id").alias("i"), "id").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("similarity", DECIMALS)), "id"))
    return near.withColumn("place", place).where(F.col("place") <= most).select("i", "id", "place", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))), DIGITS).alias("d"))


def core_distances(vectors: DataFrame, near: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """(g, id, samples, core) of rows (g, id, v) with their neighbours: the distance of the ``samples``-th, or of the last where there are fewer.

    One without neighbours has none.
    """
    cores = near.groupBy("i").agg(*(F.max(F.when(F.col("place") <= k, F.col("d"))).alias(f"_{k}") for k in wanted))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("samples"), F.col(f"_{k}").alias("core")) for k in wanted))).alias("c")
    return vectors.select("g", "id").join(cores.select(F.col("i").alias("id"), each), "id").select("g", "id", "c.*")


def _forest_joined(tree_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trees with their components joined at an infinite distance, as pairs that never met leave them apart."""
    parts = connected_components(tree_edges.select(F.struct("tree", F.col("u").alias("n")).alias("u"), F.struct("tree", F.col("v").alias("n")).alias("v")))
    tops = parts.select(F.col("component.tree").alias("tree"), F.col("component.n").alias("top")).distinct()
    alone = nodes.select("tree", F.col("node").alias("top")).join(parts.select(F.col("node.tree").alias("tree"), F.col("node.n").alias("top")), ["tree", "top"], "left_anti")
    tops = saved(tops.unionAll(alone), "tops")
    first = tops.groupBy("tree").agg(F.min("top").alias("first"))
    bridges = tops.join(first, "tree").where("top <> first").select("tree", F.col("first").alias("u"), F.col("top").alias("v"), F.lit(float("inf")).alias("w"))
    return tree_edges.unionAll(bridges)


def grid_clusters(vectors: DataFrame, grid: Sequence[tuple[int, int, float]], method: str = "eom", by: str | None = None, within: DataFrame | None = None, most: int = MOST_EDGES, tile: int = TILE) -> DataFrame:
    """(run, id, cluster, core, probability, outlier_score) for each setting (min_cluster_size, min_samples, epsilon) of the grid, run being its number.

    Distances are Euclidean between unit vectors, to six decimals. There is one
    spanning tree for each ``min_samples`` and one condensed tree for each pair
    of that and ``min_cluster_size``; epsilons only select. With ``by`` groups
    are clustered apart. Rows without a neighbour are outliers of probability
    and score 0. Ids are distinct; an empty table gives no rows. ``within``
    restricts pairs to rows that share a bucket: parts that no pair joins are
    apart from each other at any distance.
    """
    if any(size < 2 for size, _, _ in grid):
        raise ValueError("clusters have two members or more")
    group = F.xxhash64(F.col(by)) if by else F.lit(0).cast("long")
    rows = vectors.select(group.alias("g"), "id", "v")
    samples = sorted({s for _, s, _ in grid})
    near = saved(neighbours(rows, max(samples) if within is not None else max(NEIGHBOURS, *samples), within, tile), "neighbours")
    cores = saved(core_distances(rows, near, samples), "cores")
    trees = None
    for s in samples:
        own_cores = cores.where(F.col("samples") == s).drop("samples")
        edges = tree_edges(rows, own_cores, near, tile, most) if within is None else reachability_edges(rows, own_cores, tile, within)
        own = spanning_tree(saved(edges, "reachability"), most)
        if within is not None:
            own = _forest_joined(saved(own, "forest"), rows.select(F.col("g").alias("tree"), F.col("id").alias("node")))
        own = own.withColumn("samples", F.lit(s))
        trees = own if trees is None else trees.unionAll(own)
    trees = saved(trees, "spanning-trees")
    # a tree's number is its place among groups; its runs differ in the least size only
    pairs = sorted({(m, s) for m, s, _ in grid})
    spark = vectors.sparkSession
    shapes = spark.createDataFrame([(k, m, s) for k, (m, s) in enumerate(pairs)], "run long, least_size long, samples int")
    clusters, points = condensed(trees.join(F.broadcast(shapes), "samples").select("run", "tree", "u", "v", "w", "least_size"), most)
    runs = spark.createDataFrame([(pairs.index((m, s)), n, method, float(e)) for n, (m, s, e) in enumerate(grid)], "shape long, run long, method string, epsilon double")
    each = lambda df: df.withColumnRenamed("run", "shape").join(F.broadcast(runs.select("shape", "run")), "shape").drop("shape")
    found = selected(saved(each(clusters), "run-clusters"), each(points), runs.select("run", "method", "epsilon"), most)
    numbered = spark.createDataFrame([(n, s) for n, (_, s, _) in enumerate(grid)], "run long, samples int")
    asked = vectors.select("id").crossJoin(F.broadcast(numbered)).join(cores.select("id", "samples", "core"), ["id", "samples"], "left")  # a row for each setting, as asked for
    out = asked.join(found.select("run", F.col("node").alias("id"), "cluster", "probability", "outlier_score"), ["run", "id"], "left")
    return out.select("run", "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "core", F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("outlier_score", F.lit(0.0)).alias("outlier_score"))


def hierarchical_clusters(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int = 3, epsilon: float = 0.0, method: str = "eom", by: str | None = None, within: DataFrame | None = None, most: int = MOST_EDGES, tile: int = TILE) -> DataFrame:
    """(id, cluster, core, probability, outlier_score) of rows (id, v), as ``grid_clusters`` gives them for one setting."""
    return grid_clusters(vectors, [(min_cluster_size, min_samples, epsilon)], method, by, within, most, tile).drop("run")
