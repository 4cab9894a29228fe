"""A Merkle manifest of a table, by superblock reduction.

Rows are the leaves of one tree for each value of a column, and the trees'
roots, in order of that value, are the leaves of one tree more. A tree's nodes
are dealt into buckets of ``fanout ** k`` consecutive ones; ``applyInPandas``
collapses k levels of a bucket to its root. The bucket roots are nodes again,
so a tree of any size takes a few passes. On the way back each bucket is met by
its root's proof, and the two are concatenated: what a task holds is one
bucket, and what is written between passes is a bucket root for each bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, saved

__all__ = ["concatenated", "folded", "leaf_hash", "merkle_manifest", "numbered"]

#: Children of a node, and levels that one bucket collapses: a task holds ``FANOUT ** LEVELS`` nodes at a time.
FANOUT = 2
LEVELS = 8
#: Keys of the steps between leaves and root, which the columns of a caller can't have.
PROOF = "lefts array<string>, rights array<string>, subroot string, root string"


def leaf_hash(*values: Column) -> Column:
    """Lower hex SHA-256 of the values end to end; each is ``-`` if null, else its bytes' number, a colon and itself (numbers in decimal)."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels, left = 0, n
    while left > 1:
        levels, left = levels + 1, -(-left // fanout)
    return levels


def levels_of(n: int, fanout: int, k: int) -> int:
    """Levels that a bucket of a tree of ``n`` nodes collapses: k, or as many as the tree has where it fits one bucket."""
    return k if n > fanout**k else depth(n, fanout)


def _runs(nodes: list[str], fanout: int) -> Iterator[list[str]]:
    """Consecutive nodes that become one; the last run may have fewer, even one."""
    for a in range(0, len(nodes), fanout):
        yield nodes[a : a + fanout]


def collapse(nodes: list[str], levels: int, fanout: int) -> list[str]:
    """What remains of a bucket's nodes after so many levels."""
    for _ in range(levels):
        nodes = [_hash(run) for run in _runs(nodes, fanout)]
    return nodes


def lower_proofs(nodes: list[str], levels: int, fanout: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each node its siblings to the left and to the right, level by level, the siblings of one side end to end."""
    lefts: list[list[str]] = [[] for _ in nodes]
    rights: list[list[str]] = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    for _ in range(levels):
        above, owners = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j in range(len(run)):
                left, right = "".join(run[:j]), "".join(run[j + 1 :])
                for k in under[a + j]:
                    lefts[k].append(left)
                    rights[k].append(right)
            above.append(_hash(run))
            owners.append([k for own in under[a : a + fanout] for k in own])
        nodes, under = above, owners
    return lefts, rights


def numbered(rows: DataFrame, tree: str | None, order: list[str], index: str, size: str) -> DataFrame:
    """``rows`` with their place from 0 among those of their ``tree`` (all rows, where it is None), and the tree's size.

    Rows are dealt into ranges of (tree, order) and counted where they lie; what
    is summed up is one count for each range and tree. Ties have to be alike.
    """
    at, place, tree_key = free(rows, "_at"), free(rows, "_place"), free(rows, "_tree")
    keyed = rows.withColumn(tree_key, F.col(tree) if tree else F.lit(0))
    dealt = saved(keyed.repartitionByRange(tree_key, *order).sortWithinPartitions(tree_key, *order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    # an id is the number of the range, and in its lower 33 bits the place in it
    ranged = dealt.withColumn(place, F.shiftright(at, 33))
    held = ranged.groupBy(place, tree_key).agg(F.min(at).alias("_first"), F.count("*").alias("_held"))
    by_tree = Window.partitionBy(tree_key)
    earlier = F.coalesce(F.sum("_held").over(by_tree.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = saved(held.select(F.col(place).alias("_p"), F.col(tree_key).alias("_t"), (earlier - F.col("_first")).alias("_shift"), F.sum("_held").over(by_tree).alias("_size")), "starts")
    found = ranged.join(starts, (F.col(place) == F.col("_p")) & F.col(tree_key).eqNullSafe(F.col("_t")))
    return found.select(*rows.columns, (F.col(at) + F.col("_shift")).alias(index), F.col("_size").alias(size))


def _bucket(fanout: int, k: int) -> Column:
    return F.expr(f"_index div {fanout**k}")


def _stack(nodes: DataFrame, most: int, fanout: int, k: int) -> list[DataFrame]:
    """Nodes (_tree, _index, _n, _hash) and their bucket roots, pass by pass, until a tree is one node."""

    def collapsed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_index")
        n = int(rows["_n"].iloc[0])
        root = collapse(rows["_hash"].tolist(), levels_of(n, fanout, k), fanout)
        return pd.DataFrame({"_tree": [int(key[0])], "_index": [int(key[1])], "_n": [-(-n // fanout**k)], "_hash": root})

    stack = [nodes]
    while most > 1:
        below = stack[-1].select("_tree", "_index", "_n", "_hash").withColumn("_bucket", _bucket(fanout, k))
        stack.append(saved(below.groupBy("_tree", "_bucket").applyInPandas(collapsed, "_tree long, _index long, _n long, _hash string"), "bucket-roots"))
        most = -(-most // fanout**k)
    return stack


def _descend(stack: list[DataFrame], above: DataFrame, keep: list[T.StructField], fanout: int, k: int) -> DataFrame:
    """The proofs of the lowest nodes: those in their buckets, followed by those of the buckets' roots.

    ``above`` has the proofs of the trees' last nodes: _tree, _index (0), lefts,
    rights, subroot, root.
    """
    for left, nodes in reversed(list(enumerate(stack[:-1]))):
        names = [] if left else [f.name for f in keep]
        kinds = [] if left else [f"{f.name} {f.dataType.simpleString()}" for f in keep]
        wide = nodes.select("_tree", "_index", "_n", "_hash", *names).withColumn("_bucket", _bucket(fanout, k))
        met = wide.groupBy("_tree", "_bucket").cogroup(above.withColumn("_bucket", F.col("_index")).groupBy("_tree", "_bucket"))
        # in Arrow, as pandas would turn whole numbers with nulls among them into floats
        above = met.applyInArrow(_prover(names, fanout, k), ", ".join(["_tree long, _index long, _hash string", *kinds, PROOF]))
        if left:
            above = saved(above, "bucket-proofs")
    return above


def _prover(names: list[str], fanout: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The proofs of a bucket's nodes, given the bucket and its root's proof."""

    def proven(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("_index")
        top = upper.to_pylist()[0]
        lefts, rights = lower_proofs(nodes["_hash"].to_pylist(), levels_of(nodes["_n"][0].as_py(), fanout, k), fanout)
        found = nodes.select(["_tree", "_index", "_hash", *names])
        for name, lower in (("lefts", lefts), ("rights", rights)):
            found = found.append_column(name, pa.array([x + top[name] for x in lower], pa.list_(pa.string())))
        for name in ("subroot", "root"):
            found = found.append_column(name, pa.array([top[name]] * nodes.num_rows, pa.string()))
        return found

    return proven


def _most(nodes: DataFrame) -> int:
    """Nodes of the largest tree."""
    return nodes.agg(F.max("_n")).first()[0] or 0


def merkle_manifest(docs: DataFrame, leaf: str, tree: str, order: str, keep: Sequence[str] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For every row: ``keep``, ``leaf``, its place in its tree, lefts, rights, subroot and root.

    ``leaf`` is a column of hashes in lower hex. A tree has the rows of one value
    of ``tree`` (null is a value), in ascending ``order`` (nulls first; ties by
    hash, so repeated rows are alike). While it has more than one node, every
    ``fanout`` consecutive ones (the last run may have fewer, even one) become
    the SHA-256 of their hashes end to end; the last node is the tree's subroot.
    Subroots in order of ``tree`` (null first, bytewise) give the root likewise.
    ``lefts`` and ``rights`` hold, from the leaf's level to the root's, the
    siblings before and after the node end to end, empty where there are none;
    ``folded`` makes the root of them. Other columns aren't read; an empty
    table gives no rows.

    A bucket of ``fanout ** levels`` nodes is what a task holds; no group is the
    size of a tree. The order is found by ranges.
    """
    fields = [docs.schema[c] for c in keep]
    leaves = docs.select(F.col(tree).alias("_tree_value"), F.col(order).alias("_order"), F.col(leaf).alias("_hash"), *(F.col(c) for c in keep))
    placed = numbered(leaves, "_tree_value", ["_order", "_hash"], "_index", "_n")
    placed = saved(placed, "leaves")
    trees = numbered(placed.groupBy("_tree_value").agg(F.max("_n").alias("_leaves")), None, ["_tree_value"], "_tree", "_trees")
    trees = saved(trees.select(F.col("_tree_value").alias("_value"), "_tree", "_trees"), "trees")
    known = placed.join(trees, F.col("_tree_value").eqNullSafe(F.col("_value")))
    nodes = known.select("_tree", "_index", "_n", "_hash", *keep)
    stack = _stack(nodes, max(_most(placed), 2), fanout, levels)
    tops = saved(stack[-1].where("_index = 0").join(trees.select(F.col("_tree").alias("_t"), "_trees"), F.col("_tree") == F.col("_t")).select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_index"), F.col("_trees").alias("_n"), "_hash"), "subroots")
    crown = _stack(tops, max(_most(tops), 2), fanout, levels)
    none = F.array().cast("array<string>")
    crest = crown[-1].select("_tree", "_index", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("_hash").alias("root"))
    proven = _descend(crown, crest, [], fanout, levels)
    above = saved(proven.select(F.col("_index").alias("_tree"), F.lit(0).cast("long").alias("_index"), "lefts", "rights", F.col("_hash").alias("subroot"), "root"), "subroot-proofs")
    found = _descend(stack, above, fields, fanout, levels)
    return found.select(*keep, F.col("_hash").alias(leaf), F.col("_index").alias("place"), "lefts", "rights", "subroot", "root")


def folded(leaf: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """The root that a leaf and a proof give."""
    steps = F.arrays_zip(F.col(lefts).alias("l"), F.col(rights).alias("r"))
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["l"], node, step["r"]), 256))


def concatenated(lefts: str = "lefts", rights: str = "rights") -> Column:
    """All siblings of a proof end to end, level by level, left to right."""
    return F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), "")
