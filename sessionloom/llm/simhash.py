"""Near-duplicates by SimHash: a binary trie self-join finds all fingerprints within a Hamming budget.

The trie over the fingerprints is joined with itself by walking down pairs of
nodes together, from the root: the bits in which the two nodes differ are added
up, and a pair is pruned when they exceed the budget.

To spread that over a cluster, the bits are also read from two other starting
points. Of budget + 1 bit blocks at least one is equal in any linked pair, so
in the reading that starts with that block the walk meets the pair below one
node. The nodes at the end of the first block are the units of work: every
fingerprint goes to budget + 1 of them, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.graph import connected_components

from .common import discard, give_back, likely_in, saved, small_batches

__all__ = ["components_of", "fingerprint_bytes", "grouped_fingerprints", "linked_fingerprints", "near_duplicates", "simhash_column", "similarity", "trie_pairs"]

BITS = 64
#: Shingles hashed at once; bounds memory only.
HASHED_AT_ONCE = 200_000
#: Node pairs expanded at once; bounds memory only.
PAIRS_AT_ONCE = 2_000_000
#: Bits walked down in one step.
STEP = 3
SEED = 42


# -- fingerprints ---------------------------------------------------------------


def shingle_hashes(text: bytes, words_per_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 values of a UTF-8 text's word shingles, repeats included, in parts; a text of fewer words is one shingle.

    Bytes A-Z are lower-cased; words are runs of bytes other than space and 09-0D.
    """
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(len(words), words_per_shingle) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHED_AT_ONCE):
        some = slice(at, at + HASHED_AT_ONCE)
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[some], stops[some], strict=True)], np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The SimHash of hash values: bits set in over half of them; 0 of none."""
    counts, n = np.zeros(BITS, np.int64), 0
    for part in hashes:
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_bytes(text: bytes, words_per_shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; see ``shingle_hashes`` for its shingles. No words give 0."""
    return majority(shingle_hashes(text, words_per_shingle))


def simhash_column(text: Column, words_per_shingle: int = 3) -> Column:
    """SimHash of a text column as a signed 64-bit number; a null counts as an empty text (0)."""

    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        give_back()
        found = (fingerprint_bytes((t.as_py() or "").encode("utf-8", "replace"), words_per_shingle) for t in texts)
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return simhash(text)


# -- the trie walk --------------------------------------------------------------


def trie_pairs(keys: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ascending distinct 64-bit keys that agree in the first ``depth`` bits and differ in at most ``budget``.

    A node is the run of keys with one prefix. All pairs of nodes of one depth
    are walked down together; those over the budget are pruned, as are nodes
    paired with themselves that hold a single key.
    """
    bits_of = np.array([bin(x).count("1") for x in range(1 << STEP)], np.int8)

    def runs(d: int) -> np.ndarray:
        prefix = keys >> np.uint64(BITS - d) if d else np.zeros(len(keys), np.uint64)
        return np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(keys)]])

    bounds = {d: runs(d) for d in [*range(depth, BITS, STEP), BITS]} if len(keys) else {}

    def walk(d: int, a: np.ndarray, b: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while d < BITS and len(a):
            step = min(STEP, BITS - d)
            here, below = bounds[d], bounds[d + step]
            child = np.searchsorted(below, here)  # the first child of each node
            low = (keys[below[:-1]] >> np.uint64(BITS - d - step)) & np.uint64((1 << step) - 1)
            na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
            each = na * nb
            if each.sum() > PAIRS_AT_ONCE and len(a) > 1:
                half = len(a) // 2
                yield from walk(d, a[:half], b[:half], spent[:half])
                a, b, spent = a[half:], b[half:], spent[half:]
                continue
            pair = np.repeat(np.arange(len(a)), each)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            ca, cb = child[a][pair] + k // nb[pair], child[b][pair] + k % nb[pair]
            used = spent[pair] + bits_of[(low[ca] ^ low[cb]).astype(np.int64)]
            size = np.diff(below)
            keep = (used <= budget) & ((ca < cb) | ((ca == cb) & (size[ca] > 1)))
            a, b, spent, d = ca[keep], cb[keep], used[keep], d + step
        if len(a):
            yield a, b

    if len(keys) > 1:
        top = bounds[depth]
        many = np.flatnonzero(np.diff(top) > 1)
        yield from walk(depth, many, many, np.zeros(len(many), np.int8))


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> None:
    """Join the ends of links in a union-find over key indices."""

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(rotation, length) of budget + 1 blocks that cover the 64 bits."""
    cuts = [round(k * BITS / (budget + 1)) for k in range(budget + 2)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(budget + 1)]


def _rotated(column: Column, by: int) -> Column:
    return column if by == 0 else F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, BITS - by))


def linked_fingerprints(fingerprints: DataFrame, budget: int = 2) -> DataFrame:
    """Links (u, v) that join distinct fingerprints (column ``fp``, long) exactly as all pairs within ``budget`` bits do.

    The links of one unit of work are reduced to a spanning forest there, so at
    most ``budget`` + 1 links a fingerprint leave it, and no connection is lost.
    """
    blocks = _blocks(budget)
    copies = fingerprints.select(F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(_rotated(F.col("fp"), by), BITS - size).alias("node"), _rotated(F.col("fp"), by).alias("key")) for k, (by, size) in enumerate(blocks)))).alias("c")).select("c.*")
    placed = copies.repartition("turn", "node").sortWithinPartitions("turn", "node", "key")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        for batch in batches:
            turn = batch.column("turn").to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.rec.fromarrays([turn, key], names="turn,key")
            rows = rows if rest is None else np.concatenate([rest, rows])
            node = rows["key"] >> np.array([BITS - size for _, size in blocks], np.uint64)[rows["turn"]]
            whole = np.flatnonzero((node != node[-1]) | (rows["turn"] != rows["turn"][-1]))
            stop = whole[-1] + 1 if len(whole) else 0
            rest = rows[stop:]
            yield from join_rows(rows[:stop])
        if rest is not None:
            yield from join_rows(rest)

    def join_rows(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, (by, size) in enumerate(blocks):
            keys = np.unique(np.ascontiguousarray(rows["key"][rows["turn"] == k]))
            parent: dict[int, int] = {}
            for a, b in trie_pairs(keys, size, budget):
                _forest(a, b, parent)
            if parent:
                ends = np.array(list(parent.items()), np.int64)
                ends = ends[ends[:, 0] != ends[:, 1]]
                fp = keys if by == 0 else (keys >> np.uint64(by)) | (keys << np.uint64(BITS - by))
                u, v = fp[ends[:, 0]].view(np.int64), fp[ends[:, 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return placed.mapInArrow(join, "u long, v long")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, budget: int = 2) -> DataFrame:
    """Rows (id, fp, component_id), one for each row of ``docs``.

    ``fp`` is the signed SimHash; ``component_id`` is the smallest id reachable
    over links of at most ``budget`` bits, the row's own included. Null and
    empty texts have fingerprint 0, which links like any other. A null id is
    never a component's name unless all ids of the component are null; then
    ``component_id`` is null. Repeated rows are in the same component. Texts of
    any length are read whole, other columns not at all. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    prints = saved(docs.select(F.col(id_col).alias(id_col), simhash_column(F.col(text_col), words_per_shingle).alias("fp")), "simhash")
    nodes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    member = saved(connected_components(linked_fingerprints(nodes.select("fp"), budget)), "components")
    linked = member.join(nodes, member["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("least"))
    of_linked = member.join(linked, "component").select(F.col("node").alias("fp"), F.col("least").alias("least_linked"))
    # written, so that the join below has an exchange of its own on both sides and a hot group can be split
    least = saved(nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("least_linked", "least").alias("component_id")), "component-ids")
    return prints.join(least, "fp").select(id_col, "fp", "component_id")


# -- near-duplicates by similarity ------------------------------------------------

#: Samples of a text, and shingles in a sample.
SAMPLES, SAMPLED = 16, 4
#: Bits in which fingerprints of a whole text or a sample may differ to be linked by the trie walk.
BUDGET = 2
#: Rounds of choosing a group's hub; what they leave is compared wholly, in blocks.
ROUNDS = 4
#: Most members and bytes of text of a block, on average, and columns of a product of matrices; bound memory only.
BLOCK_ROWS, BLOCK_BYTES, COLUMNS_AT_ONCE = 512, 4_000_000, 4_096


def sample_fingerprints(text: bytes, words_per_shingle: int) -> list[int | None]:
    """SimHash fingerprints of SAMPLES small samples of a text's distinct shingles, and that of the whole text; None where there are no shingles.

    The range of hash values is cut into SAMPLES * SAMPLED bins; a sample is
    the least value of each of its bins. Texts with a share s of all their
    different shingles in common (two thirds, where Dice's similarity is .8) have
    a sample equal with probability of about s to the power SAMPLED, so one of
    SAMPLES is equal with .97 or more. Samples that differ, those of short texts
    too, have fingerprints that are as far apart as any two.
    """
    parts = list(shingle_hashes(text, words_per_shingle))
    if not parts:
        return [None] * (SAMPLES + 1)
    hashes = np.sort(np.concatenate(parts))
    bins = SAMPLES * SAMPLED
    shift = np.uint64(BITS - bins.bit_length() + 1)
    at = np.searchsorted(hashes, np.arange(bins, dtype=np.uint64) << shift)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    there = (at < len(hashes)) & (least >> shift == np.arange(bins, dtype=np.uint64))
    # an empty bin counts as itself, so that texts with other empty bins differ
    filled = np.where(there, least, np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not there.all():
        # what fills it follows from its whole sample, as values that all short texts share would leave a majority few bits to differ in
        whole = filled.reshape(SAMPLES, SAMPLED).copy()
        for k in np.flatnonzero(~there).tolist():
            filled[k] = xxhash.xxh64_intdigest(whole[k // SAMPLED].tobytes(), k)
    samples = [majority(iter([filled[k : k + SAMPLED]])) if there[k : k + SAMPLED].any() else None for k in range(0, bins, SAMPLED)]
    return [*samples, majority(hashes[k : k + HASHED_AT_ONCE] for k in range(0, len(hashes), HASHED_AT_ONCE))]


def similarity(a: bytes, b: bytes, words_per_shingle: int) -> float:
    """Dice similarity of two texts' sets of shingles, the share of shingles that are in both; 1 for two texts without words."""
    x, y = (np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, words_per_shingle)])) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 2 * both / (len(x) + len(y)) if len(x) + len(y) else 1.0


def shared_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``sets`` has in common with each of ``others``; a set's values are distinct."""
    found = np.zeros((len(sets), len(others)), np.int64)

    def places(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, row = np.concatenate(of), np.repeat(np.arange(len(of)), [len(x) for x in of])
        return np.unique(values), values, row

    (known_a, a, row_a), (known_b, b, row_b) = places(sets), places(others)
    both = np.intersect1d(known_a, known_b, assume_unique=True)
    for k in range(0, len(both), COLUMNS_AT_ONCE):
        some = both[k : k + COLUMNS_AT_ONCE]

        def ones(values: np.ndarray, row: np.ndarray, n: int, some: np.ndarray = some) -> np.ndarray:
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            there = some[at] == values
            made = np.zeros((n, len(some)), np.float32)
            made[row[there], at[there]] = 1
            return made

        found += np.rint(ones(a, row_a, len(sets)) @ ones(b, row_b, len(others)).T).astype(np.int64)
    return found


def grouped_fingerprints(placed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``placed`` with each fingerprint (``fp``) replaced by its group's: the least one reachable by links of the trie walk."""
    prints = saved(placed.select("fp").distinct(), "fingerprints")
    group = connected_components(linked_fingerprints(prints, budget)).where("node <> component")
    # few fingerprints have a neighbour; written, so that the planner knows
    near = saved(group.select(F.col("node").alias("fp"), F.col("component").alias("_group")), "fingerprint-groups")
    others = [c for c in placed.columns if c != "fp"]
    return placed.join(near, "fp", "left").select(*others, F.coalesce("_group", "fp").alias("fp"))


def _grown(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) of earlier ``parts`` and new ``links`` (u, v)."""
    earlier = [] if parts is None else [parts.select(F.col("node").alias("u"), F.col("component").alias("v"))]
    grown = saved(connected_components(reduce(DataFrame.unionAll, earlier, links)), "components")
    discard(*([] if parts is None else [parts]))
    return grown


def _residue_links(rows: DataFrame, active: DataFrame, made: DataFrame, words_per_shingle: int, least: float) -> DataFrame:
    """Links (u, v) between all members (``active``: id, nth, fp, component) of a group that aren't in one component yet.

    A group is cut into blocks, and each pair of blocks is a unit of work that
    holds all texts of the one against all texts of the other. Two texts meet
    in the group of their first equal sample only. What leaves a unit is a
    spanning forest of its links.
    """
    # both written, so that their join has an exchange of its own and a hot group can be split
    of = saved(active.join(made, "id"), "grouped")
    blocks = saved(of.groupBy("nth", "fp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_BYTES, F.lit(1.0))).cast("int").alias("blocks")), "blocks")
    dealt = of.join(blocks, ["nth", "fp"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "nth", "fp", "component", "samples", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    needed = saved(active.select("id").distinct(), "needed")
    some = saved(rows.where(likely_in(needed, "id", F.col("id"))).join(needed, "id", "left_semi").dropDuplicates(["id"]), "compared")

    def compare(table: pa.Table) -> pa.Table:
        ids, own = table["id"], table["own"].to_numpy()
        nth, i, j = (table[c][0].as_py() for c in ("nth", "i", "j"))
        part = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        samples = [row[:nth] for row in table["samples"].to_pylist()]
        before = np.array([[x or 0 for x in row] for row in samples], np.int64).reshape(len(ids), nth)
        empty = np.array([[x is None for x in row] for row in samples], bool).reshape(len(ids), nth)
        sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes((t.as_py() or "").encode("utf-8", "replace"), words_per_shingle)])) for t in table["text"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a) and len(b):
            both = shared_counts([sets[k] for k in a], [sets[k] for k in b])
            near = 2 * both >= least * (sizes[a][:, None] + sizes[b][None, :])
            near &= part[a][:, None] != part[b][None, :]
            x, y = np.nonzero(near)
            u, v = a[x], b[y]
            keep = (u < v) if i == j else np.ones(len(u), bool)
            keep &= ~((before[u] == before[v]) & ~empty[u] & ~empty[v]).any(axis=1)
            u, v = u[keep], v[keep]
        parent: dict[int, int] = {}
        _forest(u, v, parent)
        ends = np.array([e for e in parent.items() if e[0] != e[1]], np.int64).reshape(-1, 2)
        return pa.table({"u": ids.take(pa.array(ends[:, 0])), "v": ids.take(pa.array(ends[:, 1]))})

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    return units.join(some, "id").groupBy("nth", "fp", "i", "j").applyInArrow(compare, schema)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, component_id), one for each row of ``docs`` with an id: components of texts with a similarity of ``least`` or more.

    The similarity is Dice's, which for texts of about one length is the cosine
    that a SimHash estimates. SimHash fingerprints of whole texts, and of small
    samples of their shingles, go through the trie walk with a budget of BUDGET
    bits, and every link is verified on whole texts. The samples are there
    as a whole text's SimHash differs by some ten bits or more at .8, a budget
    that no walk can take on many documents. Equal texts are one member of a group. In a
    group of linked fingerprints all members are held against its hub: the member
    that meets most others over all samples, as the original of many variants
    does; members outside its component meet the next hub, for ROUNDS rounds.
    A group is done when its members are one component, or have been hubs. What
    is left then is compared wholly, in blocks: linear in the group where texts
    are similar, and all pairs only of those that aren't. ``component_id`` is
    the smallest id of the component. Null and empty texts are equal texts, and
    repeated rows one document. Texts of any length are read whole, other columns
    not at all, whatever their names. An empty table gives an empty result.
    """

    @F.arrow_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("samples", T.ArrayType(T.LongType()))]))
    def sketch(texts: pa.Array) -> pa.Array:
        keys, samples = [], []
        for t in texts:
            data = (t.as_py() or "").encode("utf-8", "replace")
            keys.append(xxhash.xxh3_128_digest(data))
            samples.append([None if f is None else f - (1 << 64) if f >> 63 else f for f in sample_fingerprints(data, words_per_shingle)])
        give_back()
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(samples, pa.list_(pa.int64()))], ["key", "samples"])

    @F.arrow_udf(T.DoubleType())
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        give_back()
        return pa.array([similarity((x.as_py() or "").encode("utf-8", "replace"), (y.as_py() or "").encode("utf-8", "replace"), words_per_shingle) for x, y in zip(a, b, strict=True)], pa.float64())

    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = saved(rows.select("id", sketch.asNondeterministic()(F.col("text")).alias("s"), F.octet_length("text").alias("size")).select("id", "s.key", "s.samples", "size"), "sketches")
    texts = saved(made.groupBy("key").agg(F.min("id").alias("rep")), "distinct-texts")
    distinct = made.join(texts, (made["key"] == texts["key"]) & (made["id"] == texts["rep"]), "left_semi").dropDuplicates(["id"])
    placed = grouped_fingerprints(distinct.select("id", F.posexplode("samples").alias("nth", "fp")).where("fp IS NOT NULL"))
    groups = placed.groupBy("nth", "fp").agg(F.count("*").alias("n")).where("n > 1")
    found = saved(placed.join(saved(groups, "sample-groups"), ["nth", "fp"]).select("id", "nth", "fp", "n"), "grouped")
    score = saved(found.groupBy("id").agg(F.sum("n").alias("met")), "met")
    active = found.select("id", "nth", "fp", F.col("id").alias("component"))

    parts = tested = None
    for _ in range(ROUNDS):
        best = F.min_by(F.struct("id", "component"), F.struct(-F.col("met"), "id"))
        hubs = saved(active.join(score, "id").groupBy("nth", "fp").agg(best.alias("h")).select("nth", "fp", F.col("h.id").alias("hub"), F.col("h.component").alias("of_hub")), "hubs")
        met = active.join(hubs, ["nth", "fp"]).where("component != of_hub")
        pairs = met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionAll(pairs)
        needed = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
        if not needed.isEmpty():
            some = saved(rows.where(likely_in(needed, "id", F.col("id"))).join(needed, "id", "left_semi").dropDuplicates(["id"]), "compared")
            both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
            new = saved(both.select("a", "b", alike(F.col("x"), F.col("y")).alias("j")).where(F.col("j") >= least).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
            discard(some)
            if not new.isEmpty():
                parts = _grown(parts, new)
            discard(new)
        # a hub has met all members outside its component; a group within one component is done
        left = active.join(hubs.select("nth", "fp", F.col("hub").alias("id")), ["nth", "fp", "id"], "left_anti")
        if parts is not None:
            left = left.drop("component").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "nth", "fp", F.coalesce("component", "id").alias("component"))
        left = saved(left, "left")
        open_groups = saved(left.groupBy("nth", "fp").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("nth", "fp"), "open-groups")
        active = saved(left.join(open_groups, ["nth", "fp"], "left_semi"), "grouped")
        discard(needed, hubs, left, open_groups)
        if active.isEmpty():
            break
    else:
        new = saved(_residue_links(rows, active, made.select("id", "samples", "size").dropDuplicates(["id"]), words_per_shingle, least), "links")
        parts = parts if new.isEmpty() else _grown(parts, new)

    of_copies = made.join(texts, "key").select("id", "rep")
    if parts is None:
        return of_copies.select(F.col("id").alias(id_col), F.col("rep").alias("component_id"))
    found = of_copies.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("component_id"))
