"""Exact dedup, fingerprints, line dedup and SimHash against brute force."""

import hashlib
import os
import re
import time
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows_of_spark, rows_of_sql


from sessionloom.llm import exact_dedup as E
from sessionloom.llm import fingerprints as P
from sessionloom.llm import queries as Q
from sessionloom.llm import simhash as H
from sessionloom.llm.line_dedup import dedup_lines


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert rows_of_spark(Q.queries()[name](spark, sf)) == rows_of_sql(connect(sf), Q.oracle_sql()[name])


# -- exact dedup --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.integers(0, 5))
def test_chunks_cover_the_text(data, times):
    data = data * times
    cuts = E.cut_points(data, mean=128, least=32)
    assert [*cuts] == sorted(set(cuts)) and (cuts[-1] if cuts else 0) == len(data)
    assert all(b - a >= 32 for a, b in zip([0, *cuts], cuts[:-1], strict=False))


def test_shared_passages_give_shared_chunks():
    r = np.random.default_rng(0)
    shared, a, b = (r.integers(0, 256, n, np.uint8).tobytes() for n in (60_000, 7_000, 9_000))

    def chunks(data):
        cuts = E.cut_points(data)
        return {data[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)}

    assert sum(map(len, chunks(a + shared) & chunks(b + shared))) > 50_000


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [16, 1])
def test_exact_duplicates(edge, width):
    # digests of one byte collide, and are found out
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = E.exact_duplicates(edge, width=width).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_collisions_are_found(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(600)], "doc_id long, text string")
    assert not E.collisions(docs, width=1).isEmpty() and E.collisions(docs).isEmpty()


def test_exact_duplicates_of_nothing(empty):
    assert E.exact_duplicates(empty).count() == 0


# -- fingerprints -------------------------------------------------------------------


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()) if not (t or "").isascii() else (t or "").lower()
    return re.sub(r"[\s\x0b\x1c-\x1f\x85\u00a0\u2028\u2029]+", " ", t).strip(" ")


@pytest.mark.parametrize("bits", [128, 4])
def test_equal_fingerprints_mean_equal_canonical_texts(spark, edge, bits):
    more = spark.createDataFrame([(100, "É cole\u00a0ﬁn", "x"), (101, "e\u0301  COLE fin ", "x"), (102, "é\ncolé fin", "x"), (103, None, "x"), (104, "STRASSE", "x"), (105, "straße", "x")], "doc_id long, text string, source string")
    docs = edge.select("doc_id", "text", "source").where("doc_id IS NOT NULL").unionAll(more)
    got = P.fingerprints(docs, {"text": "fingerprint"}, ["doc_id", "text"], bits=bits).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(canonical(r["text"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({f for x in by_text.values() for f in x}) == len(by_text)
    assert len(got) == docs.count()


def test_fingerprints_of_nothing(empty):
    assert P.fingerprints(empty, {"text": "f"}, ["doc_id"]).count() == 0


@pytest.mark.parametrize("ids", [[5], [3, 1, 2], list(range(0, 4000, 7)), [1, 1, 2, None, None], [None], []])
def test_next_row(spark, ids):
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = {t: (n_i, n_t) for (_, t), (n_i, n_t) in zip(order, order[1:] + order[:1], strict=True)}
    got = {r["text"]: (r["next_doc_id"], r["next_text"]) for r in P.with_next(docs, "doc_id", "text", ["doc_id", "text"]).collect()}
    assert got == want


def test_fingerprint_query(spark, sf):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in Q.op9_fingerprints(spark, sf).collect()}
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1], strict=True):
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["near_edited"] == float(canonical(t) == canonical(e)) and r["near_next"] == float(canonical(t) == canonical(n))


# -- lines --------------------------------------------------------------------------


def brute_lines(rows, least):
    def key(line):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()

    sites, first = {}, {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n")):
            if t is not None and key(line):
                sites.setdefault(key(line), set()).add(s)
                place = (i is not None, i or 0, p)
                first[key(line)] = min(first.get(key(line), place), place)
    gone = {}
    for i, t, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if t is not None and i is not None and key(line) and len(sites[key(line)]) >= least and first[key(line)] != (True, i, p):
                gone.setdefault(i, set()).add(p)
    return sorted(((i, t if i not in gone else "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]), len(gone.get(i, ()))) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("least", [2, 3])
def test_lines_against_brute_force(edge, least):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edge.collect()]
    got = dedup_lines(edge, least).select("doc_id", "text", "lines_removed").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, least)


def test_lines_on_many_sites(spark):
    random = np.random.default_rng(3)
    rows = [(d, "\n".join(f"line {x}" for x in random.integers(0, 40, 5)), f"s{d % 17}") for d in range(60)]
    rows += [(d, "  LINE   1\nown " + str(d), None) for d in range(60, 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for least in (4, 9):
        assert sorted(map(tuple, dedup_lines(df, least).select("doc_id", "text", "lines_removed").collect()), key=str) == brute_lines(rows, least)


def test_many_lines_in_one_text_take_linear_time(spark):
    seconds = []
    for n in (20_000, 160_000):
        lines = "\n".join(f"line {k}" for k in range(n))
        df = spark.createDataFrame([(d, lines + f"\nown {d}", f"s{d}") for d in range(3)], "doc_id long, text string, source string")
        began = time.perf_counter()
        got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in dedup_lines(df, 3).select("doc_id", "text", "lines_removed").collect()}
        seconds.append(time.perf_counter() - began)
        assert got == {0: (lines + "\nown 0", 0), 1: ("own 1", n), 2: ("own 2", n)}
    assert seconds[1] < 16 * seconds[0]


def test_lines_of_nothing(empty):
    assert dedup_lines(empty).count() == 0


# -- SimHash ------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "replace"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (id, fingerprint) rows; the smallest id reachable over at most two differing bits."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(prints))]


def test_simhash_table(edge):
    got = H.components_of(edge).collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in edge.collect()]
    want = sorted(zip((i for i, _ in rows), (f - (1 << 64) if f >> 63 else f for _, f in rows), brute_components(rows), strict=True), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_simhash_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)}
    assert set(map(tuple, Q.op7_simhash(spark, sf).collect())) == want


@pytest.mark.parametrize(("budget", "depth"), [(0, 0), (1, 0), (2, 0), (2, 5), (3, 1)])
def test_trie_walk_finds_all_pairs(budget, depth):
    r = np.random.default_rng(budget)
    base = r.integers(0, 1 << 63, 60, np.uint64)
    near = [base]
    for _ in range(4):
        flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, r.integers(0, 4)).astype(np.uint64), initial=np.uint64(0)) for _ in base], np.uint64)
        near.append(base ^ flips)
    keys = np.unique(np.concatenate(near))
    want = {(i, j) for j in range(len(keys)) for i in range(j) if bin(int(keys[i] ^ keys[j])).count("1") <= budget and (depth == 0 or int(keys[i]) >> 64 - depth == int(keys[j]) >> 64 - depth)}
    got = {(int(i), int(j)) for a, b in H.trie_pairs(keys, depth, budget) for i, j in zip(a, b, strict=True)}
    assert got == want


def test_chain_of_fingerprints_is_one_component(spark):
    value, rows = 0, []
    for k in range(25):
        rows.append((100 + k, value))
        value ^= (1 << (2 * k)) | (1 << (2 * k + 1))
    df = spark.createDataFrame([(f,) for _, f in rows], "fp long").repartition(5)
    from sessionloom.operators.graph import connected_components

    got = connected_components(H.linked_fingerprints(df, 2))
    assert got.select("component").distinct().count() == 1 and got.count() == 25


def test_simhash_of_nothing(empty):
    assert H.components_of(empty).count() == 0


def test_crowded_node_is_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "PAIRS_AT_ONCE", 50)
    keys = np.unique(np.concatenate([np.array([1 << a | 1 << b for a in range(20) for b in range(a)], np.uint64), np.array([0], np.uint64)]))
    want = {(i, j) for j in range(len(keys)) for i in range(j) if bin(int(keys[i] ^ keys[j])).count("1") <= 2}
    assert {(int(i), int(j)) for a, b in H.trie_pairs(keys, 21, 2) for i, j in zip(a, b, strict=True)} == want


# -- near-duplicates by similarity --------------------------------------------------


def brute_similarity(a, b, n=5):
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()

    x, y = shingles(a), shingles(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x | y else 1.0


def variant(random, words, share):
    return [w if random.random() > share else f"v{random.integers(0, 10**9)}" for w in words]


def test_near_duplicates_link_variants_of_an_original(spark):
    random = np.random.default_rng(11)
    rows, groups = [], {}
    for g in range(12):
        base = [f"w{x}" for x in random.integers(0, 3000, int(random.integers(120, 400)))]
        # the original has the largest id, and variants are less like each other than like it
        members = [" ".join(variant(random, base, 0.022)) for _ in range(int(random.integers(2, 40)))] + [" ".join(base)]
        for m in members:
            groups[len(rows)] = g
            rows.append((len(rows), m))
    rows += [(len(rows) + k, " ".join(f"w{x}" for x in random.integers(0, 3000, 200))) for k in range(40)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "one two"), (1005, "One  TWO")]
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if brute_similarity(rows[a][1], rows[b][1]) >= 0.8]
    linked = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in pairs)
    assert linked >= 0.98 * len(pairs)
    # nothing else is linked
    for a in range(len(rows)):
        for b in range(a):
            if a in groups and b in groups and groups[a] != groups[b]:
                assert got[a] != got[b]
    assert got[1001] == got[1000] == got[3] and got[1002] == got[1003] and got[1004] == got[1005]


def test_near_copies_are_found_among_documents_that_share_a_passage(spark, monkeypatch):
    random = np.random.default_rng(5)
    passage = [f"p{x}" for x in range(215)]
    own = lambda n: [f"x{x}" for x in random.integers(0, 10**9, n)]
    rows = []
    for _ in range(60):
        # two texts with .87 or so; other texts of the group stay just under .8
        tail = own(60)
        rows += [(len(rows), " ".join(passage + tail)), (len(rows) + 1, " ".join(passage + tail[:30] + own(30)))]
    random.shuffle(rows)
    want = {}
    pairs = {frozenset((a[0], b[0])) for k, a in enumerate(rows) for b in rows[:k] if brute_similarity(a[1], b[1]) >= 0.8}
    for a, b in map(sorted, pairs):
        want[a], want[b] = a, a
    assert len(pairs) == 60 and len(want) == 120
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_linked_groups_are_joined_by_a_later_link(spark):
    random = np.random.default_rng(3)
    base = [f"w{x}" for x in range(400)]
    rows, at = [], base
    for k in range(40):
        rows.append((k, " ".join(at)))
        at = [w if random.random() > 0.012 else f"v{random.integers(0, 10**9)}" for w in at]
    texts = dict(rows)
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[a] == got[b] for a in texts for b in range(a) if brute_similarity(texts[a], texts[b]) >= 0.8)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger table")
def test_recall_on_all_pairs_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        texts.setdefault((r["text"] or "").encode(), r["doc_id"])
    sets = {i: np.unique(np.concatenate([np.zeros(0, np.uint64), *H.shingle_hashes(t, 5)])) for t, i in texts.items()}
    db = duckdb.connect()
    shingles = pa.table({"id": np.repeat(list(sets), [len(x) for x in sets.values()]), "h": np.concatenate(list(sets.values()))})
    sizes = pa.table({"id": list(sets), "n": [len(x) for x in sets.values()]})
    db.register("shingles", shingles)
    db.register("sizes", sizes)
    db.execute("CREATE TABLE often AS SELECT id, h FROM shingles WHERE h IN (SELECT h FROM shingles GROUP BY h HAVING count(*) > 1)")
    pairs = db.execute("SELECT x.a, x.b FROM (SELECT p.id AS a, q.id AS b, count(*) AS n FROM often p JOIN often q ON p.h = q.h AND p.id < q.id GROUP BY ALL) x JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE 2 * x.n >= 0.8 * (s.n + t.n)").fetchall()
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(docs.select("doc_id", "text")).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.97 * len(pairs)
    # nothing is linked but by such pairs: exact components of the pairs are never finer than those found
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(i) == root(got[i]) for i in sets)


def test_the_walk_links_no_different_samples_of_short_texts():
    random = np.random.default_rng(7)
    texts = {" ".join(f"w{x}" for x in row).encode() for row in random.integers(0, 10**6, (10_000, 8))}
    keys = np.unique(np.array([f for t in texts for f in H.sample_fingerprints(t, 5)[: H.SAMPLES] if f is not None], np.uint64))
    assert len(keys) > 30_000
    assert sum(len(a) for a, _ in H.trie_pairs(keys, 21, H.BUDGET)) == 0
    # what is in common still gives an equal sample
    a, b = (H.sample_fingerprints(t, 5) for t in (b"a b c d e f g h i", b"a b c d e f g h j"))
    assert any(x == y is not None for x, y in zip(a, b, strict=True))


def test_shared_counts_are_exact(monkeypatch):
    monkeypatch.setattr(H, "COLUMNS_AT_ONCE", 7)
    random = np.random.default_rng(1)
    x, y = ([np.unique(random.integers(0, 90, n)).astype(np.uint64) for n in sizes] for sizes in ((0, 5, 40, 60), (30, 1, 50)))
    assert H.shared_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_near_duplicates_cases(spark, edge, empty):
    got = H.near_duplicates(edge).collect()
    assert len(got) == edge.where("doc_id IS NOT NULL").count()
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert found[3] == found[4] == found[5] == 3 and found[7] == 7 and found[2] == 1 and found[6] == 6
    assert H.near_duplicates(empty).count() == 0


def test_fingerprints_are_grouped_by_the_trie_walk(spark):
    far = 0x5555555555555555
    rows = [(1, 0, 0), (2, 0, 0b11), (3, 1, 0b1111), (4, 0, 0b1111111), (5, 0, far), (6, 2, far)]
    got = {r["id"]: (r["nth"], r["fp"]) for r in H.grouped_fingerprints(spark.createDataFrame(rows, "id long, nth int, fp long")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 0b1111111), 5: (0, far), 6: (2, far)}


def test_near_duplicates_go_through_the_trie_walk(spark, monkeypatch):
    budgets, walk = [], H.linked_fingerprints
    monkeypatch.setattr(H, "linked_fingerprints", lambda prints, budget: (budgets.append(budget), walk(prints, budget))[1])
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "one two three")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and budgets == [H.BUDGET]
