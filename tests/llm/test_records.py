"""Archives, manifests and the divergence of sources against brute force and edge cases."""

import base64
import gzip
import hashlib
import io
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionloom.llm import divergence as V
from sessionloom.llm import merkle as M
from sessionloom.llm import warc as W

# -- archives -----------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, keep long, _gone string"


@pytest.fixture(scope="session")
def pages(spark):
    long = "<p>größer</p>" * 20_000
    texts = [(1, "http://a.org/", "<p>one</p>"), (2, "http://b.org/", "<p>one</p>"), (3, None, None), (4, "http://c.org/\r\nX: y", ""), (5, "", long), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (7, "u", "another"), (None, "n", "<p>one</p>"), (None, "n", "only without an id"), (8, " é", "\x00\r\n\r\n"), (9, "u", long)]
    return spark.createDataFrame([(*t, "x", 7, "x") for t in texts], PAGES).repartition(3).cache()


def brute_records(rows, least):
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max((k for k in (keep.get(h or ""), i) if k is not None), default=None)
    found = []
    for i, _, h in rows:
        data = (h or "").encode()
        alone = i == keep[h or ""] or len(data) < least
        found.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if alone else "revisit", None if alone else keep[h or ""]))
    return sorted(found, key=str)


def page_of(c):
    return F.when(F.substring_index(c, ":", -1) != "", F.substring_index(c, ":", -1)).cast("long")


@pytest.mark.parametrize("least", [0, 11])
def test_pages_come_back_as_records(spark, pages, tmp_path, least):
    path = f"file://{tmp_path}/archive"
    W.write_warc(W.records_of_pages(pages, least), path, file_bytes=2000)
    assert len(os.listdir(tmp_path / "archive")) > 3 and not any(n.startswith("_") for n in os.listdir(tmp_path / "archive"))
    found = W.read_warc(spark, path).where("record_type <> 'warcinfo'").cache()
    got = [(r[0], *r[1:]) for r in found.select(page_of("record_id"), "payload_length", "payload_digest", "record_type", page_of("refers_to")).collect()]
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted(got, key=str) == brute_records(rows, least)
    kept = found.where("record_type = 'response'").select(page_of("record_id"), "payload", "digest_ok").collect()
    assert all(r[2] for r in kept) and Counter(bytes(r[1]) for r in kept) <= Counter((h or "").encode() for _, _, h in rows)
    assert {r[0] for r in found.where("target_uri is null").select(page_of("record_id")).collect()} == {3}
    assert [r[0] for r in found.where(page_of("record_id") == 4).select("target_uri").collect()] == ["http://c.org/%0D%0AX: y"]


def test_no_pages_give_no_records(spark, pages, tmp_path):
    path = f"file://{tmp_path}/none"
    W.write_warc(W.records_of_pages(pages.limit(0)), path)
    assert W.read_warc(spark, path).count() == 0


def test_lost_attempts_leave_nothing(spark, pages, tmp_path):
    # a task that dies after having written: its file stays out of the archive
    path = f"file://{tmp_path}/archive"
    failing = W.records_of_pages(pages).withColumn("payload", F.when(F.col("record_id").endswith(":8"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(PySparkException, match="lost"):
        W.write_warc(failing, path)
    assert [p for d, _, names in os.walk(tmp_path) for p in names if p.endswith(".gz")] == []


def foreign(records, compress):
    """An archive as other programs write it: plain, or in gzip members without lengths, with folded header lines."""
    out = io.BytesIO()
    for kind, uri, block in records:
        data = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-target-uri:\r\n  {uri}\r\nWARC-Record-ID: <urn:{uri}>\r\nContent-Type: application/http;msgtype={kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        out.write(gzip.compress(data) if compress else data)
    return out.getvalue()


@pytest.mark.parametrize("compress", [False, True])
def test_archives_of_others_and_predicates(spark, tmp_path, compress):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    records = [("request", f"r{k}", b"GET / HTTP/1.1\r\n\r\n") for k in range(3)] + [("response", f"x{k}", http + os.urandom(k * 5_000)) for k in range(6)]
    for k in range(2):
        (tmp_path / f"{k}.warc{'.gz' * compress}").write_bytes(foreign(records, compress))
    (tmp_path / "_ignored").write_bytes(b"x")
    df = W.read_warc(spark, f"file://{tmp_path}", split_bytes=1)
    assert df.rdd.getNumPartitions() == 2
    some = df.where("record_type = 'response' and target_uri > 'x2' and payload_length > 15000").select("target_uri", "payload")
    assert sorted((r[0], bytes(r[1])) for r in some.collect()) == sorted((u, b[len(http) :]) for _, u, b in records[7:] for _ in range(2) if len(b) - len(http) > 15000)
    assert df.where("not (record_type = 'request') and not (refers_to = 'x')").count() == 0 and df.where("record_type <> 'request'").count() == 12
    assert df.where("refers_to is not null").count() == 0 and df.where(F.col("target_uri").startswith("r")).count() == 6
    assert df.where(F.col("record_type").isin("request", "other")).count() == 6


def test_unwanted_payloads_are_not_inflated(tmp_path):
    # a member whose data are damaged after the header is passed over by its length, and an error only where it is wanted
    row = {"record_id": "a", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": None, "payload_length": None, "refers_to": None, "payload": os.urandom(300_000)}
    first, second = bytearray(W._member(W._record(row))), W._member(W._record(row | {"record_id": "b"}))
    first[200_000] ^= 1
    data = bytes(first) + second
    read = lambda wanted: [r["record_id"] for r in W._records(io.BytesIO(data), "f", [], wanted)]
    assert read({"record_id"}) == ["a", "b"]
    with pytest.raises(zlib.error):
        [r["digest_ok"] for r in W._records(io.BytesIO(bytes(first[:-8]) + b"\0" * 8 + second), "f", [], {"digest_ok"})]


@pytest.mark.parametrize("damage", [lambda d: d[:-40], lambda d: d[:100], lambda d: b"not an archive" * 9, lambda d: d + b"rest"])
def test_damaged_archives_are_errors(spark, tmp_path, damage):
    (tmp_path / "a.warc.gz").write_bytes(damage(foreign([("response", "u", b"HTTP/1.1 200 OK\r\n\r\n" + os.urandom(500))], True)))
    with pytest.raises(PySparkException):
        W.read_warc(spark, f"file://{tmp_path}").collect()


def test_base32(spark):
    digests = [hashlib.sha1(str(k).encode()) for k in range(200)]
    rows = spark.createDataFrame([(d.hexdigest(),) for d in digests], "h string").select(W.base32_of(F.col("h"))).collect()
    assert [r[0] for r in rows] == [W.base32(d.digest()) for d in digests]


# -- manifests ----------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fanout):
    """Root, and for each leaf the siblings level by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i // fanout * fanout
            proofs[k].append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        level = [sha(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], proofs


def brute_manifest(rows, fanout):
    """rows: (tree, order, hash)."""
    trees = {}
    for t, o, h in rows:
        trees.setdefault(t, []).append(((o is not None, o or 0), h))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    lower = {t: brute_tree([h for _, h in sorted(trees[t])], fanout) for t in order}
    root, upper = brute_tree([lower[t][0] for t in order], fanout)
    found = []
    for j, t in enumerate(order):
        for (o, h), proof in zip(sorted(trees[t]), lower[t][1], strict=True):
            whole = proof + upper[j]
            found.append((t, h, [a for a, _ in whole], [b for _, b in whole], lower[t][0], root))
    return sorted(found, key=str)


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(2, 2, [1, 2, 3, 4, 5, 16, 17, 33]), (3, 1, [1, 9, 10, 28]), (2, 8, [1, 300]), (4, 3, [7]), (2, 3, [1]), (2, 3, [1, 1])])
def test_manifest_against_brute_force(spark, fanout, levels, sizes):
    rows = [(None if j == 0 else f"t{'é' * (j % 3)}{j}", (k * 7919) % 1000 if k != 3 else None, sha(str(j), str(k // 2 * 2))) for j, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame([(*r, 1 << 60) for r in rows], "lang string, doc_id long, leaf string, _index long").repartition(3)
    got = M.merkle_manifest(docs, "leaf", "lang", "doc_id", keep=["lang"], fanout=fanout, levels=levels)
    assert sorted([(r["lang"], r["leaf"], r["lefts"], r["rights"], r["subroot"], r["root"]) for r in got.collect()], key=str) == brute_manifest(rows, fanout)
    assert got.where(M.folded(F.col("leaf")) != F.col("root")).count() == 0
    assert got.where(M.folded(F.sha2("leaf", 256)) == F.col("root")).count() == 0


def brute_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def test_leaves_of_all_kinds_of_rows(spark, edge, empty):
    leaf = M.leaf_hash(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    docs = edge.withColumn("leaf", leaf)
    for r in docs.collect():
        assert r["leaf"] == brute_leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])
    got = M.merkle_manifest(docs, "leaf", "lang", "doc_id", keep=["doc_id", "lang"], levels=1).collect()
    want = brute_manifest([(r["lang"], r["doc_id"], r["leaf"]) for r in docs.collect()], 2)
    assert sorted([(r["lang"], r["leaf"], r["lefts"], r["rights"], r["subroot"], r["root"]) for r in got], key=str) == want
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r["doc_id"] for r in docs.collect()), key=str)
    assert M.merkle_manifest(empty.withColumn("leaf", leaf), "leaf", "lang", "doc_id").count() == 0


def test_large_ids_keep_all_digits_beside_nulls(spark):
    docs = spark.createDataFrame([((1 << 60) + 1, "a"), (None, "b")], "doc_id long, leaf string").withColumn("lang", F.lit("x"))
    assert {r["doc_id"] for r in M.merkle_manifest(docs, "leaf", "lang", "doc_id", keep=["doc_id"]).collect()} == {(1 << 60) + 1, None}


# -- divergence ---------------------------------------------------------------------


def brute_terms(text):
    found, own = [], ""
    for ch in [*text, " "]:
        if ord(ch) >= 0x80 or ch.isascii() and ch.isalpha():
            own += ch.lower() if ch.isascii() else ch
        elif own:
            found.append(own)
            own = ""
    return found


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_terms(text):
    assert [t.decode() for t in V.terms_of(text.encode())] == brute_terms(text)


def brute_divergence(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    found = []
    for lang in {r[0] for r in rows}:
        own = [(s, Counter(brute_terms(t))) for g, s, t in rows if g == lang]
        docs = Counter(w for _, c in own for w in c)
        kept = {w for w, n in docs.items() if n >= least}
        counts = {s: Counter() for s, _ in own}
        for s, c in own:
            counts[s].update({w: n for w, n in c.items() if w in kept})
        every = sum(counts.values(), Counter())

        def share(c, w, kept=kept):
            return 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, w) - share(d, w)) for w in kept), o.encode()) for o, d in counts.items() if o != s]
            marks = [(share(every, w) - share(c, w), w.encode()) for w in c if share(c, w) > share(every, w)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(marks)[:top])):
                found += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(found)


@pytest.mark.parametrize(("least", "rows", "cells"), [(3, 4, 1 << 20), (3, 2, 64), (1, 1, 1 << 16), (200, 2, 1 << 16)])
def test_divergence_against_brute_force(spark, monkeypatch, least, rows, cells):
    monkeypatch.setattr(V, "HELD", 40)
    random = np.random.default_rng(5)
    words = [f"w{'é' * (k % 3)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    docs = [(["en", "fr", None][int(random.integers(3))], [f"s{k}" for k in range(5)][int(random.integers(5) ** 2 / 5)], " ".join(random.choice(words, int(random.integers(0, 40)), p=(p := 1 / np.arange(1, 201)) / p.sum()))) for _ in range(400)]
    docs += [("de", "s1", None), ("de", None, "only once"), ("en", "Z", "A.b!C\x00d")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, source string, text string, n long").repartition(3)
    got = V.divergence(df, least, top=7, rows=rows, cells=cells).collect()
    assert sorted(map(tuple, got)) == brute_divergence(docs, least, 7)


def test_divergence_of_all_kinds_of_rows(edge, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in edge.collect()]
    for least in (1, 2, 100):
        assert sorted(map(tuple, V.divergence(edge, least, 50).collect())) == brute_divergence(rows, least, 50)
    assert V.divergence(empty).count() == 0


def test_sketch_never_underestimates(spark):
    # with few cells it lets nearly all through, with many it holds nearly all back; what reaches the threshold always passes
    texts = [("en", "s", " ".join(f"{chr(97 + k % 26)}x{'y' * (j % 9)}" for j in range(k % 13))) for k in range(300)] + [("en", "s", f"rare{'z' * k}") for k in range(200)]
    df = spark.createDataFrame(texts, "lang string, source string, text string").repartition(4)
    docs = Counter(w for _, _, t in texts for w in set(brute_terms(t)))
    for cells in (1 << 8, 1 << 18):
        reached = V.impossible(df, 10, 3, cells)
        passed = lambda w, reached=reached, cells=cells: all((reached[r, a[0] >> 3] >> (7 - (a[0] & 7))) & 1 for r, a in enumerate(V._cells(b"en", [w.encode()], 3, cells)))
        assert all(passed(w) for w, n in docs.items() if n >= 10)
        if cells > 1 << 16:
            assert not any(passed(w) for w, n in docs.items() if n < 10)
    assert math.isclose(len(docs), len({*docs}))


def test_shares_of_any_size_are_exact(spark):
    n, total = 10**13, 7 * 10**15 + 3
    got = spark.range(1).select(V._share(f"{n}L", f"{total}L", "1000000L")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * 10**6)
