"""BPE against the tokenizers library."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionloom.llm import bpe
from sessionloom.llm.queries import op1_bpe, tokenizer_path


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBPE(tokenizer_path())


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def check(ours, theirs, texts):
    got = ours.encode_array(pa.array(texts, pa.string()))
    want = [e.ids for e in theirs.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got.to_pylist() == want
    assert ours.decode_array(got).to_pylist() == [theirs.decode(i, skip_special_tokens=False) for i in want]


def test_fixed_cases(ours, theirs):
    check(ours, theirs, ["", None, "Hello World's I'LL <|endoftext|>ab<|startoftext|> x", "ΑΣ ΟΔΟΣ İstanbul ﬁ é e\u0301", "a" * 5000, "aAa" * 3000, "\x1c\x1d a\x85b", "日本語 한국어 🎉🎉", "<|endoftext|>", "'''s 't 123 4½ ²", "\u200b\xa0x"])


def test_words_that_greedy_matching_gets_wrong(ours, theirs):
    pieces = [t for t in ours.last if t.isascii() and t.isalpha()]
    r = random.Random(5)
    words = ["".join(r.choice(pieces) for _ in range(r.randint(1, 5))) for _ in range(5000)]
    check(ours, theirs, words)
    texts = [w.translate(ours.as_symbols) for w in words]
    failing = sum(ours.propose(t) != ours.merge_exactly(ours.base(t)) for t in texts)
    assert 0 < failing < len(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=60), min_size=1, max_size=5))
def test_any_latin_text(ours, theirs, texts):
    check(ours, theirs, texts)


def test_every_kind_of_character_is_split_as_the_library_does(ours, theirs):
    # all that Python's tables or those of regex call a letter, a digit or a mark, but for long runs of ideographs and private use; and every 16th of the rest
    telling = regex.compile(r"[\p{L}\p{N}\p{M}\p{Z}\p{Cc}\p{Cf}]")
    plain = [(0x3500, 0x4D00), (0x4F00, 0x9F00), (0xAC10, 0xD790), (0x17010, 0x18700), (0x20010, 0x2A600), (0x2A710, 0x2EBD0), (0x30010, 0x323A0), (0x323C0, 0x33470), (0x3D010, 0x3FC30)]
    some = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not any(a <= c < b for a, b in plain) and (c % 16 == 0 and c < 0x40000 or telling.match(chr(c)) or (unicodedata.category(chr(c)) != "Cn" and not 0xE000 <= c <= 0xF8FF and c < 0xF0000))]
    for k in range(0, len(some), 20_000):
        check(ours, theirs, [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}'s !{chr(c)}?" for c in some[k : k + 20_000]])


def test_pair_check_is_exact(ours):
    r = np.random.default_rng(0)
    ids = np.array([i for t, i in ours.inner.items() if len(t) > 1])
    ids = ids[ours.self_encoding(ids)]
    a, b = r.choice(ids, 3000), r.choice(ids, 3000)
    got = ours.compatible(a, b)
    want = [ours.merge_exactly([*ours._base_of_token(x), *ours._base_of_token(y)]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_parts_of_long_texts_and_of_long_words(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "SHORT_WORD", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    check(ours, theirs, ["some words  and e\u0301 more " * 40, "x" * 200 + " y", "<|endoftext|> word " * 30, "a<|endoftext|>" * 30])


def test_table_cases(spark, edge, empty, theirs):
    got = bpe.encode(edge, tokenizer_path(), decoded="decoded").select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(got) == edge.count()
    for r in got:
        want = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == theirs.decode(want, skip_special_tokens=False)
    again = bpe.decode(spark.createDataFrame([(1, [320, None, 10**7]), (2, None), (3, [])], "k long, ids array<int>"), tokenizer_path()).orderBy("k").collect()
    assert [r["decoded"] for r in again] == [theirs.decode([320], skip_special_tokens=False), "", ""]
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_query(spark, sf, theirs):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_bpe(spark, sf).where(F.col("doc_id") % 5 == 0).collect()
    for r in got:
        ids = theirs.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_texts_of_latin_letters_are_not_searched_for_newer_ones(monkeypatch):
    from sessionloom.llm.bpe import WordBPE
    from sessionloom.llm.queries import tokenizer_path

    bpe = WordBPE(tokenizer_path())
    want = bpe.words("Grün, año \u00e9t\u00e9")
    bpe.newer = None
    assert bpe.words("Grün, año \u00e9t\u00e9") == want
