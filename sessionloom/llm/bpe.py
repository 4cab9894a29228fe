"""BPE encoding and decoding with a given vocabulary: speculate and verify.

For every distinct word a greedy longest match proposes tokens. A sequence of
tokens is what exact merging gives if and only if every token encodes to itself
and every adjacent pair is compatible, which means that no merge across their
border would have come first. The pairs of a whole batch are tested at once
with numpy; only the words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, small_batches

__all__ = ["WordBPE", "decode", "encode"]

#: Texts are encoded in slices of about so many characters, to bound memory.
SLICE_CHARS = 500_000
#: Distinct words a worker remembers before it starts afresh; bounds memory only, never results.
REMEMBERED_WORDS = 150_000
#: Words of up to so many symbols are merged by scanning.
SHORT_WORD = 64
#: Above every rank.
NEVER = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    at = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [at[b] for b in range(256)]


#: Letters and digits that are newer than the library's character classes (Unicode 16), to which they are neither.
NEWER = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 323B0-33479 3D000-3FC3F"
#: Capitals that Python's tables (Unicode 15) don't know, with their small letters.
NEWER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}


def _as_class(ranges: str) -> str:
    """Ranges of hexadecimal numbers as the inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in ranges.split())


def _is_latin(text: str) -> bool:
    """Whether all characters are below 256, and so none is newer than any table."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBPE:
    """A tokenizer file whose words end in a marker; see ``encode_words`` for the method."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end)}
        self.last = {t[: -len(self.end)]: i for t, i in vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.inner))
        self.longest_last = max(map(len, self.last))
        size = len(self.tokens)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, made = [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            if made and i <= made[-1]:
                raise ValueError("token ids must rise with the rank of their merge")
            self.left[i], self.right[i] = x, y
            pairs.append(x << 32 | y)
            made.append(i)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_made = np.array(pairs)[order], np.array(made)[order]
        self.merged = dict(zip(pairs, made, strict=True))
        self.stable = np.full(size, -1, np.int8)
        self.symbols = byte_symbols()
        self.bytes_of = {s: b for b, s in enumerate(self.symbols)}
        self.as_symbols = {b: s for b, s in enumerate(self.symbols)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        split = split.replace(r"\s", r"\p{White_Space}")
        self.word = regex.compile(split)
        # characters that are newer than the library's tables are no letters or digits to it
        newer = _as_class(NEWER)
        # Python's own module looks classes up in a table, where ``regex`` tries range by range
        self.newer = re.compile(f"[{newer}{''.join(map(chr, NEWER_CAPITALS))}]")
        self.word_but_newer = regex.compile("(?V1)" + regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{newer}]]", split))
        self.white = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.token_array = pa.array(self.tokens, pa.string())
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    # -- text to words ---------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, lower case letter by letter.

        No word holds white space, so folding it first would change nothing.
        """
        if text.isascii():
            return self.word.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not _is_latin(text) and self.newer.search(text):
            return self.word_but_newer.findall(text.translate(NEWER_CAPITALS))
        return self.word.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens, in order."""
        if self.cut is None or "<" not in text:
            return self.words(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            out.extend([self.special[part]] if part in self.special else self.words(part))
        return out

    # -- words to tokens -------------------------------------------------------

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of a word in byte symbols."""
        out, at, n = [], 0, len(word)
        inner, last = self.inner, self.last
        while at < n:
            if n - at <= self.longest_last and (token := last.get(word[at:])) is not None:
                out.append(token)
                break
            stop = min(n - 1, at + self.longest)
            while (token := inner.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def merge_exactly(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair that was learnt first, the leftmost of equals, until none is left."""
        n = len(ids)
        if n <= SHORT_WORD:
            return self._merge_short(list(ids))
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        get = self.merged.get
        queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            made, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (m := get(made << 32 | ids[after[i]])) is not None:
                    heapq.heappush(queue, (m, i, made, ids[after[i]]))
            if (p := before[i]) >= 0 and (m := get(ids[p] << 32 | made)) is not None:
                heapq.heappush(queue, (m, p, ids[p], made))
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for short words, where scanning beats a queue."""
        get = self.merged.get
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (made := min(ranks)) != NEVER:
            i = ranks.index(made)
            ids[i : i + 2] = [made]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << 32 | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | made, NEVER)
        return ids

    def base(self, word: str) -> list[int]:
        """A word in byte symbols as its base tokens."""
        return [*(self.inner[c] for c in word[:-1]), self.last[word[-1]]]

    def _base_of_token(self, token: int) -> list[int]:
        text = self.tokens[token]
        return self.base(text[: -len(self.end)]) if text.endswith(self.end) else [self.inner[c] for c in text]

    def self_encoding(self, ids: np.ndarray) -> np.ndarray:
        """Whether exact merging of a token's own text gives that token."""
        for token in np.unique(ids[self.stable[ids] < 0]).tolist():
            self.stable[token] = self.merge_exactly(self._base_of_token(token)) == [token]
        return self.stable[ids] == 1

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of self-encoding tokens: does exact merging of both texts together leave the two as they are?

        The merges that built the two tokens are undone, latest first; at each
        step the tokens that touch the border must have no merge that came
        before the one undone last.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER)
        while len(live):
            clash = self._merge_of(x, y) < limit
            good[live[clash]] = False
            undo_left = x > y
            split_x, split_y = self.right[x] != x, self.left[y] != y
            # the later-built side is undone; a base token can't be
            go_left = np.where(undo_left, split_x, split_x & ~split_y)
            go_right = ~go_left & split_y
            on = ~clash & (go_left | go_right)
            # a merge with the left side's rank loses to one further left, so the right side's limit is inclusive
            limit = np.where(go_left, x, y + 1)
            x, y = np.where(go_left, self.right[x], x), np.where(go_right, self.left[y], y)
            live, x, y, limit = live[on], x[on], y[on], limit[on]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words: propose for all, verify all at once, merge the failing ones exactly."""
        symbols = self.as_symbols
        texts = [w.translate(symbols) if w.isascii() else "".join([symbols[b] for b in w.encode("utf-8", "replace")]) for w in words]
        tokens = [self.propose(t) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((i for t in tokens for i in t), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        failing = np.zeros(len(tokens), bool)
        failing[owner[~self.self_encoding(flat)]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, which = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        bad = ~self.compatible(keys >> 32, keys & 0xFFFFFFFF)
        failing[owner[inside[bad[which]]]] = True
        for k in np.flatnonzero(failing).tolist():
            tokens[k] = self.merge_exactly(self.base(texts[k]))
        return tokens

    def _learn(self, words: list[str]) -> None:
        tokens = self.encode_words(words)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.known) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.known = np.concatenate([self.known, np.fromiter((i for t in tokens for i in t), np.int32, int(sizes.sum()))])

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each text."""
        if len(self.place) > REMEMBERED_WORDS:
            self._forget()
        per_text = [self.pieces(t) for t in texts]
        pieces = [p for text in per_text for p in text]
        if new := [w for w in set(pieces).difference(self.place) if isinstance(w, str)]:
            self._learn(new)
        place = self.place
        at = np.fromiter((place[p] if isinstance(p, str) else -1 - p for p in pieces), np.int64, len(pieces)) if self.cut and any("<" in t for t in texts) else np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        special, word = at < 0, np.maximum(at, 0)
        size = np.where(special, 1, self.lengths[word] if len(self.lengths) else 1)
        begin = np.cumsum(size) - size
        source = np.repeat(np.where(special, 0, self.starts[word] if len(self.starts) else 0) - begin, size) + np.arange(int(size.sum()))
        ids = self.known[np.minimum(source, len(self.known) - 1)] if len(self.known) else np.zeros(len(source), np.int32)
        ids[begin[special]] = -1 - at[special]
        ends = np.cumsum(np.fromiter(map(len, per_text), np.int64, len(per_text)))
        total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
        return ids, np.diff(total)

    def split_long(self, text: str) -> list[str]:
        """A text in parts that encode alone as they do together: cut before white space, never inside a special token."""
        out, at = [], 0
        while len(text) - at > SLICE_CHARS:
            gap = self.white.search(text, at + SLICE_CHARS)
            if gap is None:
                break
            out.append(text[at : gap.start()])
            at = gap.start()
        return [*out, text[at:]]

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Arrow strings to lists of ids; a null counts as an empty text."""
        ids, counts, waiting, owners, chars = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal waiting, owners, chars
            some, sizes = self.encode_slice(waiting)
            ids.append(some)
            np.add.at(counts, owners, sizes)
            waiting, owners, chars = [], [], 0

        for k, scalar in enumerate(texts):
            for part in self.split_long(scalar.as_py() or ""):
                waiting.append(part)
                owners.append(k)
                chars += len(part)
                if chars > SLICE_CHARS:
                    flush()
        flush()
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """Lists of ids to texts: the tokens' strings, joined by one space as there is no decoder in the file.

        Ids outside the vocabulary add nothing; a null list gives an empty text.
        """
        ids = ids.cast(pa.list_(pa.int64()))
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        there = (flat >= 0) & (flat < len(self.tokens))
        if not there.all():
            kept = np.concatenate([[0], np.cumsum(there)])
            ends = np.cumsum(sizes)
            sizes, flat = kept[ends] - kept[ends - sizes], flat[there]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        strings = self.token_array.take(pa.array(flat, pa.int64()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), strings), " ")


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold about ``limit`` bytes of a column, one row at least."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _with_columns(docs: DataFrame, source: str, outputs: dict[str, T.DataType], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``docs`` with columns made from ``source``, some rows at a time; columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in outputs or c == source]
    kept = [c for c in keep if c not in outputs]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, kind) for c, kind in outputs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, source, SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *make(some.column(source))], names=[*kept, *outputs])
            batch = some = None
            give_back()

    small_batches(docs.sparkSession)
    return docs.select(*keep).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", output: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of its texts in ``output`` (``array<int>``), and with what these decode to in ``decoded``, if named.

    Null and empty texts give an empty list. Special tokens in a text give
    their ids; none are added. Texts of any length are encoded whole, in slices
    cut before white space. Equal texts give equal ids; an empty table stays
    empty. Columns of the outputs' names are replaced, all others are kept.
    """
    kinds: dict[str, T.DataType] = {output: T.ArrayType(T.IntegerType(), False)}

    def make(texts: pa.Array) -> list[pa.Array]:
        ids = _tokenizer(path).encode_array(texts)
        return [ids] if decoded is None else [ids, _tokenizer(path).decode_array(ids)]

    return _with_columns(docs, text_col, kinds | ({decoded: T.StringType()} if decoded else {}), make)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", output: str = "decoded") -> DataFrame:
    """``docs`` with the texts of its token ids in ``output``; special tokens are kept.

    A null or empty list gives an empty text, an id outside the vocabulary or a
    null id adds nothing. A column named ``output`` is replaced.
    """
    return _with_columns(docs, ids_col, {output: T.StringType()}, lambda ids: [_tokenizer(path).decode_array(ids)])
