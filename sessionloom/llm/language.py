"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree counts which byte follows
which context. Under the frozen counts a text's code length is a sum over its
bytes: a byte is coded in the longest known context or escapes to the next
shorter one, where the bytes already ruled out are excluded (escape method C).
The language with the shortest code wins.

As the statistics are frozen, a text's code length follows from how often each
run of ORDER + 1 bytes occurs in it, so texts are scored by counting runs.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, saved

__all__ = ["ContextTree", "Model", "count_runs", "held_out", "identify", "train"]

#: Longest context in bytes.
ORDER = 4
#: Entries of each order that the trees of all languages have at most; each tree keeps what makes up at least one part of its language's bytes in its share of them.
ENTRIES = 1 << 19
#: Bytes counted or scored at once; bounds memory only.
BYTES_AT_ONCE = 4_000_000
#: Runs whose costs a worker remembers; bounds memory only.
REMEMBERED_RUNS = 1_000_000
UNDECIDED = "und"


def parts_of(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in parts of BYTES_AT_ONCE, each after the last bytes of the part before it, and how many these are."""
    for a in range(0, len(text), BYTES_AT_ONCE):
        before = min(ORDER, a)
        yield text[a - before : a + BYTES_AT_ONCE], before


def runs_of(texts: list[bytes], before: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The run of ORDER + 1 bytes that ends at each byte of each text, as a number, and the text's index; before a text are zeros.

    The first ``before`` bytes of a text are read as the context of what follows only.
    """
    pad = b"\0" * ORDER
    data = np.frombuffer(pad.join([b"", *texts]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.zeros(len(data), np.uint64)
    for k in range(ORDER + 1):
        codes[k:] |= data[: len(data) - k if k else None] << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) + ORDER * (owner + 1)
    if before is not None and any(before):
        inside = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= np.repeat(before, sizes)
        at, owner = at[inside], owner[inside]
    return codes[at], owner


def count_runs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, run, n): how often each run of bytes occurs in each language, over all rows and whole texts.

    Each task sums up what it reads, a bounded number of bytes at a time, before anything is sent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[bytes, int]]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for lang, texts in waiting.items():
                runs, n = np.unique(runs_of([t for t, _ in texts], [b for _, b in texts])[0], return_counts=True)
                if lang in held:
                    both, inverse = np.unique(np.concatenate([held[lang][0], runs]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([held[lang][1], n])).astype(np.int64)
                    runs = both
                held[lang] = runs, n
            waiting.clear()

        def send() -> Iterator[pa.RecordBatch]:
            for lang, (runs, n) in held.items():
                for a in range(0, len(runs), 100_000):
                    some = runs[a : a + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[a : a + 100_000].astype(np.int64))], names=["lang", "run", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                for part in parts_of(data):
                    waiting.setdefault(lang, []).append(part)
                    size += len(part[0])
                    if size >= BYTES_AT_ONCE:
                        fold()
                        size = 0
                        if sum(len(r) for r, _ in held.values()) > REMEMBERED_RUNS:
                            yield from send()
            batch = text = None
            give_back()
        fold()
        yield from send()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


@dataclass
class ContextTree:
    """Frozen counts of one language. For each order k: entries (context and byte as one number, ascending) with their
    counts, and contexts with the sum of their counts, the number of bytes seen, and for both the part that is ruled
    out when a longer context has escaped."""

    entries: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    seen: list[np.ndarray]
    #: For contexts of order k >= 1: sum of counts, in the context one byte shorter, of the bytes seen here.
    shadow: list[np.ndarray]

    @classmethod
    def of(cls, entries: list[np.ndarray], counts: list[np.ndarray]) -> ContextTree:
        """From the entries of each order; those of order k, cut to k bytes, have to be among those of order k - 1."""
        tree = cls(entries, counts, [], [], [], [])
        for k, (e, n) in enumerate(zip(entries, counts, strict=True)):
            context, start = np.unique(e >> np.uint64(8), return_index=True)
            sums = np.add.reduceat(n, start) if len(n) else n
            tree.contexts.append(context)
            tree.total.append(sums.astype(np.float64))
            tree.seen.append(np.diff(np.append(start, len(e))).astype(np.float64))
            if k == 0 or not len(n):
                tree.shadow.append(np.zeros(len(context)))
                continue
            shorter = counts[k - 1][np.searchsorted(entries[k - 1], e & np.uint64((1 << 8 * k) - 1))]
            tree.shadow.append(np.add.reduceat(shorter, start).astype(np.float64))
        return tree

    def cost(self, runs: np.ndarray) -> np.ndarray:
        """Bits to code the last byte of each run after the bytes before it."""
        bits = np.zeros(len(runs))
        left = np.arange(len(runs))
        out_total, out_seen = np.zeros(len(runs)), np.zeros(len(runs))
        for k in range(len(self.entries) - 1, -1, -1):
            if not len(self.entries[k]) or not len(left):
                continue
            some = runs[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], some >> np.uint64(8)), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == some >> np.uint64(8)
            entry = np.minimum(np.searchsorted(self.entries[k], some), len(self.entries[k]) - 1)
            hit = known & (self.entries[k][entry] == some)
            total, seen = self.total[k][at] - out_total[left], self.seen[k][at] - out_seen[left]
            bits[left[hit]] -= np.log2(self.counts[k][entry][hit] / (total + seen)[hit])
            miss = known & ~hit
            # where every byte seen here is ruled out already, the escape is certain
            open_ = miss & (seen > 0)
            bits[left[open_]] -= np.log2(seen[open_] / (total + seen)[open_])
            out_total[left] = np.where(known, self.shadow[k][at], 0.0) if k else 0.0
            # bytes seen in this context are ruled out in the next shorter one
            out_seen[left] = np.where(known, self.seen[k][at], 0.0)
            left = left[~hit]
        # a byte never seen: one of those left, with equal chances
        bits[left] += np.log2(256 - np.minimum(out_seen[left], 255))
        return bits


@dataclass
class Model:
    """The languages' trees."""

    langs: list[str]
    trees: list[ContextTree]

    def costs(self, runs: np.ndarray) -> np.ndarray:
        return np.stack([tree.cost(runs) for tree in self.trees], axis=1).astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", entries: int = ENTRIES) -> Model:
    """Context trees from all rows with a language and a text.

    The counts of each order are sums over all texts. Each language has an
    equal share of ``entries``; entries that make up less than one part in that
    share of a language's bytes are left out of its tree. So the model has at
    most ``entries`` of each order, for any corpus and any number of languages.
    Tables without such rows give a model without languages.
    """
    runs = saved(count_runs(docs, text_col, lang_col), "runs")
    totals = {r["lang"]: r["n"] for r in runs.groupBy("lang").agg(F.sum("n").alias("n")).collect() if r["n"]}
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {lang: [] for lang in totals}
    share = max(256, entries // max(1, len(totals)))
    least = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, max(1, -(-n // share))))) if totals else None
    for k in range(ORDER + 1 if totals else 0):
        short = F.col("run").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        kept = runs.groupBy("lang", short.alias("entry")).agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")])
        table = kept.toArrow()
        langs = np.array(table["lang"].to_pylist(), object)
        entry, n = table["entry"].to_numpy().astype(np.uint64), table["n"].to_numpy()
        for lang in found:
            mine = langs == lang
            order = np.argsort(entry[mine])
            found[lang].append((entry[mine][order], n[mine][order]))
    names = sorted(found)
    return Model(names, [ContextTree.of([e for e, _ in found[x]], [n for _, n in found[x]]) for x in names])


class _Scorer:
    """Scores texts under a model; remembers what runs cost."""

    def __init__(self, model: Model):
        self.model = model
        self.runs, self.known = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def costs(self, runs: np.ndarray) -> np.ndarray:
        """Costs of ascending distinct runs."""
        if len(self.runs):
            at = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
            new = self.runs[at] != runs
        else:
            at, new = np.zeros(len(runs), np.int64), np.ones(len(runs), bool)
        costs = np.empty((len(runs), len(self.model.langs)), np.float32)
        costs[~new] = self.known[at[~new]]
        if new.any():
            costs[new] = self.model.costs(runs[new])
            if len(self.runs) + new.sum() > REMEMBERED_RUNS:
                self.runs, self.known = runs, costs
            else:
                place = np.searchsorted(self.runs, runs[new])
                self.runs, self.known = np.insert(self.runs, place, runs[new]), np.insert(self.known, place, costs[new], axis=0)
        return costs

    def lengths(self, texts: list[bytes], before: list[int] | None = None) -> np.ndarray:
        """Code length in bits of each text (of some MB together) in each language, but for its first ``before`` bytes."""
        codes, owner = runs_of(texts, before)
        # a run has 40 bits, which leaves 24 for the text's index
        both = np.sort(codes << np.uint64(24) | owner.astype(np.uint64))
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        n, run, text = np.diff(np.append(start, len(both))), both[start] >> np.uint64(24), (both[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(run))))
        costs = self.costs(run[first])
        return np.stack([np.bincount(text, n * costs[which, k], len(texts)) for k in range(len(self.model.langs))], axis=1)


_scorers: dict[str, _Scorer] = {}


def _scorer(key: str, packed: Broadcast) -> _Scorer:
    """The worker's scorer under a model; it outlives a task."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(pickle.loads(zlib.decompress(packed.value)))
    return _scorers[key]


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``id_cols``, ``lang_pred`` and ``score``, one row for each row of ``docs``.

    ``score`` is the language's share of probability if all are equally likely
    beforehand. Texts without a letter, null texts, and all texts under a model
    without languages are ``und`` with score 0. Whole texts are scored; long
    ones in parts, each after the end of the one before, which changes no code
    length. Only the text decides, so repeated rows get equal results; other
    columns, whatever their names, are not read. An empty table stays empty.
    """
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))
    key, langs = uuid.uuid4().hex, model.langs
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) if langs else F.lit(False)
    rows = docs.select(*id_cols, F.when(lettered, F.col(text_col)).alias("_text"))
    fields = [rows.schema[c] for c in id_cols]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, packed)
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(langs)))
            there = np.zeros(batch.num_rows, bool)
            waiting: list[bytes] = []
            owners: list[int] = []
            before: list[int] = []
            size = 0
            for k, text in enumerate(batch.column("_text")):
                if not text.is_valid:
                    continue
                there[k] = True
                data = text.as_py().encode("utf-8", "replace")
                for part, b in parts_of(data):
                    waiting.append(part)
                    owners.append(k)
                    before.append(b)
                    size += len(part)
                    if size >= BYTES_AT_ONCE:
                        np.add.at(bits, owners, scorer.lengths(waiting, before))
                        waiting, owners, before, size = [], [], [], 0
            if waiting:
                np.add.at(bits, owners, scorer.lengths(waiting, before))
            if langs:
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
            names = [langs[b] if t else UNDECIDED for b, t in zip(best.tolist(), there.tolist(), strict=True)] if langs else [UNDECIDED] * batch.num_rows
            scores = np.where(there, share, 0.0) if langs else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_cols), pa.array(names, pa.string()), pa.array(scores)], names=[*id_cols, "lang_pred", "score"])
            batch = text = None
            give_back()

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in a part; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
