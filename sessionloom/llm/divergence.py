"""How far the sources of a language differ in their words, exactly.

Terms that few documents of a language hold are no part of the comparison, and
nearly all different terms are such. So each task sketches the document
frequencies of its terms (count-min, whose cells hold at least what any of
their terms has), the sketches are merged, and terms with a cell below the
threshold are discarded before anything is shuffled. What survives is counted
exactly, and sources are compared by joins of the terms they really hold: what
all other terms add to a pair of sources follows from totals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, saved

__all__ = ["divergence", "impossible", "term_counts", "terms_of"]

#: Rows and cells a row of the sketch; its merged form, a bit a cell, is what tasks get: 512 KB. More different terms let more through, and change no result.
ROWS, CELLS = 4, 1 << 20
#: Cells that travel together.
PART = 1 << 16
#: Different terms that a task holds before it puts them into the sketch, or sends their counts.
HELD = 400_000
#: What a document adds to a term's count besides its occurrences, which a task never has so many of: one number holds both.
DOCUMENT = 1 << 36
#: Share that a term without occurrences is given, and the scale of shares.
PSEUDO, SCALE = 5, 1_000_000_000

#: Bytes of a term: letters of ASCII, in lower case, and all bytes of other characters; anything else parts terms.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order; only A to Z are lower-cased."""
    return text.translate(LETTERS).split()


def _cells(lang: bytes, terms: list[bytes], rows: int, cells: int) -> np.ndarray:
    """For each term its cell in every row of the sketch."""
    pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(lang + b"\x00" + t) for t in terms]), ">u8").reshape(-1, 2).astype(np.uint64)
    steps = np.arange(rows, dtype=np.uint64)[:, None]
    return ((pairs[:, 0] + steps * (pairs[:, 1] | np.uint64(1))) % np.uint64(cells)).astype(np.int64)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(lang, source, text) in UTF-8; a null is empty."""
    for batch in batches:
        columns = [batch.column(c).cast(pa.binary()) for c in range(3)]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() or b"" for c in columns)
        batch = columns = None
        give_back()


def _sketcher(least: int, rows: int, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sketch of a task's documents; cells stop at the threshold, as more makes no difference."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, cells), np.uint8 if least <= 127 else np.int64)
        held: dict[bytes, Counter[bytes]] = {}
        size = 0

        def put() -> None:
            for lang, counts in held.items():
                at, n = _cells(lang, [*counts], rows, cells), np.fromiter(counts.values(), np.int64)
                for row in range(rows):
                    where, inverse = np.unique(at[row], return_inverse=True)
                    more = np.minimum(np.bincount(inverse, n), least).astype(np.int64)
                    table[row, where] = np.minimum(table[row, where] + more, least)
            held.clear()

        for lang, _, text in _documents(batches):
            own = held.setdefault(lang, Counter())
            before = len(own)
            own.update(set(terms_of(text)))
            size += len(own) - before
            if size > HELD:
                put()
                size = 0
        put()
        flat = table.reshape(-1)
        parts = [(k, zlib.compress(part.tobytes(), 1)) for k in range(0, flat.size, PART) if (part := flat[k : k + PART]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // PART for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "cells"])

    return sketch


def _merger(least: int, kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of sketches added up as they come; at most a whole sketch is held. Gives a bit for each cell that reaches the threshold."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(zlib.decompress(data.as_py()), kind)
                sums[part] = np.minimum(sums[part] + cells, least) if part in sums else cells
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in sums.values()], pa.binary())], names=["part", "bits"])

    return merge


def impossible(docs: DataFrame, least: int, rows: int = ROWS, cells: int = CELLS) -> np.ndarray:
    """Bits (rows x cells) of the cells that reach ``least`` documents; a term with another cell is in fewer. ``docs`` has lang, source, text."""
    kind = np.uint8 if least <= 127 else np.int64
    parts = docs.mapInArrow(_sketcher(least, rows, cells), "part int, cells binary")
    merged = parts.repartition("part").mapInArrow(_merger(least, kind), "part int, bits binary")
    reached = np.zeros(rows * cells, bool)
    # as many bits as the sketch has cells, whatever the number of documents
    for row in merged.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: PART]
        reached[row["part"] * PART : row["part"] * PART + bits.size] = bits[: reached.size - row["part"] * PART]
    return np.packbits(reached.reshape(rows, cells), axis=1)


def _counter(reached: np.ndarray, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences and documents of the surviving terms, summed up within the task."""

    def survivors(lang: bytes, terms: list[bytes]) -> np.ndarray:
        at = _cells(lang, terms, len(reached), cells)
        return np.logical_and.reduce([(reached[r, at[r] >> 3] >> (7 - (at[r] & 7))) & 1 for r in range(len(reached))]).astype(bool)

    def send(held: dict[tuple[bytes, bytes], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            terms = [*counts]
            keep = np.flatnonzero(survivors(lang, terms)) if terms else []
            kept = [terms[k] for k in keep]
            sums = np.fromiter((counts[t] for t in kept), np.int64, len(kept))
            same = lambda value: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(kept), np.int32)), pa.array([value], pa.binary()).cast(pa.string())).dictionary_decode()
            yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums % DOCUMENT), pa.array(sums // DOCUMENT)], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], dict[bytes, int]] = {}
        size = 0
        for lang, source, text in _documents(batches):
            counts = held.setdefault((lang, source), {})
            before, get = len(counts), counts.get
            for term, n in Counter(terms_of(text)).items():
                counts[term] = get(term, 0) + n + DOCUMENT
            size += len(counts) - before
            if size > HELD:
                yield from send(held)
                held, size = {}, 0
        yield from send(held)
        give_back()

    return count


def term_counts(docs: DataFrame, least: int, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(lang, source, term, n): exact occurrences of the terms that at least ``least`` documents of the language hold; ``docs`` has lang, source, text without nulls."""
    reached = impossible(docs, least, rows, cells)
    survived = docs.mapInArrow(_counter(reached, cells), "lang string, source string, term string, n long, docs long")
    counts = saved(survived.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    return saved(counts.join(saved(kept, "kept-terms"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PSEUDO) / (total + PSEUDO * terms)), exactly for any counts; null where there are no terms."""
    above = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PSEUDO} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({above}) div CAST({total} + {PSEUDO} * {terms} AS DECIMAL(20, 0)) END")


def divergence(docs: DataFrame, least: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and the terms that mark it.

    Null languages, sources and texts are empty ones. Terms are runs of ASCII
    letters and other characters beyond ASCII; A to Z are lower-cased. Those in
    ``least`` documents of the language or more are kept, V of them. A group
    (lang, source), or a language, gives a term with n occurrences the share
    1 + floor(1e9 * (n + 5) / (N + 5 * V)), N being its occurrences of all kept
    terms. ``pair``: the value is the sum over all kept terms of the shares'
    absolute differences (0 if there are none), for each other source of the
    language, all of them. ``term``: terms that the group holds and whose share
    is above the language's, by the difference, the first ``top``. Ranks start
    at 1, larger values first, ties in order of the item's bytes. Repeated rows
    count each; other columns aren't read; an empty table gives no rows.

    A group of any size is summed up within tasks; a term has one row for each
    source before pairs are joined, and each pair of sources of a language is
    one row of the result, as asked for.
    """
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = term_counts(texts, least, rows, cells)
    langs = saved(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "language-counts")
    sizes = langs.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    held = counts.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.select("lang", "source", zero("held"), zero("total"), zero("kinds"), zero("lang_total")).withColumn("none", _share("0", "total", "kinds"))
    groups = saved(groups, "groups")
    shares = saved(counts.join(groups.select("lang", "source", "total", "kinds", "lang_total", "none"), ["lang", "source"]).select("lang", "source", "term", "n", "kinds", "lang_total", "none", _share("n", "total", "kinds").alias("p")), "shares")
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_group).alias("rank"))

    marks = shares.join(langs, ["lang", "term"]).withColumn("q", _share("lang_n", "lang_total", "kinds")).where("p > q")
    terms = ranked(marks.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term").where(F.col("rank") <= top)
    return ranked(_pairs(groups, shares), "pair").unionAll(terms)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways.

    With a, b the shares of a term and a0, b0 what the sources give a term they
    don't hold, the sum of |a - b| over all kept terms is that of |a - b0| over
    what the first holds, of |a0 - b| over what the second holds, and |a0 - b0|
    for as many terms as are left; where both hold a term, this is put right.
    """
    side = lambda rows, s, columns: rows.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in columns))
    two = side(groups, "a", ["source", "held", "none", "kinds"]).join(side(groups, "b", ["source", "held", "none"]), "lang").where("source_a < source_b")
    rest = F.when(F.col("kinds_a") > 0, (F.col("kinds_a") - F.col("held_a") - F.col("held_b")) * F.abs(F.col("none_a") - F.col("none_b"))).otherwise(0)
    rest = two.select("lang", "source_a", "source_b", rest.alias("value"))
    # a source's terms have few different shares
    alike = saved(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times")), "alike")
    met = side(alike, "x", ["source", "p", "times"]).join(side(groups, "y", ["source", "none"]), "lang").where("source_x <> source_y")
    alone = met.select("lang", F.least("source_x", "source_y").alias("source_a"), F.greatest("source_x", "source_y").alias("source_b"), (F.col("times_x") * F.abs(F.col("p_x") - F.col("none_y"))).alias("value"))
    alone = alone.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    kept = ["source", "p", "none"]
    one = shares.select("lang", "term", *(F.col(c).alias(f"{c}_a") for c in kept))
    other = shares.select("lang", "term", *(F.col(c).alias(f"{c}_b") for c in kept))
    both = one.join(other, ["lang", "term"]).where("source_a < source_b")
    right = F.expr("abs(p_a - p_b) - abs(p_a - none_b) - abs(none_a - p_b) + abs(none_a - none_b)")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(right).alias("value"))
    total = rest.unionAll(alone).unionAll(both).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return total.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
