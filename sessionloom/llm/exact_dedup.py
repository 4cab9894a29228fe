"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, so that shared
passages give the same chunks wherever they stand. A text's recipe is the
ordered list of its chunks' identifiers, and equal texts are those with equal
recipes. Identifiers are digests that have been verified: every distinct chunk
is sent once to the place of its digest and compared there, byte by byte, with
the others of that digest. Whole texts are never moved or compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, saved

__all__ = ["chunk_digest", "collisions", "cut_points", "exact_duplicates", "recipe_column"]

#: Bytes the rolling hash looks back on.
WINDOW = 16
#: A cut falls on one byte in so many, at chance.
MEAN_CHUNK = 2048
#: A chunk has at least so many bytes, except the last of a text.
LEAST_CHUNK = 256
#: Odd factor of the rolling hash.
FACTOR = 0x9E3779B97F4A7C15
#: Digests a task remembers to have sent; what it forgets is sent again, which changes no result.
REMEMBERED = 500_000


def cut_points(data: bytes, mean: int = MEAN_CHUNK, least: int = LEAST_CHUNK) -> list[int]:
    """Ends of the chunks of ``data``: where the hash of the last bytes falls under a bound, and at the end.

    They depend on the bytes only, so equal texts have equal chunks. An empty text has none.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    rolled, width = x * np.uint64(FACTOR), 1
    while width < WINDOW:  # the sum over twice as many bytes, each weighted by a power of the factor
        weight = np.uint64(pow(FACTOR, width, 1 << 64))
        rolled[width:] = rolled[width:] + rolled[:-width] * weight
        width *= 2
    marks = np.flatnonzero((rolled ^ (rolled >> np.uint64(29))) * np.uint64(FACTOR) < np.uint64((1 << 64) // mean)) + 1
    cuts, at = [], 0
    for mark in marks.tolist():
        if mark - at >= least and mark < n:
            cuts.append(mark)
            at = mark
    return [*cuts, n]


def chunk_digest(chunk: bytes, salt: int, width: int = 16) -> bytes:
    """The first ``width`` bytes of a chunk's XXH3 digest under a salt."""
    return xxhash.xxh3_128_digest(chunk, salt)[:width]


def recipe_column(text: Column, salt: int = 0, width: int = 16) -> Column:
    """(recipe: the digests of a text's chunks end to end, sha256 of the text); a null counts as an empty text."""

    @F.arrow_udf(T.StructType([T.StructField("recipe", T.BinaryType()), T.StructField("sha256", T.StringType())]))
    def recipe(texts: pa.Array) -> pa.Array:
        recipes, hashes = [], []
        for scalar in texts:
            data = (scalar.as_py() or "").encode("utf-8", "surrogatepass")
            cuts = cut_points(data)
            recipes.append(b"".join([chunk_digest(data[a:b], salt, width) for a, b in zip([0, *cuts], cuts, strict=False)]))
            hashes.append(hashlib.sha256(data).hexdigest())
        return pa.StructArray.from_arrays([pa.array(recipes, pa.binary()), pa.array(hashes, pa.string())], ["recipe", "sha256"])

    return recipe.asNondeterministic()(text)


def collisions(docs: DataFrame, text_col: str = "text", salt: int = 0, width: int = 16) -> DataFrame:
    """The digests (column ``digest``) that stand for chunks of different bytes; no rows once identifiers are verified.

    A task sends a chunk once, whatever number of its texts hold it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            digests, chunks, size = [], [], 0
            for scalar in batch.column(0):
                data = (scalar.as_py() or "").encode("utf-8", "surrogatepass")
                at = 0
                for cut in cut_points(data):
                    chunk = data[at:cut]
                    at = cut
                    # a wide digest under another salt tells chunks apart within the task
                    mark = xxhash.xxh3_128_digest(chunk, salt + 0x5EED)
                    if mark in sent:
                        continue
                    if len(sent) > REMEMBERED:
                        sent.clear()
                    sent.add(mark)
                    digests.append(chunk_digest(chunk, salt, width))
                    chunks.append(chunk)
                    size += len(chunk)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "chunk"])
                        digests, chunks, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "chunk"])
            batch = scalar = digests = chunks = None
            give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = chunk = None
        for batch in batches:
            found = []
            for d, c in zip(batch.column("digest").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if d == digest and c != chunk:
                    found.append(d)
                digest, chunk = d, c
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    chunks = docs.select(F.col(text_col)).mapInArrow(send, "digest binary, chunk binary")
    return chunks.repartition("digest").sortWithinPartitions("digest").mapInArrow(compare, "digest binary").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one for each row of ``docs``.

    Texts are equal if their bytes are; a null text is an empty one, so nulls
    and empty texts form one group. Of a group the row with the largest id
    stays; null ids rank below all others. Repeated rows (same id and text)
    are counted singly in ``group_size`` and share their ``kept``. Texts of any
    length are read whole, and other columns not at all. An empty table gives an
    empty result. If a digest is found to stand for two different
    chunks, all recipes are made anew under another salt, and wider.
    """
    salt = 0
    while not collisions(docs, text_col, salt, width).isEmpty():
        salt, width = salt + 1, min(16, 2 * width)
    made = docs.select(F.col(id_col).alias(id_col), recipe_column(F.col(text_col), salt, width).alias("made"))
    recipes = saved(made.select(id_col, "made.recipe", F.col("made.sha256").alias("text_sha256")), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # written, so that the join below has an exchange of its own on both sides and a hot group can be split
    known = recipes.join(saved(groups, "recipe-groups"), "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return known.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256")
