"""Answers taken from earlier, nearly equal questions: a cosine join with an as-of rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.vectors import _matrix, _unit, block_pairs

__all__ = ["semantic_hits"]


def semantic_hits(asked: DataFrame, memory: DataFrame, threshold: float = 0.95, ttl: float = 86_400.0) -> DataFrame:
    """(id, hit): for each question the first answer, by time and id, whose cosine is over ``threshold``.

    Both sides have (g, id, at, v): a group, an id, seconds, a vector. Answers
    count that are earlier (or as early, with a smaller id) and younger than
    ``ttl`` seconds. Questions without one give no row; null times and vectors
    match nothing. Cosines count to nine decimals.

    A question can only meet answers of its own span of ``ttl`` seconds and the
    one before, so group and span are what rows are joined by; a crowded span is
    dealt into blocks, each pair of blocks is one product of matrices, and of a
    question's answers in a block only the first leaves it.
    """
    span = F.floor(F.col("at") / ttl)
    known = lambda rows: rows.where("at is not null and v is not null")
    packed = F.concat("v", F.array(F.col("at").cast("double"))).alias("v")
    q = known(asked).withColumn("s", F.explode(F.array(span, span - 1))).select(F.xxhash64("g", "s").alias("g"), F.col("id").alias("i"), packed)
    m = known(memory).select(F.xxhash64("g", span.alias("s")).alias("g"), F.col("id").alias("i"), packed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (qi, qv), (mi, mv) = (_matrix(batch.column(c)[row]) for c in ("q", "m"))
                order = np.lexsort((mi, mv[:, -1]))
                mi, mv = mi[order], mv[order]
                age = qv[:, -1:] - mv[:, -1:].T
                near = np.round(_unit(qv[:, :-1]) @ _unit(mv[:, :-1]).T, 9) > threshold
                fits = near & (age < ttl) & ((age > 0) | ((age == 0) & (mi[None, :] < qi[:, None])))
                some = np.flatnonzero(fits.any(axis=1))
                first = fits[some].argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(qi[some]), pa.array(mv[first, -1]), pa.array(mi[first])], names=["id", "at", "hit"])

    met = block_pairs(q, m).mapInArrow(meet, "id long, at double, hit long")
    return met.groupBy("id").agg(F.min(F.struct("at", "hit")).alias("first")).select("id", "first.hit")
