"""Incremental forms, beyond what the batch operators ask for: new sessions only, counts by time window, and a capped memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

__all__ = ["capped_memory", "label_counts", "new_only"]


def new_only(stream: DataFrame, processed: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of a stream whose key is not in the table of processed ones, as that table stands when a batch starts."""
    known = processed.select(key).distinct().withColumn("_known", F.lit(True))
    return stream.join(known, key, "left").where("_known IS NULL").drop("_known")


def label_counts(stream: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean confidence by window of time and label; rows over ``late`` behind are left out."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, window), "label")
    return grouped.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")).select(F.col("window.start").alias("start"), "label", "n", "mean_confidence")


def capped_memory(stream: DataFrame, cap: int = 50) -> DataFrame:
    """For each label the number of sessions held and the oldest of them, after each batch: the newest ``cap`` by id stay.

    The state of a label is ``cap`` ids, whatever the stream holds.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held = sorted({*held, *pdf["session_id"].tolist()})[-cap:]
        state.update((held,))
        yield pd.DataFrame({"label": [key[0]], "n": [len(held)], "oldest": [held[0]]})

    return stream.select("label", "session_id").groupBy("label").applyInPandasWithState(update, "label string, n long, oldest long", "held array<bigint>", "update", GroupStateTimeout.NoTimeout)
