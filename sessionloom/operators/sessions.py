"""Folding messages into sessions, and what is asked of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["SPEAKERS", "drop_trivial_sessions", "engaged", "fold_sessions", "session_statistics", "speaker_messages", "top_sessions"]

#: Speakers that count, the prefix each gets in a session's text, greetings of users and welcomes of agents.
SPEAKERS = {"USER": "[UTENTE] ", "AGENT": "[ASSISTENTE] "}
GREETING = r"(?i)^\s*(ciao|salve|buongiorno|buonasera|hello|hi)\s*$"
WELCOME = r"(?i)(ciao.*sono|assistente.*digitale|come.*posso.*aiutarti)"


def speaker_messages(messages: DataFrame) -> DataFrame:
    """Messages of the user or the agent only."""
    return messages.where(F.col("said_by").isin(list(SPEAKERS)))


def _prefixed(m: Column) -> Column:
    return F.concat(F.when(m["said_by"] == "USER", F.lit(SPEAKERS["USER"])).otherwise(F.lit(SPEAKERS["AGENT"])), F.coalesce(m["message"], F.lit("")))


def fold_sessions(messages: DataFrame, skip: int = 2) -> DataFrame:
    """One row for each session: its messages in order, counts, first and last position, and its text without the first ``skip`` messages.

    A session's messages are gathered in one row, so a session is bounded by
    what a conversation can hold. A null message counts as an empty one.
    """
    said = speaker_messages(messages)
    folded = said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "said_by", "message"))).alias("messages"), F.count_if(F.col("said_by") == "USER").alias("n_user"), F.count_if(F.col("said_by") == "AGENT").alias("n_agent"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    text = F.array_join(F.transform(F.slice("messages", skip + 1, F.greatest(F.size("messages") - skip, F.lit(0))), _prefixed), " ")
    return folded.select("session_id", "messages", F.size("messages").cast("long").alias("n_messages"), "n_user", "n_agent", "first_position", "last_position", text.alias("full_text"))


def drop_trivial_sessions(sessions: DataFrame, greeting: str = GREETING, welcome: str = WELCOME, short: int = 10) -> DataFrame:
    """Sessions that are more than a greeting and a welcome, or than a few very short messages."""
    by = lambda who: F.filter("messages", lambda m: m["said_by"] == who)
    users, agents = by("USER"), by("AGENT")
    greeted = (F.col("n_messages") < 3) & (F.size(users) == 1) & F.get(users, F.lit(0))["message"].rlike(greeting) & (F.size(agents) <= 1) & F.exists(agents, lambda m: m["message"].rlike(welcome))
    length = F.aggregate("messages", F.lit(0), lambda acc, m: acc + F.coalesce(F.length(m["message"]), F.lit(0)))
    tiny = (length / F.col("n_messages") < short) & (F.col("n_messages") < 5)
    return sessions.where(~F.coalesce(greeted, F.lit(False)) & ~tiny)


def engaged(sessions: DataFrame) -> DataFrame:
    """Sessions in which the user wrote more than once."""
    return sessions.where("n_user > 1")


def session_statistics(sessions: DataFrame) -> DataFrame:
    """One row: mean, least, greatest and upper median of message counts and text lengths; mean and total of each speaker's messages.

    The upper median is found by ranking counts of values, which are few, so no list of all sessions is gathered.
    """
    sized = sessions.withColumn("text_length", F.length("full_text").cast("long"))
    total = sized.agg(
        F.count("*").alias("n_sessions"), F.round(F.avg("n_messages"), 4).alias("mean_messages"), F.min("n_messages").alias("min_messages"), F.max("n_messages").alias("max_messages"),
        F.round(F.avg("text_length"), 4).alias("mean_length"), F.min("text_length").alias("min_length"), F.max("text_length").alias("max_length"),
        F.round(F.avg("n_user"), 4).alias("mean_user"), F.sum("n_user").alias("total_user"), F.round(F.avg("n_agent"), 4).alias("mean_agent"), F.sum("n_agent").alias("total_agent"),
    )
    return total.crossJoin(upper_median(sized, "n_messages").withColumnRenamed("median", "median_messages")).crossJoin(upper_median(sized, "text_length").withColumnRenamed("median", "median_length"))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row with the upper median of a whole-number column."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    order = Window.orderBy(column)
    placed = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return placed.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(column).alias("median"))


def top_sessions(messages: DataFrame, n: int) -> DataFrame:
    """All messages of the ``n`` first session ids."""
    ids = messages.select("session_id").distinct().orderBy("session_id").limit(n)
    return messages.join(F.broadcast(ids), "session_id", "left_semi")  # n ids, a parameter
