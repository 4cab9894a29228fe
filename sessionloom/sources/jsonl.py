"""JSON-lines logs: decisions read and appended, training lines written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["DECISIONS", "append_json", "chat_lines", "count_lines", "read_decisions", "write_lines"]

#: The decision log's fields.
DECISIONS = "session_id string, tenant string, human_decision string, human_confidence double, decided_at timestamp"


def read_decisions(spark: SparkSession, path: str, schema: str = DECISIONS) -> DataFrame:
    """The log's decisions; lines that aren't JSON objects of the schema, and those without session or decision, are skipped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND session_id IS NOT NULL AND human_decision IS NOT NULL").drop("_bad")


def count_lines(spark: SparkSession, path: str) -> int:
    """How many lines of a log aren't blank."""
    return spark.read.text(path).where("trim(value) <> ''").count()


def append_json(df: DataFrame, path: str) -> None:
    """Add rows to a log."""
    df.write.mode("append").json(path)


def chat_lines(question: Column, answer: Column) -> Column:
    """One training example as a JSON line of messages."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(message("user", question), message("assistant", answer)).alias("messages")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a column of lines as text files."""
    lines.write.mode("overwrite").text(path)
