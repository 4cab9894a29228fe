"""Tables of a data folder, and the entities of conversation classification that are read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["FACT_COLUMNS", "as_of", "facts", "for_tenant", "messages", "table", "tags", "tenants", "vectors"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> str:
    """The fixed time that age predicates refer to, so that reruns agree."""
    return "2024-01-31 00:00:00"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: session, position, speaker and text."""
    said_by = F.when(F.col("role") == "user", "USER").when(F.col("role") == "assistant", "AGENT").otherwise(F.upper("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), said_by.alias("said_by"), F.col("text").alias("message"))


#: The classification log's columns by fixed arithmetic on the event rows, in SQL that Spark and DuckDB share.
FACT_COLUMNS = {
    "session_id": "event_id",
    "tenant_id": "user_id % 5",
    "user_id": "user_id",
    "ts": "ts",
    "label": "CASE WHEN event_id % 23 = 0 THEN 'altro' WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '' ELSE event_type END",
    "confidence": "CASE WHEN event_id % 47 = 0 THEN NULL ELSE least(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) END",
    "method": "CASE event_id % 4 WHEN 0 THEN 'AUTOMATIC' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'HUMAN_REVIEW' ELSE 'HYBRID' END",
    "review_status": "CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'auto_classified' WHEN 2 THEN 'resolved' WHEN 3 THEN 'not_required' WHEN 4 THEN 'completed' ELSE NULL END",
    "cluster_id": "CASE WHEN event_id % 31 = 0 THEN 'outlier_' || CAST(event_id % 7 AS STRING) WHEN event_id % 19 = 0 THEN '-1' WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 40 AS STRING) END",
    "is_representative": "CASE event_id % 9 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END",
    "propagated_from": "CASE WHEN event_id % 9 IN (2, 3, 4) THEN event_id % 40 ELSE NULL END",
    "ml_label": "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END",
    "ml_conf": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) / 100 END",
    "llm_label": "CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'error' ELSE event_type END",
    "llm_conf": "CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST((event_id * 53) % 101 AS DOUBLE) / 100 END",
    "uncertainty": "CAST((event_id * 11) % 101 AS DOUBLE) / 100",
    "novelty": "CAST((event_id * 29) % 101 AS DOUBLE) / 100",
    "text": "event_type || ' n ' || CAST(user_id AS STRING) || '. seen at ' || CAST(event_id % 97 AS STRING)",
}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classification log: one row for each session, with predictions, review state and cluster."""
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {c}" for c, e in FACT_COLUMNS.items()))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants: id, name, slug and whether active."""
    return table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS tenant_id", "r_name AS tenant_name", "replace(lower(r_name), ' ', '_') AS tenant_slug", "r_regionkey <> 3 AS is_active")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each tenant: name and description."""
    return table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS tag_id", "CAST(n_regionkey AS BIGINT) AS tenant_id", "lower(n_name) AS tag_name", "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'about ' || lower(n_name) END AS tag_description", "n_nationkey % 6 <> 5 AS is_active")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session vectors in double precision, with their tag."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def for_tenant(rows: DataFrame, tenant_id: int) -> DataFrame:
    """The rows of one tenant; nothing is read across tenants by chance, as the id has to be given."""
    return rows.where(F.col("tenant_id") == tenant_id)
