"""The library's flows end to end: classify conversations, queue doubtful ones for review, take decisions back, retrain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import clusters as C
from sessionloom.operators.decisions import Gate, gate_reasons
from sessionloom.operators.density import density_clusters
from sessionloom.operators.models import Embedder, HashingEmbedder, Scorer, embed, fit_voters, score_texts, soft_vote
from sessionloom.operators.sessions import drop_trivial_sessions, fold_sessions
from sessionloom.sources.merge import upsert
from sessionloom.sources.shared import saved

__all__ = ["Engine"]


@dataclass
class Engine:
    """A scorer for representatives and outliers, an embedder, and the gate's thresholds."""

    scorer: Scorer
    embedder: Embedder = field(default_factory=HashingEmbedder)
    gate: Gate = field(default_factory=Gate)

    def sessions(self, messages: DataFrame, processed: DataFrame | None = None) -> DataFrame:
        """Sessions worth classifying (session_id, full_text); with ``processed``, only those not in it."""
        found = drop_trivial_sessions(fold_sessions(messages)).select("session_id", "full_text")
        return found if processed is None else found.join(processed.select("session_id"), "session_id", "left_anti")

    def classify(self, sessions: DataFrame, min_cluster_size: int = 5) -> DataFrame:
        """(session_id, cluster_id, label, confidence, method, is_representative), one row for each session.

        Vectors are clustered; the scorer sees only representatives and
        outliers. Members take their cluster's consensus, representatives keep
        their own label, outliers are labelled directly. A session without
        text is scored as an empty one.
        """
        texts = saved(sessions.select("session_id", F.coalesce("full_text", F.lit("")).alias("text")), "texts")
        vectors = saved(texts.select(F.col("session_id").alias("id"), embed(F.col("text"), self.embedder).alias("v")), "vectors")
        placed = saved(density_clusters(vectors, min_cluster_size).select(F.col("id").alias("session_id"), F.col("cluster").alias("cluster_id")), "placed")
        members = vectors.join(placed.withColumnRenamed("session_id", "id"), "id").where("cluster_id != -1")
        reps = saved(C.diverse_representatives(members, "cluster_id").select(F.col("id").alias("session_id")), "reps")
        asked = texts.join(reps.unionByName(placed.where("cluster_id = -1").select("session_id")), "session_id", "left_semi")
        answers = saved(score_texts(asked, "session_id", "text", self.scorer), "answers")
        votes = answers.join(placed.where("cluster_id != -1"), "session_id").select("cluster_id", F.col("session_id").alias("rep_id"), "label", "confidence")
        shared = saved(C.consensus(votes).select("cluster_id", F.col("label").alias("_l"), F.col("confidence").alias("_c")), "consensus")
        joined = placed.join(answers.select("session_id", "label", "confidence"), "session_id", "left").join(shared, "cluster_id", "left")
        outlier, rep = F.col("cluster_id") == -1, F.col("label").isNotNull()
        method = F.when(outlier, "OUTLIER_DIRECT").when(rep, "REPRESENTATIVE_ORIGINAL").otherwise("CLUSTER_PROPAGATED")
        return joined.select("session_id", "cluster_id", F.coalesce("label", "_l", F.lit("altro")).alias("label"), F.coalesce("confidence", "_c", F.lit(0.3)).alias("confidence"), method.alias("method"), (rep & ~outlier).alias("is_representative"))

    def review_queue(self, results: DataFrame) -> DataFrame:
        """``results`` that the gate asks a person about, least sure first, with the reasons."""
        reasons = gate_reasons(F.col("confidence"), F.lit(0.0), F.lit(0.0), F.when(F.col("method") == "OUTLIER_DIRECT", 1.0).otherwise(0.0), self.gate)
        return results.withColumn("reasons", reasons).where("reasons != ''").orderBy("confidence", "session_id")

    def resolve(self, results: DataFrame, decisions: DataFrame) -> DataFrame:
        """``results`` with the decisions (session_id, label, confidence) of people; what they say stands."""
        human = decisions.select("session_id", "label", "confidence", F.lit("HUMAN_REVIEW").alias("method"))
        return upsert(results, human, ["session_id"])

    def retrain(self, sessions: DataFrame, results: DataFrame, every: int = 5):
        """Voters fitted on the decided sessions, if there are a multiple of ``every``, of two labels at least; else None."""
        decided = results.where("method = 'HUMAN_REVIEW' AND label IS NOT NULL AND label != 'altro'").select("session_id", "label")
        n, kinds = decided.count(), decided.select("label").distinct().count()
        if n == 0 or n % every or kinds < 2:
            return None
        return fit_voters(decided.join(sessions.select("session_id", F.col("full_text").alias("text")), "session_id"))

    def predict(self, model, sessions: DataFrame) -> DataFrame:
        """(session_id, label, confidence) by the voters."""
        return soft_vote(model, sessions.select("session_id", F.col("full_text").alias("text")), ["session_id"])
