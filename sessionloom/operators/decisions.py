"""Ensemble votes, the quality gate and the review workflow, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["Gate", "combine", "disagreement", "final_decision", "gate_reasons", "pipeline_review"]


@dataclass(frozen=True)
class Gate:
    """Thresholds of the gate; tests are strict."""

    confidence: float = 0.7
    disagreement: float = 0.3
    uncertainty: float = 0.5
    novelty: float = 0.8


def combine(llm_label: Column, llm_conf: Column, ml_label: Column, ml_conf: Column, llm_weight: float = 0.6, ml_weight: float = 0.4) -> Column:
    """(label, confidence, method) of two predictions.

    A side with confidence over .9 weighs 1.2 times as much. Agreeing sides
    give their weighted mean; of disagreeing ones the one with more weighted
    confidence wins (a tie goes to the ML side), at .8 of its confidence. A
    single side stands for itself; without any the label is null.
    """
    boost = lambda w, c: F.when(c > 0.9, w * 1.2).otherwise(w)
    a, b = boost(llm_weight, llm_conf), boost(ml_weight, ml_conf)
    wa, wb = a / (a + b), b / (a + b)
    agree = llm_label == ml_label
    out = lambda label, c, m: F.struct(label.alias("label"), c.alias("confidence"), F.lit(m).alias("method"))
    llm_wins = wa * llm_conf > wb * ml_conf
    return (
        F.when(llm_label.isNull() & ml_label.isNull(), out(F.lit(None).cast("string"), F.lit(None).cast("double"), "ERROR"))
        .when(ml_label.isNull(), out(llm_label, llm_conf, "LLM_ONLY"))
        .when(llm_label.isNull(), out(ml_label, ml_conf, "ML_ONLY"))
        .when(agree, out(llm_label, wa * llm_conf + wb * ml_conf, "AGREEMENT"))
        .when(llm_wins, out(llm_label, llm_conf * 0.8, "DISAGREEMENT_LLM"))
        .otherwise(out(ml_label, ml_conf * 0.8, "DISAGREEMENT_ML"))
    )


def disagreement(llm_label: Column, ml_label: Column, probabilities: Column) -> Column:
    """1 if the labels differ, else what the ML side's probabilities (a map) withhold from the LLM's label; 0 if a side is missing."""
    p = F.element_at(probabilities, llm_label)
    return F.coalesce(F.greatest((llm_label != ml_label).cast("double"), F.coalesce(1 - p, F.lit(0.0))), F.lit(0.0))


def gate_reasons(confidence: Column, disagreement: Column, uncertainty: Column, novelty: Column, gate: Gate = Gate()) -> Column:
    """Why a case needs review, joined by ``; ``; empty if it doesn't."""
    tests = [(confidence < gate.confidence, "low confidence"), (disagreement > gate.disagreement, "disagreement"), (uncertainty > gate.uncertainty, "uncertainty"), (novelty > gate.novelty, "novelty")]
    return F.array_join(F.array_compact(F.array(*(F.when(t, name) for t, name in tests))), "; ")


def final_decision(needs_review: Column, llm_label: Column, llm_conf: Column, ml_label: Column, ml_conf: Column) -> Column:
    """(label, confidence): the surer side; under review with the lower confidence and ties to the LLM, else ties to the ML side."""
    to_llm = F.when(needs_review, llm_conf >= ml_conf).otherwise(llm_conf > ml_conf)
    label = F.when(ml_label.isNull() | to_llm, llm_label).otherwise(ml_label)
    both = F.when(needs_review, F.least(ml_conf, llm_conf)).otherwise(F.greatest(ml_conf, llm_conf))
    return F.struct(label.alias("label"), both.alias("confidence"))


def pipeline_review(disagree: Column, score: Column, confidence: Column) -> Column:
    """The pipeline's own rule: disagreement over .3, or confidence under .7; the reason as text, null if none."""
    return F.when(disagree & (score > 0.3), F.format_string("disagreement %.2f", score)).when(confidence < 0.7, F.format_string("confidence %.2f", confidence))
