"""Column functions on probabilities, vectors, JSON and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["affinity", "bhattacharyya", "cache_key", "clamp", "conflict_severity", "cosine", "dot", "entropy", "euclidean", "norm", "normalised_entropy", "repair_json", "to_unit_sum"]


def entropy(probabilities: Column) -> Column:
    """Shannon entropy in bits of an array of probabilities; zeros add nothing."""
    return F.aggregate(F.filter(probabilities, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def normalised_entropy(probabilities: Column) -> Column:
    """Entropy over its maximum for so many classes, zeros included; 0 for a single class."""
    total = F.aggregate(F.filter(probabilities, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p + 1e-10))
    return F.when(F.size(probabilities) > 1, total / F.log2(F.size(probabilities).cast("double"))).otherwise(0.0)


def conflict_severity(probabilities: Column) -> Column:
    """0 to 1: mixed labels, a weak best label, and many labels, weighed .4, .4 and .2."""
    n = F.size(probabilities)
    spread = F.least(entropy(probabilities) / F.log2(F.greatest(n, F.lit(2)).cast("double")), F.lit(1.0))
    return F.least(F.lit(1.0), spread * 0.4 + (1 - F.array_max(probabilities)) * 0.4 + F.least((n - 1) / 3, F.lit(1.0)) * 0.2)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` within bounds."""
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two points."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def affinity(distance: Column, radius: Column) -> Column:
    """How near a point is to a region: 1 at its centre, .1 at least; .1 for a region without extent."""
    return F.when(radius > 0, F.greatest(F.lit(0.1), 1 - distance / (2 * radius))).otherwise(0.1)


def bhattacharyya(p: Column, q: Column) -> Column:
    """Overlap of two distributions, as maps from label to probability."""
    shared = F.array_intersect(F.map_keys(p), F.map_keys(q))
    return F.aggregate(shared, F.lit(0.0), lambda acc, k: acc + F.sqrt(F.element_at(p, k) * F.element_at(q, k)))


def to_unit_sum(m: Column) -> Column:
    """A map of weights with sum 1; unchanged where all are zero."""
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, F.transform_values(m, lambda _, v: v / total)).otherwise(m)


def repair_json(raw: Column) -> Column:
    """A response as valid JSON: itself, the first flat object in it, or one with keys quoted, values quoted or a last comma dropped; else null."""
    text = F.trim(raw)
    candidates = [
        text,
        F.regexp_extract(text, r"(\{[^{}]*\})", 1),
        F.regexp_replace(text, r"(\w+):", '"$1":'),
        F.regexp_replace(text, r':\s*([^",\{\}\[\]]+)(\s*[,\}])', ': "$1"$2'),
        F.regexp_replace(text, r",\s*\}", "}"),
    ]
    return F.coalesce(*(F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in candidates))


def cache_key(*parts: Column) -> Column:
    """The md5 of the parts joined by a bar."""
    return F.md5(F.concat_ws("|", *parts))
