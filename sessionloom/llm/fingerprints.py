"""Document fingerprints: a canonical exact digest, by DataFrame functions only.

Canonical text is composed (NFKC), case-folded, and has its white space folded
to single spaces and trimmed. Its digest is two XXH64 values with unrelated
seeds. Texts that share a digest are compared byte by byte in canonical form;
where they differ they are numbered apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, likely_in, saved

__all__ = ["canonical", "digest", "fingerprints", "with_next"]

#: ``with_next`` orders rows in ranges of about so many characters; the fewest and the most ranges.
RANGE_CHARS, FEWEST_RANGES, MOST_RANGES = 8_000_000, 64, 16_384


def canonical(text: Column) -> Column:
    """A text in canonical form; a null counts as an empty text.

    Composition and case folding are ICU's, which Spark ships; ASCII texts need neither.
    """
    text = F.coalesce(text, F.lit(""))
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    # folding can take a text out of composed form
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(compose(folded))
    return F.trim(F.regexp_replace(plain, r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))


def digest(canonical_text: Column, bits: int = 128) -> Column:
    """The digest of a canonical text as hex; fewer ``bits`` (for tests of collisions) keep the last digits."""
    halves = (F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical_text))), 16, "0") for seed in ("sessionloom", "fingerprint"))
    return F.right(F.concat(*halves), F.lit(bits // 4))


def fingerprints(docs: DataFrame, texts: dict[str, str], keep: list[str], id_col: str = "doc_id", rebuild: Callable[[DataFrame], DataFrame] | None = None, bits: int = 128) -> DataFrame:
    """Columns ``keep`` of ``docs``, and for each text column of ``texts`` (name: output) its fingerprint.

    Two texts, of one column or of two, have equal fingerprints if and only if
    their canonical forms are equal; null and empty texts are equal, and a row
    with a null id is not compared. Only texts that share a digest are
    compared: ``rebuild`` gets the saved table of digests (``keep``, ``id_col``
    and ``shares``, true for rows with such a text) and returns the rows with
    their texts; by default they are looked up in ``docs``. Copies are brought
    together before they move, so a group of any size stays small. Texts of any
    length are read whole, other columns not at all; repeated rows give repeated
    results, and an empty table an empty one.
    """
    names = [f"_{k}" for k in range(len(texts))]
    kept = list(dict.fromkeys([id_col, *keep]))
    # canonical forms have a projection of their own, so that each is made once
    canons = docs.select(*kept, *(canonical(F.col(t)).alias(n) for t, n in zip(texts, names, strict=True)))
    marked = saved(canons.select(*kept, *(digest(F.col(n), bits).alias(n) for n in names)), "digests")
    pairs = marked.select(id_col, F.explode(F.array(*names)).alias("digest"))
    shared = saved(pairs.groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    members = saved(pairs.join(shared, "digest", "left_semi").select(id_col).where(F.col(id_col).isNotNull()).distinct(), "sharers")
    rows = rebuild(marked.join(members, id_col, "left_semi").select(*kept)) if rebuild else docs.where(likely_in(members, id_col, F.col(id_col))).join(members, id_col, "left_semi")
    canon = rows.select(F.explode(F.array(*(canonical(F.col(t)) for t in texts))).alias("canon")).withColumn("digest", digest(F.col("canon"), bits))
    distinct = canon.join(shared, "digest", "left_semi").groupBy("digest", "canon").count()
    numbered = distinct.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("canon")))
    variants = saved(numbered.where("number > 1").select("digest", "canon", "number"), "digest-variants")
    if variants.isEmpty():
        return marked.select(*keep, *(F.col(n).alias(out) for n, out in zip(names, texts.values(), strict=True)))
    # some digest stands for several texts: all but the first are numbered
    found = docs.select(*keep, *(canonical(F.col(t)).alias(n) for t, n in zip(texts, names, strict=True)))
    for n, out in zip(names, texts.values(), strict=True):
        name = variants.select(F.col("canon").alias(n), F.concat_ws("-", "digest", "number").alias(f"{n}_name"))
        found = found.join(name, n, "left").withColumn(out, F.coalesce(f"{n}_name", digest(F.col(n), bits)))
    return found.select(*keep, *texts.values())


def with_next(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: that of the row that follows by descending id, the first after the last.

    Null ids come last; rows of one id follow each other by text, descending. A
    single row follows itself. The rows are dealt into ranges whose upper ends
    are ids of the table. The first row of a range is also sent to the range
    above, whose last row it follows, so no order over all rows is needed in
    one place.
    """
    size = docs.agg(F.sum(F.length(text_col)).alias("chars"), F.max(id_col).alias("top"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    ranges = min(MOST_RANGES, max(FEWEST_RANGES, (size["chars"] or 0) // RANGE_CHARS))
    at = F.array(*(F.lit((k + 1) / ranges) for k in range(ranges)))
    ends = docs.agg(F.percentile_approx(id_col, at, 20 * ranges)).first()[0] or []
    uppers = sorted({*ends, *([] if size["top"] is None else [size["top"]])})
    # ids are looked up among the upper ends in two steps
    width = max(1, round(len(uppers) ** 0.5))
    groups = [uppers[k : k + width] for k in range(0, len(uppers), width)]
    literal = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<long>")
    key, range_, place = (free(docs, c) for c in ("_id", "_range", "_place"))
    group = F.size(F.filter(literal([g[-1] for g in groups]), lambda u: u < F.col(key)))
    inside = F.size(F.filter(F.element_at(F.array(*map(literal, groups or [[]])), (group + 1)), lambda u: u < F.col(key)))
    nth = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(group * width + inside)
    top, lowest = len(uppers) - 1, -1 if size["nulls"] or not uppers else 0
    first = F.col(key).isNull() | F.col(key).isin(uppers) if len(uppers) < 100 else F.col(key).isNull() | (F.element_at(literal(uppers), F.col(range_) + 1) == F.col(key))
    above = F.when(F.col(range_) == top, F.lit(lowest)).otherwise(F.col(range_) + 1)
    placed = docs.withColumn(key, F.col(id_col)).withColumn(range_, nth)
    places = F.array(F.struct(F.col(range_).alias("range"), F.lit(False).alias("visits")))
    visit = F.array(F.struct(above.alias("range"), F.lit(True).alias("visits")))
    sent = placed.withColumn(place, F.explode(F.when(first, F.concat(places, visit)).otherwise(places)))
    # a task for each range or few, whatever the number of shuffle partitions
    dealt = sent.withColumn(range_, F.col(f"{place}.range")).repartition(int(ranges), range_)
    order = Window.partitionBy(range_).orderBy(f"{place}.visits", F.col(key).desc_nulls_last(), F.col(text_col).desc_nulls_last())
    led = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where(~F.col(f"{place}.visits")).drop(key, range_, place)
