"""Mixing sources to target weights by Pareto order sampling, by DataFrame functions only.

A document is due so many copies: its source's target over its source's size,
times its weight where it has one. The whole copies are certain. For the rest
documents are ranked by their random odds over their inclusion odds, and the
head of the ranking that fills the target is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

__all__ = ["mix", "source_targets", "uniform", "word_count"]

#: Steps of the ranking that are summed up before single documents are ranked.
STEPS = 4096


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space and 09-0D; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number strictly between 0 and 1 that depends on the seed and the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def source_targets(sizes: DataFrame, source_col: str, weights: list[float], share: float, max_copies: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources, by code point with null last, take ``weights`` in turn, and
    together ``share`` of all sizes. No target goes over ``max_copies`` times
    its source's size; what is over goes to the others by weight, until none is
    above. A source that weighs 0 gets 0. There is one row for each source.
    """
    sources = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights)).cast("int") + 1)).withColumn("cap", F.col("source_size") * float(max_copies))
    # sources reach their caps in the order of cap over weight; each level of the water stands if the next isn't reached
    order = Window.orderBy((F.col("cap") / F.nullif("weight", F.lit(0.0))).asc_nulls_last(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * float(share) - capped) / F.nullif(open_weight, F.lit(0.0))
    levels = weighed.withColumn("level", level).withColumn("holds", (F.col("weight") > 0) & (F.col("level") * F.col("weight") <= F.col("cap")))
    first = F.min(F.when(F.col("holds"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)
    target = F.when(F.col("weight") > 0, F.least("cap", F.coalesce(first["level"] * F.col("weight"), F.col("cap")))).otherwise(0.0)
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_copies: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows (``keep``, or id and source; size, source_size, target, copies), one for each row of ``docs``.

    ``size`` is in words; ``copies`` is how often the mix takes the document,
    never over ``max_copies``. Within a source all documents are due equally
    many copies, or in proportion to ``weight_col`` (null or negative: 0). The
    head of the ranking that fits into the target is drawn, and one document
    more if its size fits what is left open. The draw depends on ``seed`` and
    the rows only, so reruns agree. Null and empty texts have size 0 and take
    no words; a null source is a source of its own; repeated rows are drawn
    together. An empty table gives an empty result.

    What is worked out is one row for each source: its rate and the place in
    the ranking up to which documents are drawn. Documents meet that table, by
    a broadcast where it is below Spark's threshold, and are not moved
    otherwise. Columns of the new names are replaced.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    random = uniform(id_col, F.xxhash64(text_col), seed=seed)
    needed = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), weight.alias("w"), random.alias("u")]
    sizes = saved(docs.select(*needed), "sizes")
    targets = saved(source_targets(sizes, "source", weights, share, max_copies), "targets")
    rates = _rates(sizes, targets, max_copies, weight_col is not None)
    plan = _met(targets, rates)
    ranked = _ranked(_met(sizes, plan), max_copies)

    # the step of the ranking in which a source's target is filled, and the words before it
    certain = ranked.groupBy("source").agg((F.first("target", True) - F.sum(F.col("whole") * F.col("size"))).alias("wanted"))
    steps = ranked.where("chance > 0").groupBy("source", "step").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filling = _met(steps.withColumn("before", before), certain).where("before <= wanted").groupBy("source").agg(F.max(F.struct("step", "before", "wanted")).alias("cut"))
    cuts = saved(filling.select("source", F.col("cut.step").alias("cut"), F.col("cut.before").alias("before"), F.col("cut.wanted").alias("wanted")), "cuts")

    # inside that step single documents are ranked; the place of the last that fits is kept
    inside = Window.partitionBy("source").orderBy("place")
    at_cut = _met(ranked, cuts).where("chance > 0 AND step = cut").withColumn("filled", F.col("before") + F.sum("size").over(inside))
    ends = saved(at_cut.where("filled <= wanted").groupBy("source").agg(F.max("place").alias("end")), "ends")
    plan = saved(_met(_met(plan, cuts.select("source", "cut")), ends), "plan")

    # what the head of the ranking leaves open goes to the one document not drawn whose size comes nearest
    drawn = _drawn(_ranked(_met(sizes, plan), max_copies))
    open_ = saved(drawn.groupBy("source").agg((F.first("target", True) - F.sum(F.col("copies") * F.col("size"))).alias("open")), "open")
    fit = F.abs(F.col("size") - F.col("open"))
    rest = _met(drawn.where("not drawn and chance > 0 and size > 0"), open_).where(fit < F.col("open"))
    last = rest.groupBy("source").agg(F.min(F.struct(fit.alias("fit"), "place")).alias("m")).select("source", F.col("m.place").alias("last"))
    plan = saved(_met(plan, last), "plan")

    kept = [id_col, source_col] if keep is None else keep
    made = ["size", "source_size", "target", "copies"]
    rows = sizes.select("*", F.struct(F.col("id").alias(id_col), F.col("source").alias(source_col)).alias("kept")) if keep is None else docs.select(*needed, F.struct(*kept).alias("kept"))
    found = _drawn(_ranked(_met(rows, plan), max_copies))
    closing = F.coalesce(~F.col("drawn") & (F.col("place") == F.col("last")), F.lit(False))
    return found.select(*(F.col(f"kept.{c}") for c in kept if c not in made), "size", "source_size", "target", (F.col("copies") + closing.cast("int")).alias("copies"))


def _met(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table that has one row for each source; null is a source."""
    return rows.join(more.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _rates(sizes: DataFrame, targets: DataFrame, max_copies: int, weighted: bool) -> DataFrame:
    """(source, rate): copies due are rate times weight, up to ``max_copies``; they add up to the target.

    Where weights differ, the rate rises, round by round, by what documents at
    the most copies can't take; nearly always a few rounds are enough.
    """
    mass = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("w")).alias("mass"))
    rates = saved(_met(mass, targets).select("source", (F.col("target") / F.nullif("mass", F.lit(0.0))).alias("rate")), "rates")
    while weighted:
        over = F.col("rate") * F.col("w") >= max_copies
        sums = _met(sizes, rates).groupBy("source").agg(F.sum(F.when(over, F.col("size") * float(max_copies)).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("size") * F.col("w"))).alias("mass"))
        raised = saved(_met(_met(sums, targets), rates.withColumnRenamed("rate", "old")).select("source", F.greatest("old", (F.col("target") - F.col("full")) / F.nullif("mass", F.lit(0.0))).alias("rate"), "old"), "rates")
        rates = raised.select("source", "rate")
        if raised.where("rate > old * (1 + 1e-9)").isEmpty():
            break
    return rates


def _ranked(rows: DataFrame, max_copies: int) -> DataFrame:
    """Rows with their whole copies, the chance of one more, and their place in the ranking: random odds over inclusion odds, brought to 0..1."""
    due = F.least(F.coalesce(F.col("rate") * F.col("w"), F.lit(0.0)), F.lit(float(max_copies)))
    whole = F.floor(due + 1e-9).cast("int")
    sure = rows.withColumn("whole", whole).withColumn("chance", F.greatest(due - F.col("whole"), F.lit(0.0)))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("chance")) / F.nullif("chance", F.lit(0.0))
    rank = F.when(F.col("chance") > 0, odds / (1 + odds)).otherwise(1.0)
    placed = sure.withColumn("place", F.struct(rank.alias("rank"), "id", "size"))
    return placed.withColumn("step", F.least(F.floor(F.col("place.rank") * STEPS), F.lit(STEPS - 1)).cast("int"))


def _drawn(ranked: DataFrame) -> DataFrame:
    """Ranked rows that have met the plan, with ``drawn`` and ``copies``."""
    head = (F.col("step") < F.col("cut")) | ((F.col("step") == F.col("cut")) & F.col("end").isNotNull() & (F.col("place") <= F.col("end")))
    drawn = ranked.withColumn("drawn", F.coalesce((F.col("chance") > 0) & head, F.lit(False)))
    return drawn.withColumn("copies", F.col("whole") + F.col("drawn").cast("int"))
