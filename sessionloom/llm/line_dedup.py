"""Line dedup by distinct-site spread, by DataFrame functions only.

A line that stands on many sites is boilerplate, however often one site repeats
it. Sketches of the sites (HyperLogLog) are built for each line hash and merged
by aggregation; lines whose estimate is near the threshold get an exact count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, likely_in, saved

__all__ = ["dedup_lines", "line_key", "spread_lines"]

#: Size parameter of the sketches; their relative error is about 1.04 / sqrt(2 ** SKETCH_K).
SKETCH_K = 9
#: Estimates within this share of the threshold are replaced by exact counts: four standard errors.
NEAR = 4 * 1.04 / 2 ** (SKETCH_K / 2)


def line_key(line: Column) -> Column:
    """What makes two lines the same: their letters in lower case, with white space folded; blank lines have a null."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, pos, site, a, b): one row for each line that isn't blank; site is a hash, a and b are two unrelated ones of its key."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(site_col).isNull(), site_col).alias("site"), F.split(text_col, "\n").alias("lines"))
    keys = texts.select("id", "site", F.posexplode("lines").alias("pos", "line")).select("id", "site", "pos", line_key(F.col("line")).alias("key")).where("key != ''")
    return keys.select("id", "site", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), F.col("key")).alias("b"))


def spread_lines(lines: DataFrame, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """The rows of all lines that stand on ``min_sites`` sites or more, and (a, b, first) with each such line's first (id, pos).

    Lines of one site are set aside by comparing the least and the greatest
    site; only the others, a small part of all rows, go on to be sketched.
    Every step is an aggregation with partial sums, so a line of any frequency
    stays small.
    """
    spread = lines.groupBy("a", "b").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count("*").alias("n"))
    several = saved(spread.where(F.col("n") >= min_sites).where("low != high").select("a", "b"), "repeated-lines")
    rows = saved(lines.join(several, ["a", "b"], "left_semi"), "repeated-rows")
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_K)))
    estimated = saved(rows.groupBy("a", "b").agg(sketch.alias("sites")), "line-sketches")
    sure = estimated.where(F.col("sites") > min_sites * (1 + NEAR)).select("a", "b")
    near = saved(estimated.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("a", "b"), "near-lines")
    pairs = rows.join(near, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("a", "b")
    chosen = saved(sure.unionAll(counted), "boilerplate")
    found = rows.join(chosen, ["a", "b"], "left_semi")
    return found, saved(found.groupBy("a", "b").agg(F.min(F.struct("id", "pos")).alias("first")), "first-lines")


def dedup_lines(docs: DataFrame, min_sites: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the texts, and ``lines_removed`` (int).

    A line is boilerplate if it stands on ``min_sites`` different sites or
    more; a null site is a site of its own. Lines are compared without regard
    to case and white space. The first occurrence (by id, then position) of a
    line stays, all others go, so no content is lost. Blank lines stay, and so
    do null and empty texts. Rows of one id are taken as one document: what
    goes from one goes from all. Documents with a null id keep their texts.
    Texts of any length are read whole. A column ``lines_removed`` is replaced,
    other columns are kept, whatever their names. An empty table stays empty.
    """
    lines = saved(_lines(docs, id_col, text_col, site_col), "lines")
    rows, first = spread_lines(lines, min_sites)
    met = rows.where("id is not null").join(first, ["a", "b"]).where((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")) | F.col("first.id").isNull())
    key, marks = free(docs, "_id"), free(docs, "_gone")
    gone = saved(met.groupBy(F.col("id").alias(key)).agg(F.collect_set("pos").alias(marks)), "gone-lines")
    others = [c for c in docs.columns if c != "lines_removed"]
    # texts that certainly keep all lines stay where they are
    changes = likely_in(gone, key, F.col(id_col))
    # lists of positions are small as files and large in memory, so they are not to be broadcast by their size on disk
    joined = docs.where(changes).select(*others).join(gone.hint("merge"), F.col(id_col) == F.col(key), "left")
    text = F.when(F.col(marks).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(marks)))
    changed = joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in others), F.coalesce(F.size(marks), F.lit(0)).alias("lines_removed"))
    return docs.where(~changes).select(*others, F.lit(0).alias("lines_removed")).unionAll(changed)


def _without(text: Column, gone: Column) -> Column:
    """A text without some of its lines (numbers from 0), in linear time: the lines are split once, and the others looked up."""

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), rest), F.lit(0))
