"""URL filters by a path-template tree, by DataFrame functions only.

Each host has a tree of its paths' segments. Going down, segments that vary
(runs of digits, rare values) become wildcards, and sibling branches whose
labelled outcomes don't differ significantly from each other are merged. The
labels are the outcomes of explicit rules. The tree goes down as far as labels
still differ within a branch. A template is rejected if its share of blocked
labels, smoothed towards its parent's, is too high; templates without labels
take their parent's share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

__all__ = ["host_of", "judge_urls", "path_of", "rule_of"]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for a null."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for a null."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host/path) that fits, as its host/path; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    found = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, slash, start = rule.partition("/")
        found.append(F.when(((host == site) | host.endswith("." + site)) & path.startswith(slash + start), F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _segments(path: Column) -> Column:
    """The path's segments, runs of digits as wildcards."""
    return F.filter(F.split(F.regexp_replace(path, r"\d+", "*"), "/"), lambda s: s != "")


def _groups(children: DataFrame, similar: float) -> DataFrame:
    """(node, part, group): the frequent children of each node, in groups of those whose labels don't differ.

    A node has few frequent children. They are put in order by their share of
    blocked labels; where two neighbours differ by ``similar`` standard errors,
    a new group begins. A group is named by its least member and their number.
    """
    order = Window.partitionBy("node").orderBy(F.col("b") / F.col("l"), "part")
    before = lambda c: F.lag(c).over(order)
    pooled = (F.col("b") + before("b")) / (F.col("l") + before("l"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / before("l")))
    apart = F.coalesce(F.abs(F.col("b") / F.col("l") - before("b") / before("l")) > similar * error, F.lit(False)) & (F.coalesce(error, F.lit(0.0)) > 0)
    numbered = children.withColumn("apart", apart.cast("int")).withColumn("nth", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = numbered.groupBy("node", "nth").agg(F.min("part").alias("name"), F.count("*").alias("k"))
    several = numbered.groupBy("node").agg(F.max("nth").alias("top")).where("top > 0").select("node")
    name = F.when(F.col("k") > 1, F.concat(F.lit("{"), "name", F.lit(" +"), (F.col("k") - 1).cast("string"), F.lit("}"))).otherwise(F.col("name"))
    return numbered.join(several, "node", "left_semi").join(sizes, ["node", "nth"]).select("node", "part", name.alias("group"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", least_share: float = 0.02, least_pages: int = 5, similar: float = 1.96, strength: float = 10.0, reject_above: float = 0.8) -> DataFrame:
    """Rows (id, host, path, rule, template, purity, verdict), one for each row of ``pages``.

    ``rule`` is the rule that decided, ``verdict`` its outcome or else that of
    the URL's template: ``block`` if ``purity``, the smoothed share of blocked
    labels, is over ``reject_above``. A segment can stay literal if it holds at
    least ``least_share`` of its parent's pages and ``least_pages``, so a node
    has a bounded number of children, and if it has labels; children whose
    labels don't differ by ``similar`` standard errors are merged, and all
    others are the wildcard's. A branch whose labels are all alike has nothing
    to tell apart below, so it ends there, at any depth. ``strength`` is the
    weight of the parent's share in the smoothing, and of the share over all
    hosts in a host's. Without any label all is allowed. Null and malformed
    URLs have an empty host and path, and are judged as such. Repeated rows are
    counted and judged singly. Other columns, whatever their names, are not
    read. An empty table gives an empty result.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    verdicts = {rule: verdict for verdict, rule in rules}
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", _segments(F.col("path")))
    outcome = reduce(lambda c, r: c.when(F.col("rule") == r[0], F.lit(r[1])), verdicts.items(), F.when(F.lit(False), F.lit("")))
    blocked, labelled = F.count_if(outcome == "block"), F.count_if(F.col("rule").isNotNull())
    branches = saved(ruled.groupBy("host", "segments").agg(F.count("*").alias("n"), blocked.alias("b"), labelled.alias("l")), "branches")
    total = branches.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    everywhere = F.lit(total["b"] / total["l"] if total["l"] else 0.0)

    def judged(rows: DataFrame) -> DataFrame:
        """Rows with their node's smoothed share in ``purity``, and whether its labels differ."""
        sums = rows.groupBy("node").agg(F.sum("b").alias("_b"), F.sum("l").alias("_l"), F.max("above").alias("_p"))
        share = sums.select("node", ((F.col("_b") + strength * F.col("_p")) / (F.col("_l") + strength)).alias("purity"), ((F.col("_b") > 0) & (F.col("_b") < F.col("_l"))).alias("mixed"))
        return saved(rows.drop("above").join(saved(share, "nodes"), "node"), "branches")

    # level by level: a node is a template; rows of nodes whose labels are alike are done
    open_ = judged(branches.select("host", "segments", "n", "b", "l", F.col("host").alias("node"), everywhere.alias("above")))
    done, k = None, 0
    while True:
        over = ~F.col("mixed") | (F.size("segments") < k)
        ended = open_.where(over).select("host", "segments", "node", "purity")
        done = ended if done is None else done.unionAll(ended)
        open_ = open_.where(~over).withColumn("part", F.coalesce(F.get("segments", F.lit(k)), F.lit("")))
        below = open_.groupBy("node").agg(F.sum("n").alias("all_n"), F.max(F.size("segments")).alias("deepest"))
        if below.where(F.col("deepest") > k).isEmpty():
            done = done.unionAll(open_.select("host", "segments", "node", "purity"))
            break
        sums = open_.groupBy("node", "part").agg(*(F.sum(c).alias(c) for c in ("n", "b", "l")))
        frequent = sums.join(below.select("node", "all_n"), "node").where((F.col("l") > 0) & (F.col("n") >= least_pages) & (F.col("n") >= least_share * F.col("all_n")))
        groups = saved(_groups(frequent, similar), "branch-groups")
        # paths that end here are a branch of their own
        group = F.when(F.col("part") == "", F.lit("")).otherwise(F.coalesce("group", F.lit("*")))
        placed = open_.join(groups, ["node", "part"], "left").select("host", "segments", "n", "b", "l", F.when(group == "", F.concat("node", F.lit("/"))).otherwise(F.concat_ws("/", "node", group)).alias("node"), F.col("purity").alias("above"))
        open_ = judged(placed)
        k += 1

    known = saved(done.select("host", "segments", F.rtrim(F.col("node"), F.lit("/")).alias("template"), "purity"), "judged-branches")
    verdict = F.coalesce(outcome, F.when(F.col("purity") > reject_above, "block").otherwise("allow"))
    return ruled.join(known, ["host", "segments"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
