"""Queries of registries: tools, parameters, prompt reads and variables, models, and the tuning of all parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.plans.models import ml10, ml11
from sessionloom.plans.oracle import FACTS, TAGS, with_
from sessionloom.plans.registry import ORACLES, query
from sessionloom.sources import merge as M
from sessionloom.sources.catalog import table, tags

c = F.col

#: Tools of tenants, by fixed arithmetic on the supplier rows, in SQL that Spark and DuckDB share.
TOOL_COLUMNS = {
    "tool_id": "CAST(s_suppkey AS BIGINT)",
    "tenant_id": "CAST(s_nationkey % 5 AS BIGINT)",
    "tool_name": "lower(s_name)",
    "description": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'tool ' || CAST(s_suppkey AS STRING) END",
    "is_active": "s_acctbal > 0",
}
TOOLS = "tools AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TOOL_COLUMNS.items()) + " FROM supplier)"


def tools(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in TOOL_COLUMNS.items()))


@query("API10_tool_upsert", with_(TOOLS) + "SELECT coalesce(t.tool_id, n.tool_id) AS tool_id, coalesce(t.tenant_id, n.tenant_id) AS tenant_id, coalesce(n.tool_name, t.tool_name) AS tool_name, coalesce(n.description, t.description) AS description, coalesce(n.is_active, t.is_active) AS is_active FROM (SELECT * FROM tools WHERE tool_id % 4 <> 0) t FULL JOIN (SELECT tool_id, tenant_id, upper(tool_name) AS tool_name, 'changed' AS description, TRUE AS is_active FROM tools WHERE tool_id % 2 = 0) n USING (tool_id)")
def api10_upsert(spark, d):
    batch = tools(spark, d).where("tool_id % 2 = 0").select("tool_id", "tenant_id", F.upper("tool_name").alias("tool_name"), F.lit("changed").alias("description"), F.lit(True).alias("is_active"))
    return M.upsert(tools(spark, d).where("tool_id % 4 <> 0"), batch, ["tool_id"], keep=("tenant_id",))


@query("API10_tool_soft_delete", with_(TOOLS) + "SELECT tool_id, tenant_id, is_active AND tool_id % 3 <> 0 AS is_active FROM tools")
def api10_delete(spark, d):
    # a deleted tool stays, inactive, so that what refers to it can be read
    gone = tools(spark, d).where("tool_id % 3 = 0").select("tool_id", F.lit(False).alias("is_active"))
    return M.upsert(tools(spark, d).select("tool_id", "tenant_id", "is_active"), gone, ["tool_id"])


@query("API10_tool_statistics", with_(TOOLS) + "SELECT tenant_id, count(*) AS n, count(*) FILTER (is_active) AS active, count(description) AS described FROM tools GROUP BY tenant_id")
def api10_statistics(spark, d):
    return tools(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count("description").alias("described"))


@query("API10_tool_export", with_(TOOLS) + """SELECT tool_id, '{"tool_id":' || CAST(tool_id AS STRING) || ',"tool_name":"' || tool_name || '"' || coalesce(',"description":"' || description || '"', '') || '}' AS line FROM tools WHERE is_active""")
def api10_export(spark, d):
    return tools(spark, d).where("is_active").select("tool_id", F.to_json(F.struct("tool_id", "tool_name", "description")).alias("line"))


#: Clustering parameters and their defaults.
DEFAULTS = {"min_cluster_size": 5.0, "min_samples": 3.0, "quantile": 0.8}
_DEFAULTS = "(VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in DEFAULTS.items()) + ") AS p(name, value)"
OVERRIDES = "overrides AS (SELECT tag_id % 5 AS tenant_id, CASE tag_id % 3 WHEN 0 THEN 'min_cluster_size' WHEN 1 THEN 'min_samples' ELSE 'quantile' END AS name, CAST(max(tag_id) AS DOUBLE) / 10 AS value FROM tags GROUP BY 1, 2)"


def effective(tenant_ids: DataFrame, overrides: DataFrame) -> DataFrame:
    """(tenant_id, name, value) of all parameters: what a tenant has set, else the default."""
    defaults = tenant_ids.select("tenant_id", F.explode(F.create_map(*(F.lit(x) for kv in DEFAULTS.items() for x in kv))).alias("name", "value"))
    return M.upsert(defaults, overrides, ["tenant_id", "name"])


@query("API8_parameters", with_(TAGS, OVERRIDES) + f"SELECT t.tenant_id, p.name, CASE WHEN t.tenant_id = 2 THEN p.value ELSE coalesce(o.value, p.value) END AS value FROM (SELECT DISTINCT tenant_id FROM tags) t CROSS JOIN {_DEFAULTS} LEFT JOIN overrides o ON o.tenant_id = t.tenant_id AND o.name = p.name")
def api8(spark, d):
    """All tenants' parameters after tenant 2 has reset its own."""
    name = F.when(c("tag_id") % 3 == 0, "min_cluster_size").when(c("tag_id") % 3 == 1, "min_samples").otherwise("quantile")
    overrides = tags(spark, d).groupBy((c("tag_id") % 5).alias("tenant_id"), name.alias("name")).agg((F.max("tag_id").cast("double") / 10).alias("value"))
    left, _ = M.delete_where(overrides, c("tenant_id") == 2)
    return effective(tags(spark, d).select("tenant_id").distinct(), left)


def strict(found: DataFrame, asked: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows of ``found`` for each key asked for; the query fails where there is none."""
    joined = asked.join(found.withColumn("_there", F.lit(True)), keys, "left")
    missing = F.concat(F.lit(f"no {what} for "), F.concat_ws(", ", *(c(k).cast("string") for k in keys)))
    checked = F.when(c("_there"), c("_there")).otherwise(F.raise_error(missing).cast("boolean"))
    return joined.where(checked).drop("_there")


@query("Z37_strict_prompt", with_(TAGS) + "SELECT tenant_id, tag_name, tag_description FROM tags WHERE tag_id % 4 <> 0 AND tag_id % 3 = 0")
def z37(spark, d):
    prompts = tags(spark, d).where("tag_description IS NOT NULL").select("tenant_id", "tag_name", "tag_description")
    asked = tags(spark, d).where("tag_id % 4 <> 0 AND tag_id % 3 = 0").select("tenant_id", "tag_name")
    return strict(prompts, asked, ["tenant_id", "tag_name"], "prompt")


#: Named sources of prompt variables: parameterised SQL over the facts; no stored SQL text is run.
SOURCES = {
    "labels_of_tenant": "SELECT array_join(array_sort(collect_set(label)), '|') AS value FROM {facts} WHERE tenant_id = :tenant_id AND label <> ''",
    "reviews_of_tenant": "SELECT CAST(count(*) AS STRING) AS value FROM {facts} WHERE tenant_id = :tenant_id AND review_status = 'pending'",
}


def variables(spark: SparkSession, facts_: DataFrame, parameters: dict, config: dict[str, str]) -> dict[str, str]:
    """Values of a prompt's variables: from named queries, from the call's parameters, and from the configuration, later ones first."""
    found = {name: spark.sql(sql, args=parameters, facts=facts_).first()["value"] for name, sql in SOURCES.items()}
    return {**config, **{k: str(v) for k, v in parameters.items()}, **found}


@query("UDF2_variable_sources", with_(FACTS) + "SELECT (SELECT string_agg(DISTINCT label, '|' ORDER BY label) FROM facts WHERE tenant_id = 3 AND label <> '') || ' for 3 in it, ' || (SELECT CAST(count(*) AS VARCHAR) FROM facts WHERE tenant_id = 3 AND review_status = 'pending') || ' open {{unknown}}' AS prompt")
def udf2(spark, d):
    from sessionloom.sources.catalog import facts

    values = variables(spark, facts(spark, d), {"tenant_id": 3}, {"language": "it", "tenant_id": "overridden"})
    text = F.lit("{{labels_of_tenant}} for {{tenant_id}} in {{language}}, {{reviews_of_tenant}} open {{unknown}}")
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    return spark.range(1).select(text.alias("prompt"))


#: Fine-tuned models of tenants: one row for each version, by fixed arithmetic on the nation rows.
MODELS = "models AS (SELECT CAST(n_regionkey AS BIGINT) AS tenant_id, CAST(n_nationkey AS BIGINT) AS version, 'model-' || CAST(n_nationkey AS STRING) AS path, n_nationkey * 7 % 10 AS score FROM nation)"


def models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr("CAST(n_regionkey AS BIGINT) AS tenant_id", "CAST(n_nationkey AS BIGINT) AS version", "'model-' || CAST(n_nationkey AS STRING) AS path", "n_nationkey * 7 % 10 AS score")


@query("Z31_model_registry", with_(MODELS) + "SELECT tenant_id, count(*) AS versions, max(version) AS current, arg_max(path, version) AS path, max(score) AS best FROM models GROUP BY tenant_id")
def z31(spark, d):
    return models(spark, d).groupBy("tenant_id").agg(F.count("*").alias("versions"), F.max("version").alias("current"), F.max_by("path", "version").alias("path"), F.max("score").alias("best"))


@query("ML16_rollback", with_(MODELS) + "SELECT tenant_id, version, path FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY version DESC) AS rn FROM models) WHERE rn = 2")
def ml16(spark, d):
    """The version before the current one is the current one again."""
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("version"))
    return models(spark, d).withColumn("rn", F.row_number().over(newest)).where("rn = 2").select("tenant_id", "version", "path")


_ML10, _ML11 = (ORACLES[n] for n in ("ML10_threshold_search", "ML11_weight_search"))


@query("Z34_tune_all", f"""WITH t AS ({_ML10}), w AS ({_ML11}),
found AS (SELECT 'threshold' AS parameter, .7 AS old, min(threshold) FILTER (accuracy = (SELECT max(accuracy) FROM t)) AS best, max(accuracy) FILTER (threshold = .7) AS old_score, max(accuracy) AS score FROM t
UNION ALL SELECT 'weight', .6, min(weight) FILTER (accuracy = (SELECT max(accuracy) FROM w)), max(accuracy) FILTER (weight = .6), max(accuracy) FROM w)
SELECT parameter, CAST(old AS DOUBLE) AS old, CAST(best AS DOUBLE) AS best, round(score - old_score, 4) AS gain, round(sum(score - old_score) OVER (), 4) AS total_gain FROM found""")
def z34(spark, d):
    """Every parameter's best value on its grid, ties to the least, its gain over the present value, and the gain of all."""

    def best(found: DataFrame, name: str, column: str, old: float) -> DataFrame:
        top = F.max_by(column, F.struct("accuracy", -c(column)))
        row = found.where("accuracy IS NOT NULL").agg(top.alias("best"), F.max("accuracy").alias("score"), F.max(F.when(c(column) == old, c("accuracy"))).alias("old_score"))
        return row.select(F.lit(name).alias("parameter"), F.lit(old).alias("old"), c("best").cast("double").alias("best"), (c("score") - c("old_score")).alias("g"))

    rows = best(ml10(spark, d), "threshold", "threshold", 0.7).unionAll(best(ml11(spark, d), "weight", "weight", 0.6))
    total = F.sum("g").over(Window.partitionBy())  # one row for each parameter
    return rows.select("parameter", "old", "best", F.round("g", 4).alias("gain"), F.round(total, 4).alias("total_gain"))


@query("API7_retrain_and_swap")
def api7(spark, d):
    """Voters fitted on more rows take the present ones' place, in a folder of their own, only if they are as good on rows that neither has seen."""
    from pyspark.ml import PipelineModel

    from sessionloom.operators.models import fit_voters, soft_vote
    from sessionloom.sources.shared import fresh_path

    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", c("role").alias("label"))
    held = rows.where("conv_id % 4 = 0")
    accuracy = lambda model: soft_vote(model, held, ["conv_id", "turn", "label"]).toDF("conv_id", "turn", "truth", "label", "p").agg(F.avg((c("truth") == c("label")).cast("double"))).first()[0]
    now, new = fit_voters(rows.where("conv_id % 4 = 1"), features=64), fit_voters(rows.where("conv_id % 4 <> 0"), features=64)
    before, after = accuracy(now), accuracy(new)
    path = fresh_path(spark, "model")
    (new if after >= before else now).write().overwrite().save(path)
    return soft_vote(PipelineModel.load(path), held, ["conv_id", "turn"]).select("conv_id", "turn", "label", F.lit(after >= before).alias("swapped"))


@query("SRC10_saved_topics")
def src10(spark, d):
    """The topics by a model that was saved and loaded, which are those of the model itself."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from sessionloom.operators.models import topics
    from sessionloom.sources.shared import fresh_path

    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    path = fresh_path(spark, "topics")
    topics(rows, k=4).write().overwrite().save(path)
    p = vector_to_array("topic_probabilities")
    return PipelineModel.load(path).transform(rows).select("conv_id", "turn", (F.array_position(p, F.array_max(p)) - 1).alias("topic"))
