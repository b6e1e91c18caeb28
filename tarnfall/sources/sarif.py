"""SARIF logs as one row per result, each with its rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PROPS = "struct<tags: array<string>, cwe: variant, `security-severity`: variant, severity: string, precision: string>"
_TEXT = "struct<text: string>"
SCHEMA = (
    "struct<runs: array<struct<"
    f"tool: struct<driver: struct<name: string, version: string, rules: array<struct<id: string, name: string, shortDescription: {_TEXT}, fullDescription: {_TEXT}, "
    f"defaultConfiguration: struct<level: string>, properties: {_PROPS}, relationships: array<struct<target: struct<id: string>>>>>>>, "
    f"results: array<struct<ruleId: string, ruleIndex: int, level: string, message: {_TEXT}, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int, snippet: struct<text: string>>>>>, "
    f"properties: {_PROPS}>>>>>"
)


def read_logs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """engine, log (the JSON text) of a SARIF file per engine; engines without a file have no row: they did not run."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = {e: p for e, p in paths.items() if hadoop(p).getFileSystem(conf).exists(hadoop(p))}
    out = spark.createDataFrame([], "engine string, log string")
    for engine, path in there.items():
        out = out.unionByName(spark.read.text(path, wholetext=True).select(F.lit(engine).alias("engine"), F.col("value").alias("log")))
    return out


def versions(logs: DataFrame) -> DataFrame:
    """engine, version: the version that each log's first driver with one tells; a row for each log of an engine."""
    runs = F.from_json("log", "struct<runs: array<struct<tool: struct<driver: struct<version: string>>>>>")["runs"]
    told = F.filter(F.transform(runs, lambda r: r["tool"]["driver"]["version"]), lambda v: F.coalesce(v, F.lit("")) != "")
    return logs.select("engine", F.get(told, F.lit(0)).alias("version"))


def _words(value: Column) -> Column:
    """A field that holds a string or an array of strings, as one text. The array is tried first: asked for a string, an array gives its JSON."""
    return F.coalesce(F.concat_ws(" ", F.try_variant_get(value, "$", "array<string>")), F.try_variant_get(value, "$", "string"))


def _cwe(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.concat_ws(" ", F.try_variant_get(value, "$", "array<string>"))).otherwise(F.try_variant_get(value, "$", "string"))


def results(logs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """engine, the carried columns and the flat fields of each result, with those of its rule: found by id, else by index, else null.

    A log that is no JSON has no results.
    """
    parsed = logs.select("engine", *carry, F.from_json("log", SCHEMA).alias("log"))
    runs = parsed.select("engine", *carry, F.explode("log.runs").alias("run"))
    each = runs.select("engine", *carry, F.coalesce("run.tool.driver.rules", F.array()).alias("rules"), F.explode("run.results").alias("r"))
    by_id = F.get(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), F.lit(0))
    by_index = F.when(F.col("r.ruleIndex") >= 0, F.get("rules", F.col("r.ruleIndex")))
    each = each.select("engine", *carry, "r", F.coalesce(by_id, by_index).alias("rule"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    score = lambda p: F.try_variant_get(p, "$", "string")
    return each.select(
        "engine", *carry,
        F.coalesce("r.ruleId", "rule.id", F.lit("unknown")).alias("raw_rule"),
        F.col("rule.name").alias("rule_name"),
        F.col("rule.properties.tags").alias("rule_tags"),
        F.col("r.properties.tags").alias("result_tags"),
        F.array(_cwe(F.col("r.properties.cwe")), _cwe(F.col("rule.properties.cwe"))).alias("cwe_texts"),
        F.col("rule.shortDescription.text").alias("short_text"),
        F.col("rule.fullDescription.text").alias("full_text"),
        F.concat_ws(" ", F.transform("rule.relationships", lambda x: x["target"]["id"])).alias("related"),
        F.coalesce("r.level", "rule.defaultConfiguration.level").alias("level"),
        F.coalesce(score(F.col("rule.properties.security-severity")), score(F.col("r.properties.security-severity"))).alias("score"),
        F.coalesce("rule.properties.severity", "r.properties.severity").alias("severity_word"),
        F.col("rule.properties.precision").alias("precision"),
        F.col("r.message.text").alias("message_text"),
        place["artifactLocation"]["uri"].alias("uri"),
        F.coalesce(place["region"]["startLine"], F.lit(0)).alias("start_line"),
        F.coalesce(place["region"]["endLine"], place["region"]["startLine"], F.lit(0)).alias("end_line"),
        F.coalesce(place["region"]["snippet"]["text"], F.lit("")).alias("snippet"),
    )
