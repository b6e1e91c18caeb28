"""Findings tagged with controls, and coverage of what code can show of a framework.

The mappings are a fixed table of a few hundred rows, so tags come from a constant map inside the scan's own stage:
no join, and no shuffle to put findings together again.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.sources.controls import FRAMEWORKS, LLM, WEB, bucket_rows, cwe_rows, universe

_PAIRS = "array<struct<framework: string, control: string>>"


def _constant(rows: list[tuple[str, str, str]]) -> Column:
    """A map from key to its (framework, control) pairs; folded to one literal by the optimizer."""
    table = defaultdict(list)
    for key, framework, control in rows:
        table[key].append({"framework": framework, "control": control})
    return F.from_json(F.lit(json.dumps(table)), f"map<string, {_PAIRS}>")


def control_pairs() -> Column:
    """All (framework, control) pairs of a finding: by its weaknesses, and by what its engine and rule id say of it."""
    nothing = F.array().cast(_PAIRS)
    by_cwe = F.flatten(F.transform("cwe", lambda c: F.coalesce(F.try_element_at(_constant(cwe_rows()), c), nothing)))
    buckets = _constant(bucket_rows())
    trivy = F.col("engine") == "trivy"
    dependency = F.when(trivy & F.col("rule_id").rlike("(?i)^(cve-|ghsa-)"), F.try_element_at(buckets, F.lit("vulnerable_component")))
    misconfig = F.when(trivy & F.col("rule_id").rlike("(?i)^(avd-|ds-|ksv|kcv|aws-|gcp-|azu-)"), F.try_element_at(buckets, F.lit("misconfig")))
    return F.array_distinct(F.concat(by_cwe, F.coalesce(dependency, nothing), F.coalesce(misconfig, nothing)))


def _controls(framework: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter("__pairs", lambda p: p["framework"] == framework), lambda p: p["control"])))


def tag(findings: DataFrame) -> DataFrame:
    """Adds ``frameworks`` (those with a control, controls sorted) and unites the two crosswalk columns with their own values."""
    rows = findings.withColumn("__pairs", control_pairs())
    frameworks = F.array(*(F.struct(F.lit(fw).alias("framework"), _controls(fw).alias("controls")) for fw in FRAMEWORKS))
    own = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    crosswalk = lambda column, name: F.nullif(F.array_sort(F.array_union(own(column), _controls(name))), F.array().cast("array<string>"))
    return rows.withColumns({"frameworks": F.filter(frameworks, lambda f: F.size(f["controls"]) > 0), "owasp_web": crosswalk("owasp_web", WEB), "owasp_llm": crosswalk("owasp_llm", LLM)}).drop("__pairs")


def control_rows(tagged: DataFrame) -> DataFrame:
    """framework, control: one row for each finding and control."""
    crosswalk = [F.struct(F.lit(name).alias("framework"), F.coalesce(column, F.array().cast("array<string>")).alias("controls")) for name, column in ((WEB, "owasp_web"), (LLM, "owasp_llm"))]
    each = tagged.select(F.explode(F.concat("frameworks", F.array(*crosswalk))).alias("f"))
    return each.select("f.framework", F.explode("f.controls").alias("control"))


def coverage(tagged: DataFrame, framework: str | None = None) -> DataFrame:
    """framework, control, findings, status (gap or clear) of every control that code can show; an unknown framework has no rows."""
    known = universe(tagged.sparkSession)
    if framework is not None:
        known = known.where(F.col("framework") == framework)
    counts = control_rows(tagged).groupBy("framework", "control").agg(F.count("*").alias("findings"))
    out = known.join(counts, ["framework", "control"], "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("findings") > 0, "gap").otherwise("clear"))


def overview(tagged: DataFrame) -> DataFrame:
    """framework, code_visible_controls, controls_with_findings."""
    return coverage(tagged).groupBy("framework").agg(F.count("*").alias("code_visible_controls"), F.count_if(F.col("findings") > 0).alias("controls_with_findings"))
