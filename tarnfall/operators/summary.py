"""Counts over findings, suppression channels, coverage and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.model import SEVERITY_PENALTY, SEVERITY_RANK, lookup


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: findings of each severity and in all."""
    return findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK), F.count("*").alias("total"))


def engine_counts(raw: DataFrame) -> DataFrame:
    """Findings of each engine as it reported them: before routing and merging."""
    return raw.groupBy("engine").agg(F.count("*").alias("finding_count"))


def posture_score(findings: DataFrame, *by: str) -> DataFrame:
    """100 less a penalty for each finding, 0 at least: one row, or one for each group. A view of its own, never a share of compliance."""
    penalty = F.coalesce(F.sum(lookup(F.col("severity"), SEVERITY_PENALTY, 0)), F.lit(0))
    return findings.groupBy(*by).agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("int").alias("posture_score"))


def suppression(files: DataFrame) -> DataFrame:
    """channel, count, paths, handling of what tells the secrets engine to look away.

    files: rel, content. Comments are counted and ignored, as is a configuration of the target; an ignore file is obeyed
    by the engine, so coverage is unverified.
    """
    root = files.where(F.col("rel").isin(".gitleaks.toml", ".gitleaksignore"))
    named = root.select(F.when(F.col("rel") == ".gitleaks.toml", "target_config").otherwise("gitleaks_ignore").alias("channel"), F.lit(1).cast("long").alias("count"), F.array("rel").alias("paths"))
    inline = files.select("rel", F.size(F.regexp_extract_all("content", F.lit(r"gitleaks:allow(?![A-Za-z0-9_])"), F.lit(0))).cast("long").alias("n")).where("n > 0")
    comments = inline.agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("rel")).alias("paths")).where("count > 0").select(F.lit("inline_allow").alias("channel"), "count", "paths")
    handling = F.when(F.col("channel") == "gitleaks_ignore", "coverage_unverified").otherwise("ignored")
    return named.unionByName(comments).withColumn("handling", handling)


def secret_coverage(ran: Column, channels: Column) -> Column:
    """verified, unverified, or null where the secrets engine was not asked (``ran`` is null)."""
    return F.when(ran.isNotNull(), F.when(ran & ~F.array_contains(channels, "gitleaks_ignore"), "verified").otherwise("unverified"))


def vulnerability_db_advice(ran: Column, signatures: Column) -> Column:
    """``unrecorded`` if a vulnerability scan ran without a recorded signature of its database."""
    return F.when(ran & ~F.coalesce(F.map_contains_key(signatures, "trivy:vulnerability-db"), F.lit(False)), "unrecorded")


def engine_labels(details: Column) -> Column:
    """engine@version of the engines that ran."""
    return F.transform(F.filter(details, lambda d: d["ran"]), lambda d: F.concat_ws("@", d["engine"], d["version"]))


def sbom_components(documents: DataFrame) -> DataFrame:
    """rel, components: number of components (CycloneDX) or packages (SPDX) of each SBOM in ``content``; 0 if it has neither."""
    parsed = F.from_json("content", "components array<variant>, packages array<variant>")
    return documents.select("rel", F.coalesce(F.size(F.coalesce(parsed["components"], parsed["packages"], F.array())), F.lit(0)).alias("components"))
