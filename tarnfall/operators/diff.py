"""Scans compared over time: a finding is resolved only where that can be proven.

Prior and fresh findings carry ``target``; ``context`` has one row for each target: ``captured`` (the prior scan kept its
configuration), ``truncated`` (either scan was cut), ``ran`` (engines of the fresh scan), and both scans' component
signatures. "By fingerprint or by dedup key" is two joins on one key each, as an OR would compare every pair of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.model import SEVERITY_RANK, severity_rank
from tarnfall.operators.dedup import dedup_key

CONTEXT = "target string, captured boolean, truncated boolean, ran array<string>, prior_signatures map<string, string>, fresh_signatures map<string, string>"
REASONS = ("prior_config_not_captured", "engine_did_not_run", "components_not_recorded", "checks_changed", "results_truncated")


def context_of(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """The context of two tables of scans (one row for each target)."""
    ran = F.transform(F.filter("engine_details", lambda d: d["ran"]), lambda d: d["engine"])
    old = prior.select("target", F.col("scan_config").isNotNull().alias("captured"), F.col("truncated").alias("cut"), F.col("component_signatures").alias("prior_signatures"))
    new = fresh.select("target", F.col("truncated").alias("cut_again"), ran.alias("ran"), F.col("component_signatures").alias("fresh_signatures"))
    return old.join(new, "target").select("target", "captured", (F.coalesce("cut", F.lit(False)) | F.coalesce("cut_again", F.lit(False))).alias("truncated"), "ran", "prior_signatures", "fresh_signatures")


def _mark(rows: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(other.select("target", key).distinct().withColumn(name, F.lit(True)), ["target", key], "left")


def _keyed(findings: DataFrame) -> DataFrame:
    return findings if "dedup_key" in findings.columns else findings.withColumn("dedup_key", dedup_key())


def _present(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``present``: the other scan has the fingerprint or the dedup key."""
    marked = _mark(_mark(rows, other, "fingerprint", "__same"), other, "dedup_key", "__like")
    return marked.withColumn("present", F.coalesce("__same", "__like", F.lit(False))).drop("__same", "__like")


def unproven() -> Column:
    """The first reason why absence is no proof of a fix; null if it is one."""
    missing = F.exists("engines", lambda e: ~F.array_contains(F.coalesce("ran", F.array().cast("array<string>")), e))
    recorded = (F.coalesce(F.size("producer_components"), F.lit(0)) > 0) & F.col("prior_signatures").isNotNull()
    sign = lambda table, c: F.nullif(F.try_element_at(F.col(table), c), F.lit(""))
    changed = F.exists("producer_components", lambda c: F.coalesce(sign("prior_signatures", c) != sign("fresh_signatures", c), F.lit(True)))
    checks = (~F.coalesce("captured", F.lit(False)), missing, ~recorded, changed, F.coalesce("truncated", F.lit(False)))
    out = None
    for test, reason in zip(checks, REASONS, strict=True):
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def classify_prior(prior: DataFrame, fresh: DataFrame, context: DataFrame) -> DataFrame:
    """The prior findings with ``status`` (present, not_rechecked or resolved) and ``reason``."""
    prior, fresh = _keyed(prior), _keyed(fresh)
    rows = _present(prior, fresh).join(context, "target", "left")
    reason = F.when(~F.col("present"), unproven())
    status = F.when(F.col("present"), "present").when(reason.isNotNull(), "not_rechecked").otherwise("resolved")
    return rows.withColumns({"reason": reason, "status": status}).select(*prior.columns, "status", "reason")


def classify_fresh(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh findings with ``status``: remaining or introduced."""
    prior, fresh = _keyed(prior), _keyed(fresh)
    rows = _present(fresh, prior)
    return rows.withColumn("status", F.when(F.col("present"), "remaining").otherwise("introduced")).select(*fresh.columns, "status")


def diff(prior: DataFrame, fresh: DataFrame, context: DataFrame) -> DataFrame:
    """One table: prior findings that are resolved or not re-checked, fresh ones that remain or were introduced.

    Remaining rows are the fresh ones, so counts need not add up to the prior scan's.
    """
    gone = classify_prior(prior, fresh, context).where("status <> 'present'")
    return gone.unionByName(classify_fresh(prior, fresh).withColumn("reason", F.lit(None).cast("string")))


def for_display(rows: DataFrame, threshold: str | None) -> DataFrame:
    """The threshold hides findings below it, but never one that could not be re-checked."""
    if threshold is None:
        return rows
    return rows.where((F.col("status") == "not_rechecked") | (severity_rank(F.col("severity")) >= SEVERITY_RANK[threshold]))


def diff_summary(rows: DataFrame) -> DataFrame:
    """For each target: counts by status, whether the comparison is partial, and the reasons."""
    names = ("resolved", "remaining", "introduced", "not_rechecked")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in names]
    out = rows.groupBy("target").agg(*counts, F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out.withColumn("partial", F.col("not_rechecked") > 0)
