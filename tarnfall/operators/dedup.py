"""One finding for each issue, whatever number of engines report it.

The keeper is the least by a total order, so it does not depend on the order of rows, and least-of and distinct-of are
combined before the shuffle: a key that holds a third of all rows sends a row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.model import CONFIDENCE_RANK, NO_CWE, SECRET_ENGINE_RANK, lookup, severity_rank


def dedup_key(secret: Column | None = None) -> Column:
    """Secrets by place, dependency findings by file and rule, others by place and weaknesses."""
    secret = F.coalesce(F.col("is_secret") if secret is None else secret, F.lit(False))
    place = F.format_string("%s:%d-%d", "file", "start_line", "end_line")
    return (
        F.when(secret, F.concat(F.lit("secret|"), place))
        .when(F.col("engine") == "trivy", F.concat(F.lit("vuln|"), "file", F.lit("|"), "rule_id"))
        .otherwise(F.concat(F.lit("general|"), place, F.lit("|"), F.array_join(F.array_sort("cwe"), ",")))
    )


#: columns that settle what ranks leave open, in this order
TIES = ("fingerprint", "title", "message", "snippet")


def preference() -> list[Column]:
    """Orders the findings of one key, best first: severity, the engine that tells most of a secret, confidence; then come
    fingerprint, and what else could differ."""
    secret = F.coalesce(F.col("is_secret"), F.lit(False))
    return [
        (-severity_rank(F.col("severity"))).alias("__severity"),
        F.when(secret, -lookup(F.col("engine"), SECRET_ENGINE_RANK, 0)).otherwise(0).alias("__engine"),
        (-lookup(F.col("confidence"), CONFIDENCE_RANK, 0)).alias("__confidence"),
    ]


def _union(column: str) -> Column:
    """Distinct members over all rows, sorted. Few distinct arrays occur in a key, so the set stays small."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(column, F.array().cast("array<string>"))))))


def dedup(findings: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The findings merged by :func:`dedup_key` (within the ``scope`` columns), plus ``merged_rows``.

    Of merged rows the keeper's columns stay; engines, weaknesses (a missing one is left out) and components are united.
    A single row is unchanged but for its sorted lists. Columns that nobody needs are best dropped before: all that are
    here are shuffled.
    """
    keyed = findings.withColumn("dedup_key", dedup_key())
    rest = [c for c in findings.columns if c not in (*scope, "engines", "cwe", "producer_components")]
    ordered = [c for c in TIES if c in rest] + [c for c in rest if c not in TIES]
    out = keyed.groupBy(*scope, "dedup_key").agg(
        F.min(F.struct(*preference(), *ordered, "cwe")).alias("keep"),  # the least row: each column travels once
        _union("engines").alias("engines"), _union("cwe").alias("all_cwe"), _union("producer_components").alias("components"), F.count("*").alias("merged_rows"),
    )
    united = F.filter("all_cwe", lambda c: c != NO_CWE)
    cwe = F.when((F.col("merged_rows") > 1) & (F.size(united) > 0), united).otherwise(F.col("keep.cwe"))
    whole = out.select(*scope, *(F.col(f"keep.`{c}`").alias(c) for c in rest), "engines", cwe.alias("cwe"), F.when(F.size("components") > 0, F.col("components")).alias("producer_components"), "dedup_key", "merged_rows")
    return whole.select(*findings.columns, "dedup_key", "merged_rows")


def dedup_stats(deduped: DataFrame) -> DataFrame:
    before = F.coalesce(F.sum("merged_rows"), F.lit(0))
    return deduped.agg(before.alias("before"), F.count("*").alias("after"), (before - F.count("*")).alias("merged"))
