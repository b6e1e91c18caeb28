"""Thresholds, order, limits and display ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfall.model import MAX_FINDINGS, SEVERITY_RANK, severity_rank


def at_least(findings: DataFrame, threshold: str | None) -> DataFrame:
    return findings if threshold is None else findings.where(severity_rank(F.col("severity")) >= SEVERITY_RANK[threshold])


def display_order() -> list:
    """Severity, file, line; the fingerprint and then the weaknesses settle ties."""
    return [F.desc(severity_rank(F.col("severity"))), F.asc("file"), F.asc("start_line"), F.asc("fingerprint"), F.asc(F.array_join("cwe", ","))]


def limited(findings: DataFrame, most: int = MAX_FINDINGS, prefix: str = "F-") -> DataFrame:
    """The first findings in display order with ``id``, numbered after the limit: the numbering window sees that many rows, never all."""
    top = findings.orderBy(*display_order()).limit(most)
    number = F.row_number().over(Window.orderBy(*display_order()))
    return top.withColumn("id", F.format_string(f"{prefix}%04d", number))


def top_lines(findings: DataFrame, n: int = 10) -> DataFrame:
    """One text for each of the first findings: severity, title, place, weaknesses, engine."""
    top = findings.orderBy(*display_order()).limit(n)
    return top.select(F.format_string("  • [%s] %s — %s:%d (%s, %s)", "severity", "title", "file", "start_line", F.array_join("cwe", ", "), "engine").alias("line"), "severity", "file", "start_line", "fingerprint", "cwe")
