"""Scans and their findings as Parquet tables partitioned by scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.model import FINDING, SCAN

SCAN_ID = re.compile(r"scan-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
CORE = ("scan_id", "target", "started_at")


def checked_id(scan_id: str) -> str:
    """The id, if it is one: it becomes part of a path."""
    if not SCAN_ID.fullmatch(scan_id):
        raise ValueError("not a scan id")
    return scan_id


def save_scan(scan: DataFrame, findings: DataFrame, folder: str) -> None:
    """Appends one scan; findings need ``scan_id`` too. The findings come first, so that a scan that is listed is whole."""
    findings.write.mode("append").partitionBy("scan_id").parquet(f"{folder}/findings")
    scan.write.mode("append").parquet(f"{folder}/scans")


def load_scans(spark: SparkSession, folder: str) -> DataFrame:
    """All scans. A newer column that an old file lacks is null; a file without the core columns is an error."""
    there = set(spark.read.parquet(f"{folder}/scans").columns)
    if missing := [c for c in CORE if c not in there]:
        raise ValueError(f"no table of scans: {missing} missing")
    return spark.read.schema(SCAN).parquet(f"{folder}/scans")


def load_findings(spark: SparkSession, folder: str, scan_id: str | None = None) -> DataFrame:
    """Findings of all scans or of one: a filter on the partition column, so other scans' files are not read."""
    schema = f"{FINDING}, id string, frameworks array<struct<framework: string, controls: array<string>>>, dedup_key string, merged_rows long, scan_id string"
    rows = spark.read.schema(schema).parquet(f"{folder}/findings")
    return rows if scan_id is None else rows.where(F.col("scan_id") == checked_id(scan_id))


def latest(scans: DataFrame, *keys: str, by: str = "started_at", tie: str = "scan_id") -> DataFrame:
    """The latest row for each key (``target`` if none is given); one row per task and key is shuffled."""
    keys = keys or ("target",)
    rest = [c for c in scans.columns if c not in keys]
    return scans.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("row")).select(*keys, "row.*")
