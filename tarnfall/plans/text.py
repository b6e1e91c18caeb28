"""Short texts for people: a scan and a comparison in a few lines. Only counts and the first ten findings are collected."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.functions.findings import signature
from tarnfall.model import SEVERITY_RANK
from tarnfall.operators import rank
from tarnfall.operators.diff import diff_summary
from tarnfall.plans.api import DISCLAIMER, Scan

STATUSES = ("introduced", "remaining", "not_rechecked", "resolved")


def first_lines(findings: DataFrame, n: int = 10) -> str:
    return "\n".join(r.line for r in rank.top_lines(findings, n).orderBy(*rank.display_order()).collect())


def describe_scan(scan: Scan) -> str:
    envelope, counts = scan.envelope.first(), scan.summary().first()
    ran = [d.engine if d.version is None else f"{d.engine}@{d.version}" for d in envelope.engine_details if d.ran]
    parts = [
        f"Scan of {envelope.target}\n{counts.total} findings — " + ", ".join(f"{counts[s]} {s}" for s in SEVERITY_RANK) + f".\nEngines: {', '.join(ran)}",
        f"Top findings:\n{first_lines(scan.findings)}" if counts.total else "No findings.",
    ]
    if envelope.truncated:
        parts.append(f"({counts.total} in all; {envelope.scan_config.max_findings} shown.)")
    if scan.warnings:
        parts.append("Warnings:\n  - " + "\n  - ".join(scan.warnings))
    return "\n\n".join([*parts, DISCLAIMER])


def describe_changes(changes: DataFrame) -> str:
    """Findings that could not be re-checked get a part of their own: they are not resolved."""
    row = diff_summary(changes.withColumn("target", F.lit("all"))).first()
    counts = {s: row[s] if row else 0 for s in STATUSES}
    parts = ["Resolved: {resolved} | Remaining: {remaining} | Introduced: {introduced} | Not re-checked: {not_rechecked}".format(**counts)]
    heads = {"introduced": "Introduced", "remaining": "Still present", "not_rechecked": "Could not be re-checked, NOT confirmed resolved"}
    parts += [f"{head}:\n{first_lines(changes.where(F.col('status') == s))}" for s, head in heads.items() if counts[s]]
    if counts["not_rechecked"]:
        parts.append("Reasons: " + "; ".join(r.replace("_", " ") for r in row.reasons))
    return "\n\n".join([*parts, DISCLAIMER])


def result(text: str, structured: DataFrame | None = None, error: bool = False) -> dict:
    """The envelope of an answer: text, rows as dictionaries, and whether it is an error."""
    return {"text": text, "structured": None if structured is None else [r.asDict(recursive=True) for r in structured.collect()], "is_error": error}


def invocation_signature(producer: str, arguments: list[str]) -> str:
    """Of a command's meaning: its arguments with paths replaced by placeholders beforehand."""
    return signature(json.dumps({"producer": producer, "args": arguments}, separators=(",", ":")))
