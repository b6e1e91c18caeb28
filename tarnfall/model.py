"""The findings relation: columns, enumerations, ranks and the constants that decide results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks, penalties and preferences.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SEVERITY_PENALTY = {"critical": 15, "high": 8, "medium": 3, "low": 1, "info": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
SECRET_ENGINE_RANK = {"gitleaks": 3, "analyzer": 2, "trivy": 1, "opengrep": 0}
ENGINES = ("opengrep", "gitleaks", "trivy", "analyzer")
SCANNERS = ("sast", "secret", "vuln", "misconfig", "license", "ai")
NO_CWE = "CWE-noinfo"
MAX_FINDINGS = 200

#: Output folders of build tools, and folders that are never read.
BUILD_DIRS = (".next", "dist", "build", "out", ".nuxt", ".svelte-kit", ".output", "_site", "storybook-static", "web-build")
PRUNED_DIRS = ("node_modules", ".git", ".cache", "coverage", ".turbo", ".vercel", ".idea", ".vscode", ".pnpm-store")

REMEDIATION = "struct<summary: string, steps: array<string>, code_suggestion: string, references: array<string>>"
_TEXTS = "array<string>"
TYPES = {
    "fingerprint": "string", "title": "string", "severity": "string", "engine": "string", "engines": _TEXTS, "rule_id": "string", "cwe": _TEXTS,
    "owasp_web": _TEXTS, "owasp_llm": _TEXTS, "attack_techniques": _TEXTS,
    "file": "string", "start_line": "int", "end_line": "int", "snippet": "string", "message": "string", "remediation": REMEDIATION,
    "confidence": "string", "is_secret": "boolean", "secret_value_hash": "string", "producer_components": _TEXTS, "finding_kind": "string",
}
COLUMNS = list(TYPES)
FINDING = ", ".join(f"{name} {kind}" for name, kind in TYPES.items())
#: One row for each scan; a null ``scan_config`` means that the configuration was not captured, which matters in a diff.
SCAN = (
    "scan_id string, target string, started_at timestamp, truncated boolean, total_findings_before_limit long, "
    "engine_details array<struct<engine: string, version: string, available: boolean, ran: boolean, finding_count: long, duration_ms: long, note: string>>, "
    "component_signatures map<string, string>, "
    "scan_config struct<scanners: array<string>, severity_threshold: string, max_findings: int>, git_safety string"
)


def lookup(column: Column, table: dict, otherwise=None) -> Column:
    """The value of a small fixed table for a column: one constant map, so the column is evaluated once and the generated
    code stays small."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), column)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def severity_rank(column: Column) -> Column:
    return lookup(column, SEVERITY_RANK, 0)


def nested(findings):
    """Findings with ``location`` as a struct, as they are handed out."""
    inner = F.struct("file", "start_line", "end_line", "snippet").alias("location")
    return findings.select(*(c for c in findings.columns if c not in ("file", "start_line", "end_line", "snippet")), inner)
