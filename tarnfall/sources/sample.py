"""A finding-shaped view of the ``lineitem`` table, to exercise the finding operators at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.functions import findings as f
from tarnfall.functions import severity
from tarnfall.model import lookup

CWES = {0: "CWE-89", 1: "CWE-79", 2: "CWE-639", 3: "CWE-noinfo", 4: "CWE-327"}
ENGINE_OF = {0: "opengrep", 1: "gitleaks", 2: "trivy", 3: "analyzer"}


def lineitem_findings(items: DataFrame) -> DataFrame:
    """Findings with ``target``, ``l_orderkey`` and ``l_linenumber``: places from part and quantity, engines from the
    supplier, scores from the discount."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    folder = F.when(part % 23 == 0, "node_modules/p").when(part % 11 == 0, "dist/c").when(part % 7 == 0, "tmp/b").otherwise("src/m")
    rows = items.withColumns({
        "target": F.concat(F.lit("repo-"), (supplier % 7).cast("string")),
        "file": F.concat(folder, (part % 97).cast("string"), F.lit(".ts")),
        "start_line": F.col("l_quantity").cast("int"),
        "end_line": F.col("l_quantity").cast("int"),
        "engine": lookup(supplier % 4, ENGINE_OF),
        "is_secret": (supplier % 4 == 1) | ((supplier % 4).isin(2, 3) & (F.col("l_returnflag") == "R")),
        "score": F.round(F.col("l_discount") * 100).cast("int"),
        "cwe": F.when(F.col("l_linenumber") % 3 == 0, F.array(lookup(part % 5, CWES), F.lit("CWE-862"))).otherwise(F.array(lookup(part % 5, CWES))),
    })
    rows = rows.withColumn("score_number", severity.leading_number(F.col("score").cast("string")))
    secret, kind = F.col("is_secret"), part % 13
    trivy = F.when(kind < 3, F.concat(F.lit("CVE-2024-"), (part % 97).cast("string"))).when(kind < 6, F.concat(F.lit("AVD-"), kind.cast("string"))).otherwise(F.concat(F.lit("rule-"), kind.cast("string")))
    rule = F.when(secret & (kind < 4), "aws-access-token").when(F.col("engine") == "trivy", trivy).otherwise(F.concat(F.lit("rule-"), kind.cast("string")))
    rows = rows.withColumns({
        "rule_id": rule,
        "severity": severity.normalize(secret, F.col("score") >= 9, F.col("score").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("score_number")),
        "confidence": severity.confidence(F.when(F.col("l_linestatus") == "O", "very-high").otherwise("low"), secret),
        "finding_kind": f.kind(F.col("engine"), secret, F.lit("Misconfiguration"), F.lit(None).cast("array<string>")),
        "engines": F.array("engine"),
        "title": F.concat(F.lit("Finding of "), rule),
        "message": F.concat(F.lit("Seen in line "), F.col("start_line").cast("string"), F.when(part % 2 == 0, " of a bundle.").otherwise(".")),
        "snippet": F.lit(None).cast("string"),
    })
    rows = rows.withColumns({
        "fingerprint": f.fingerprint(F.col("engine"), F.col("file"), F.col("start_line"), F.col("end_line"), F.col("cwe")[0], F.col("rule_id"), F.lit(None)),
        "producer_components": f.components(F.col("engine"), F.col("finding_kind")),
        "remediation": f.remediation(F.col("cwe")),
    })
    return rows.select("l_orderkey", "l_linenumber", "target", "fingerprint", "title", "severity", "engine", "engines", "rule_id", "cwe", "file", "start_line", "end_line", "snippet", "message", "remediation", "confidence", "is_secret", "producer_components", "finding_kind", F.lit(None).cast("array<string>").alias("owasp_web"), F.lit(None).cast("array<string>").alias("owasp_llm"))
