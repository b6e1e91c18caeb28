"""What all analyzers share: the columns of a finding around what a detector has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.functions import findings as f
from tarnfall.functions import secrets
from tarnfall.model import COLUMNS, lookup
from tarnfall.operators.normalize import conform
from tarnfall.sources.rules import ANALYZER_RULES

_CWE = {rule: cwe.split() for rule, _, cwe in ANALYZER_RULES}


def _list(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.lit(None).cast("array<string>")


def analyzer_findings(seen: DataFrame, rule: str | None, web: tuple[str, ...] = (), is_secret: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings of one rule; of several (``rule`` is None) if ``seen`` has a ``rule_id``.

    seen: file, start_line, snippet, title, severity, message, confidence; ``owasp_llm`` and ``secret_value_hash`` if
    there are any. Snippets of secrets are redacted whatever their shape, others where a known pattern matches. ``by``:
    columns that stay, in front of those of a finding.
    """
    own = F.col("rule_id") if rule is None else F.lit(rule)
    cwe = F.array(*map(F.lit, _CWE[rule])) if rule else lookup(own, {k: F.array(*map(F.lit, v)) for k, v in _CWE.items()})
    component = F.lit(f.RULE_COMPONENT[rule]) if rule else lookup(own, f.RULE_COMPONENT)
    rows = seen.withColumns({"engine": F.lit("analyzer"), "rule_id": own, "cwe": cwe, "end_line": F.col("start_line"), "finding_kind": F.lit("ai")})
    hashed = F.col("secret_value_hash") if "secret_value_hash" in seen.columns else F.lit(None).cast("string")
    masked = secrets.redact_unknown(F.col("snippet"), F.col("rule_id")) if is_secret else secrets.redact(F.col("snippet"))
    rows = rows.withColumns({
        "engines": F.array(F.lit("analyzer")),
        "owasp_web": _list(web),
        "secret_value_hash": hashed,
        "snippet": masked,
        "is_secret": F.lit(True if is_secret else None).cast("boolean"),
        "message": secrets.redact(F.col("message")) if is_secret else F.col("message"),
        "remediation": f.remediation(F.col("cwe")),
        "producer_components": F.array(F.lit(f.PIPELINE), F.lit(f.AI_INVOCATION), component),
        "fingerprint": f.fingerprint(F.lit("analyzer"), F.col("file"), F.col("start_line"), F.col("end_line"), F.get("cwe", F.lit(0)), F.col("rule_id"), hashed),
    })
    return conform(rows, by).select(*by, *COLUMNS)
