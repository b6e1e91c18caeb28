"""Raw results of external engines into findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.functions import findings as f
from tarnfall.functions import secrets, severity
from tarnfall.functions.paths import relative
from tarnfall.model import COLUMNS, TYPES


def conform(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """All columns of a finding, in order and type; those that are not there are null."""
    return rows.select(*carry, *((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in TYPES.items()))


def normalize(results: DataFrame, target: str, carry: tuple[str, ...] = (), most_shown: int = 6) -> DataFrame:
    """Findings of :func:`tarnfall.sources.sarif.results`: rule ids cleaned, paths relative, severities on one scale,
    weaknesses extracted, and no secret value left in any column; after the carried columns. most_shown: leading characters
    of a secret that a message or snippet shows at most."""
    engine = F.col("engine")
    rows = results.withColumn("rule_id", f.rule_name(engine, F.col("raw_rule")))
    rows = rows.withColumn("text", F.coalesce("message_text", "short_text", "full_text", "rule_id"))
    rows = rows.withColumn("is_secret", f.is_secret(engine, F.col("rule_id"), F.col("rule_name"), F.coalesce("rule_tags", F.array().cast("array<string>")), F.concat_ws(" ", "snippet", "text")))
    secret = F.col("is_secret")
    rows = rows.withColumn("score_number", severity.leading_number(F.col("score")))
    rows = rows.withColumn("found", F.when(secret, secrets.find_secret(F.concat_ws("\n", "snippet", "text"))))
    named = f.cwes_in(F.array_join("cwe_texts", " "), F.array_join("rule_tags", " "), F.array_join("result_tags", " "), F.col("rule_name"), F.col("short_text"), F.col("full_text"), F.col("related"))
    rows = rows.withColumns({
        "file": relative(F.col("uri"), target),
        "finding_kind": f.kind(engine, secret, F.col("rule_name"), F.col("rule_tags")),
        "cwe": f.with_fallback(named, secret, engine, F.col("rule_id")),
        "secret_value_hash": secrets.value_hash(F.col("found.value")),
        "severity": severity.normalize(secret, F.coalesce("found.live", F.lit(False)), F.col("score"), F.col("severity_word"), F.col("level"), F.col("score_number")),
        "message": F.when(secret, secrets.redact_unknown(F.col("text"), F.col("rule_id"), most_shown)).otherwise(F.col("text")),
        "snippet": F.nullif(F.when(secret, secrets.redact_unknown(F.col("snippet"), F.col("rule_id"), most_shown)).otherwise(F.col("snippet")), F.lit("")),
        "confidence": severity.confidence(F.col("precision"), secret),
    })
    rows = rows.withColumns({
        "title": f.title(F.col("short_text"), F.col("rule_name"), F.col("message"), F.col("raw_rule"), F.col("rule_id"), secret),
        "fingerprint": f.fingerprint(engine, F.col("file"), F.col("start_line"), F.col("end_line"), F.col("cwe")[0], F.col("rule_id"), F.col("secret_value_hash")),
        "remediation": f.remediation(F.col("cwe")),
        "producer_components": f.components(engine, F.col("finding_kind")),
        "engines": F.array(engine),
    })
    named = conform(rows.withColumnsRenamed({c: f"__{c}" for c in carry}), tuple(f"__{c}" for c in carry))
    return named.withColumnsRenamed({f"__{c}": c for c in carry}).select(*carry, *COLUMNS)
