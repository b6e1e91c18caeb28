"""The rules of the analyzers and of the secrets engine that this package carries itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "id string, engine string, name string, kind string, cwe array<string>, source string"
#: Fixed values: (id, name, weaknesses) of the analyzers' rules.
ANALYZER_RULES = (
    ("client-hardcoded-secret", "Hard-coded secret in client-reachable code", "CWE-798 CWE-312"),
    ("secret-in-bundle", "Secret compiled into a shipped bundle", "CWE-798 CWE-312"),
    ("public-env-secret", "Secret exposed by a client-visible variable prefix", "CWE-798 CWE-312"),
    ("service-role-client", "service_role key in client-reachable code", "CWE-798 CWE-285"),
    ("llm-key-browser-exposed", "LLM client allows use in a browser", "CWE-798 CWE-312"),
    ("rls-using-true", "Row policy that is always true", "CWE-863 CWE-285"),
    ("rls-missing", "Table without row level security", "CWE-862 CWE-285"),
    ("rls-inverted-auth", "Row policy tests audience or role, not identity", "CWE-863"),
    ("edge-fn-no-auth", "Edge function without an authorization check", "CWE-862"),
    ("storage-rls-public", "Permissive policy on stored files", "CWE-863 CWE-285"),
    ("prompt-injection-sink", "Potential prompt-injection sink", "CWE-1426"),
    ("client-metadata-authz", "Authorization trusts metadata that clients write", "CWE-639 CWE-284 CWE-863"),
    ("llm-output-dangerous-html", "Untrusted or model output as raw HTML", "CWE-79 CWE-116"),
)
#: Fixed values: (id suffix, weakness) of the pattern engine's rules, whose results come as SARIF.
PATTERN_RULES = (
    ("sql-injection-string-build", "CWE-89"), ("sql-injection-python", "CWE-89"), ("command-injection", "CWE-77"), ("command-injection-python", "CWE-77"),
    ("dangerous-eval", "CWE-94"), ("eval-python", "CWE-94"), ("nosql-injection", "CWE-943"), ("path-traversal", "CWE-22"), ("dom-xss-innerhtml", "CWE-79"),
    ("ssrf-request-from-input", "CWE-918"), ("weak-hash", "CWE-327"), ("weak-cipher", "CWE-327"), ("weak-hash-python", "CWE-327"), ("insecure-random-security", "CWE-338"),
    ("jwt-alg-none", "CWE-347"), ("cors-wildcard-credentials", "CWE-942"), ("insecure-cookie", "CWE-1004"), ("insecure-deserialization-node", "CWE-502"), ("insecure-deserialization-python", "CWE-502"),
)
#: Fixed values: (id, name, pattern, words of which a line must have one) of the secrets rules.
SECRET_RULES = (
    ("stripe-live-secret", "Stripe live-mode secret key", r"(?:sk|rk)_live_[A-Za-z0-9]{10,}", ("sk_live_", "rk_live_")),
    ("service-role-token", "service_role token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("service_role", "supabase")),
    ("anthropic-key", "Anthropic API key", r"sk-ant-[A-Za-z0-9_-]{20,}", ("sk-ant-",)),
)
#: Our own rules for values of no known shape: (id, name, pattern with the value as its group, keywords, least entropy in bits).
_VALUE = r"""\s*(?:=|:|=>|:=)\s*["']([A-Za-z0-9+/_.~=-]{%d,200})["']"""
GENERIC_RULES = (
    ("generic-token", "Random value under a name of a secret", r"(?i)(?:token|secret|api_?key|access_?key|private_?key|credential)[A-Za-z0-9_]{0,40}" + _VALUE % 16, ("token", "secret", "apikey", "api_key", "accesskey", "access_key", "privatekey", "private_key", "credential"), 3.5),
    ("generic-password", "Random value under a name of a password", r"(?i)(?:password|passwd|pwd)[A-Za-z0-9_]{0,40}" + _VALUE % 10, ("password", "passwd", "pwd"), 3.0),
)
#: Fixed value: the public key of local development, the same everywhere, is no secret.
ALLOWED = "eyJpc3MiOiJzdXBhYmFzZS1kZW1v"


def rule_rows() -> list[tuple]:
    own = [(i, "analyzer", name, "ai", cwe.split(), "custom") for i, name, cwe in ANALYZER_RULES]
    pattern = [(f"baseline-{i}", "opengrep", i.replace("-", " "), "sast", [cwe], "custom") for i, cwe in PATTERN_RULES]
    return own + pattern + [(i, "gitleaks", name, "secret", ["CWE-798"], "custom") for i, name, *_ in SECRET_RULES]


def rules(spark: SparkSession, engine: str | None = None) -> DataFrame:
    """All rules, or those of one engine."""
    rows = spark.createDataFrame(rule_rows(), RULE)
    return rows if engine is None else rows.where(F.col("engine") == engine)


MANIFEST = "version string, custom_rules array<struct<id: string, engine: string, name: string, kind: string, cwe: array<string>, source: string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """version and rules of a JSON manifest; one that is not there or is no JSON has version ``unknown`` and no rules."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([("unknown", [])], MANIFEST)
    read = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return read.select(F.coalesce("version", F.lit("unknown")).alias("version"), F.coalesce("custom_rules", F.array()).alias("custom_rules"))
