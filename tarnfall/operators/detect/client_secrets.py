"""Secrets in code that reaches a browser. The rules are inferred from their names, examples and counter-examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.functions import secrets
from tarnfall.functions.paths import in_build_output
from tarnfall.model import lookup
from tarnfall.operators.detect.build import analyzer_findings
from tarnfall.sources.files import CODE, lines

PUBLIC_ENV = r"(?:process\.env|import\.meta\.env)\.((?:NEXT_PUBLIC|VITE|REACT_APP|EXPO_PUBLIC|GATSBY|NUXT_PUBLIC|PUBLIC)_[A-Z0-9_]*)"
SECRET_NAME = r"(?:SECRET|PRIVATE|SERVICE_ROLE|PASSWORD)"
BROWSER_FLAG = r"dangerouslyAllowBrowser\s*:\s*true(?![A-Za-z0-9_])"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
SERVER_PATH = r"(?i)(^|/)(api|server|functions|scripts|migrations|tests?|__tests__)/|\.server\.|(^|/)(route|middleware)\.[cm]?[jt]sx?$"


def code_of(line: Column) -> Column:
    """The line without comments that take all of it or its end; `//` after a colon is a URL's."""
    return F.regexp_replace(F.regexp_replace(line, r"^\s*(?://|\*|/\*).*$", ""), r"(?<!:)//[^'\"`]*$", "")


def jwt_claim(token: Column, claim: str) -> Column:
    """A claim of a token's payload; null if the payload is no JSON in base64url."""
    payload = F.translate(F.element_at(F.split(token, "[.]"), 2), "-_", "+/")
    padded = F.rpad(payload, (F.ceil(F.length(payload) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), f"$.{claim}")


#: What is said of each rule: title, severity, message.
TOLD = {
    "public-env-secret": ("Secret behind a client-visible variable prefix", "high", "A variable with a public prefix is compiled into the browser bundle, and its name says that it is a secret."),
    "llm-key-browser-exposed": ("LLM client allows use in a browser", "high", "The client is told to run in a browser, so its key is sent to every visitor."),
    "service-role-client": ("service_role key in client-reachable code", "critical", "A service_role token bypasses row level security and must never leave the server."),
    "client-hardcoded-secret": ("Hard-coded secret in client-reachable code", "critical", "A live key is written in code that reaches the browser."),
    "secret-in-bundle": ("Secret compiled into a shipped bundle", "critical", "A live key is part of the build output that browsers load."),
}


def _hit(rule: str, holds: Column, value: Column | None = None) -> Column:
    """A finding of a line, or null: its rule and, where it is one, the secret."""
    return F.when(holds, F.struct(F.lit(rule).alias("rule_id"), (F.lit(None).cast("string") if value is None else value).alias("value")))


def client_secrets(files: DataFrame) -> DataFrame:
    """files: rel, ext, content, build output included. One finding for each rule and line; one pass over the lines."""
    each = lines(files.where(F.col("ext").isin(*CODE))).withColumn("code", code_of(F.col("line")))
    built, server = in_build_output(F.col("file")), F.col("file").rlike(SERVER_PATH)
    names = F.regexp_extract_all("code", F.lit(PUBLIC_ENV), F.lit(1))
    env = F.exists(names, lambda n: n.rlike(SECRET_NAME) & ~n.contains("PUBLISHABLE"))
    tokens = F.filter(F.regexp_extract_all("code", F.lit(JWT), F.lit(0)), lambda t: F.coalesce((jwt_claim(t, "role") == "service_role") & (F.coalesce(jwt_claim(t, "iss"), F.lit("")) != "supabase-demo"), F.lit(False)))
    each = each.withColumns({"role_token": F.get(tokens, F.lit(0)), "found": secrets.find_secret(F.col("code"))})
    live, value = F.coalesce("found.live", F.lit(False)), F.col("found.value")
    hits = F.array(
        _hit("public-env-secret", ~built & env), _hit("llm-key-browser-exposed", ~built & F.col("code").rlike(BROWSER_FLAG)),
        _hit("service-role-client", ~built & ~server & F.col("role_token").isNotNull(), F.col("role_token")),
        _hit("client-hardcoded-secret", live & ~built & ~server, value), _hit("secret-in-bundle", live & built, value),
    )
    rows = each.select("file", F.col("line_no").alias("start_line"), "line", F.explode(F.array_compact(hits)).alias("hit")).select("file", "start_line", "line", "hit.*")
    told = {name: lookup(F.col("rule_id"), {rule: x[i] for rule, x in TOLD.items()}) for i, name in enumerate(("title", "severity", "message"))}
    secret = F.col("value").isNotNull()
    seen = rows.withColumns(told | {"confidence": F.lit("high"), "secret_value_hash": secrets.value_hash(F.col("value"))})
    # the whole line of a secret of unknown shape gives way to a marker; lines of the other rules hold none
    seen = seen.withColumn("snippet", F.when(secret, secrets.redact_unknown(F.col("line"), F.col("rule_id"))).otherwise(F.col("line"))).drop("line", "value")
    found = analyzer_findings(seen, None, ("A07:2021",))
    return found.withColumn("is_secret", F.when(F.col("secret_value_hash").isNotNull(), True))
