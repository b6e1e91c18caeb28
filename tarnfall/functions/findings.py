"""Columns that a finding is made of: weaknesses, kinds, titles, fingerprints, components, remediation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfall.functions.secrets import bound, find_secret
from tarnfall.model import NO_CWE, REMEDIATION

PIPELINE = "pipeline"
AI_INVOCATION = "analyzer:invocation"
#: Component of each analyzer rule.
RULE_COMPONENT = {
    "client-hardcoded-secret": "ai:client-secrets", "secret-in-bundle": "ai:client-secrets", "public-env-secret": "ai:client-secrets",
    "llm-key-browser-exposed": "ai:client-secrets", "service-role-client": "ai:client-secrets",
    "rls-missing": "ai:rls-policy-state", "rls-using-true": "ai:rls-policy-state", "storage-rls-public": "ai:rls-policy-state", "rls-inverted-auth": "ai:rls-policy-state",
    "edge-fn-no-auth": "ai:edge-auth", "prompt-injection-sink": "ai:prompt-injection", "client-metadata-authz": "ai:client-metadata-authz", "llm-output-dangerous-html": "ai:dangerous-html",
}
#: Revision of the meaning of each component; a change makes earlier findings of it impossible to re-check.
REVISIONS = {PIPELINE: "1", AI_INVOCATION: "1", **dict.fromkeys(RULE_COMPONENT.values(), "1")}

#: Short advice by weakness: summary, steps, suggestion, further reference.
ADVICE = {
    "CWE-798": ("Take the credential out of the source, load it on the server and rotate it.", ["Delete the literal.", "Read it from a server-side variable or a secrets manager.", "Revoke the exposed value."], "const key = process.env.SERVICE_KEY; // server only", "https://owasp.org/Top10/A07_2021-Identification_and_Authentication_Failures/"),
    "CWE-312": ("Keep sensitive data out of source and artifacts, or encrypt it.", ["Remove the value from the file or bundle.", "Store it encrypted or in a secrets manager."], None, None),
    "CWE-285": ("Check authorization explicitly and deny by default.", ["Verify that the acting user may access the resource.", "Grant only on an exact condition."], None, "https://owasp.org/Top10/A01_2021-Broken_Access_Control/"),
    "CWE-862": ("Add the authorization check that is missing.", ["Check access before the operation.", "Enable row level security and add a policy for each operation."], None, "https://owasp.org/Top10/A01_2021-Broken_Access_Control/"),
    "CWE-863": ("Make the authorization check test the right condition.", ["Replace predicates that are always true by an ownership check.", "Test the user's identity, not another claim."], None, "https://owasp.org/Top10/A01_2021-Broken_Access_Control/"),
    "CWE-89": ("Use parameters instead of building SQL from input.", ["Bind values.", "Validate dynamic identifiers against a list."], None, "https://owasp.org/Top10/A03_2021-Injection/"),
    "CWE-79": ("Encode output and keep input out of raw HTML.", ["Rely on the framework's escaping.", "Add a content security policy."], None, "https://owasp.org/Top10/A03_2021-Injection/"),
    "CWE-77": ("Keep untrusted input out of a shell.", ["Pass an array of arguments.", "Validate arguments that users control."], None, None),
    "CWE-94": ("Do not run untrusted input as code.", ["Remove dynamic evaluation.", "Parse data as data."], None, None),
    "CWE-1395": ("Upgrade or remove the vulnerable dependency.", ["Move to a fixed version.", "Rebuild the lock file and scan again."], None, "https://owasp.org/Top10/A06_2021-Vulnerable_and_Outdated_Components/"),
    "CWE-1426": ("Treat untrusted content as data, apart from instructions to the model.", ["Use a message of its own with the user role.", "Validate what the model's output can trigger."], None, "https://genai.owasp.org/llmrisk/llm01-prompt-injection/"),
}


def cwes_in(*texts: Column) -> Column:
    """Distinct weaknesses named in the texts, in order of appearance."""
    numbers = F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(r"(?i)CWE[-_ ]?(\d{1,5})"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n)))


def with_fallback(cwe: Column, is_secret: Column, engine: Column, rule_id: Column) -> Column:
    """The weaknesses, or the one that a secret or a vulnerable dependency stands for."""
    dependency = (engine == "trivy") & rule_id.rlike("(?i)^(cve-|ghsa-)")
    other = F.when(is_secret, "CWE-798").when(dependency, "CWE-1395").otherwise(NO_CWE)
    return F.when(F.size(cwe) > 0, cwe).otherwise(F.array(other))


def rule_name(engine: Column, raw: Column) -> Column:
    """Rule ids of the pattern engine end with the id proper, after their path."""
    last = F.element_at(F.split(raw, "[.]"), -1)
    return F.when((engine == "opengrep") & (last != ""), last).otherwise(raw)


def is_secret(engine: Column, rule_id: Column, name: Column, tags: Column, text: Column) -> Column:
    words = F.lower(F.concat_ws(" ", rule_id, name, tags))
    return (engine == "gitleaks") | words.rlike("secret|credential|api-key|apikey") | find_secret(text).isNotNull()


def kind(engine: Column, secret: Column, name: Column, tags: Column) -> Column:
    """By engine and structure only: the rule's name and tags, never the message."""
    lower, labels = F.lower(F.coalesce(name, F.lit(""))), F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    of = lambda tag, *names: lower.isin(tag, *names) | F.array_contains(labels, tag)
    trivy = (
        F.when((lower == "languagespecificpackagevulnerability") | F.array_contains(labels, "vulnerability"), "vulnerability")
        .when(of("license"), "license").when(of("misconfiguration"), "misconfiguration").otherwise("other")
    )
    return F.when(secret, "secret").when(engine == "opengrep", "sast").when(engine == "trivy", trivy).otherwise("other")


def first_sentence(text: Column, most: int = 100) -> Column:
    """Up to the first full stop before a space, white space made single; shortened with an ellipsis."""

    def cut(flat: Column) -> Column:
        dot = F.instr(flat, ". ")
        return F.when(dot > 1, F.substring(flat, F.lit(1), dot)).otherwise(flat)

    def shortened(sentence: Column) -> Column:
        return F.when(F.length(sentence) > most, F.concat(F.rtrim(F.substring(sentence, 1, most)), F.lit("…"))).otherwise(sentence)

    flat = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^ | $", "")
    return bound(bound(flat, cut), shortened)


def title(short: Column, name: Column, message: Column, raw_rule: Column, rule_id: Column, secret: Column) -> Column:
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(full(short) & ~short.startswith("Opengrep Finding:"), short)
        .when(full(name) & (name != raw_rule), name)
        .when(secret, "Hard-coded secret")
        .when(full(message) & (message != raw_rule) & (message != rule_id), first_sentence(message))
        .otherwise(rule_id)
    )


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts joined by bars; a null part keeps its place, empty."""
    joined = [x for p in parts for x in (F.lit("|"), F.coalesce(p.cast("string"), F.lit("")))][1:]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*joined), 256))


def remediation(cwe: Column) -> Column:
    """Advice for the first weakness that has any, else a generic one that refers to all of them."""
    table = {
        c: {"summary": summary, "steps": steps, "code_suggestion": code, "references": [c, *([ref] if ref else [])]}
        for c, (summary, steps, code, ref) in ADVICE.items()
    }
    known = F.array_intersect(cwe, F.array(*map(F.lit, ADVICE)))
    advice = F.try_element_at(F.from_json(F.lit(json.dumps(table)), f"map<string, {REMEDIATION}>"), F.get(known, F.lit(0)))
    general = {"summary": "Review the flagged code against the weakness it refers to.", "steps": ["Look at the location.", "Apply the usual fix for the weakness."]}
    return F.coalesce(advice, F.from_json(F.lit(json.dumps(general)), REMEDIATION).withField("references", F.coalesce(cwe, F.array().cast("array<string>"))))


def components(engine: Column, finding_kind: Column) -> Column:
    """What produced a finding of an external engine; all of it must be unchanged before its absence proves a fix."""
    own = lambda e, *names: [PIPELINE, *(f"{e}:{x}" for x in ("binary", "invocation", *names))]
    table = {"opengrep": own("opengrep", "ruleset"), "gitleaks": own("gitleaks", "config", "effective-ignore"), "trivy": own("trivy", "checks"), "trivy:vulnerability": own("trivy", "checks", "vulnerability-db")}
    key = F.when((engine == "trivy") & (finding_kind == "vulnerability"), "trivy:vulnerability").otherwise(engine)
    found = F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string, array<string>>"), key)
    return F.coalesce(found, F.array(F.lit(PIPELINE), F.concat(engine, F.lit(":binary")), F.concat(engine, F.lit(":invocation"))))


def signature(data: str | bytes) -> str:
    return "sha256:" + hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def static_signatures(names) -> dict[str, str]:
    """Signatures of our own components; an unknown one is an error."""
    return {n: signature(f"{n}\0{REVISIONS[n]}") for n in names}


def ruleset_signature(files) -> Column:
    """Aggregate over rows (rel, digest) of rule files: one signature, whatever the order of rows."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("rel", F.lit("\0"), "digest"))), "\n"), 256))
