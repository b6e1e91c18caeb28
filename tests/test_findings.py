"""Functions and operators of findings on small tables."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tarnfall.functions import findings as fn
from tarnfall.functions import paths, secrets, severity
from tarnfall.model import COLUMNS
from tarnfall.operators import compliance, dedup, diff, rank, route, summary
from tarnfall.operators.normalize import conform, normalize
from tarnfall.plans import api
from tarnfall.plans import text as report
from tarnfall.sources import files, rules, sarif, store
from tarnfall.streaming.latest import latest_stream

BASE = {"title": "t", "severity": "high", "engine": "analyzer", "rule_id": "r", "cwe": ["CWE-798"], "file": "src/a.ts", "start_line": 3, "end_line": 3, "message": "m", "confidence": "high", "is_secret": False, "fingerprint": "sha256:a", "producer_components": ["pipeline"]}
DDL = "target string, fingerprint string, title string, severity string, engine string, engines array<string>, rule_id string, cwe array<string>, file string, start_line int, end_line int, snippet string, message string, confidence string, is_secret boolean, producer_components array<string>"


def table(spark, *rows):
    full = [{"target": "x", **BASE, "engines": [r.get("engine", "analyzer")], **r} for r in rows]
    df = spark.createDataFrame([{c.split()[0]: r.get(c.split()[0]) for c in DDL.split(", ")} for r in full], DDL)
    out = conform(df)
    return out.withColumn("target", F.lit("x"))


def one(spark, value, ddl, expression):
    return spark.createDataFrame([value], ddl).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("score", "word", "level", "want"), [("7.5 (HIGH)", None, None, "high"), ("9", None, None, "critical"), ("0", None, "error", "info"), ("x", "ERROR", None, "high"), (None, "what", "note", "low"), (None, None, None, "medium"), ("", None, "warning", "medium"), (".5", None, None, "low")])
def test_severity(spark, score, word, level, want):
    got = one(spark, (score, word, level), "s string, w string, l string", severity.normalize(F.lit(False), F.lit(False), F.col("s"), F.col("w"), F.col("l")))
    assert got == want


LIVE = "sk_live_" + "abcdef123456"


def test_secrets(spark):
    find = lambda text: one(spark, (text,), "t string", secrets.find_secret(F.col("t")))
    assert find(f"x={LIVE}").type == "Stripe live secret key" and find(f"x={LIVE}").live
    assert find("sk-ant-" + "a" * 30).type == "OpenAI API key"  # the first pattern of the list decides
    assert find("nothing") is None and find("xAKIA" + "A" * 16) is None and find("éAKIA" + "A" * 16) is not None
    redact = lambda text, hint="r": one(spark, (text,), "t string", secrets.redact_unknown(F.col("t"), F.lit(hint)))
    assert redact(f"a {LIVE} b {LIVE}x c") == "a sk_…[redacted, 20 chars] b sk_…[redacted, 21 chars] c"
    assert redact("pass=hunter2") == "[redacted potential secret: r]" and redact("pass", "") == "[redacted potential secret value]"
    assert redact("  \n") == "  \n" and redact(None) is None
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert "abc" not in redact(f"k = {pem} end") and redact(f"k = {pem} end").endswith(" end")
    assert "eyJaaaaaaaaa" not in redact("wordeyJaaaaaaaaa.bbbbbbbbb.ccccccccc")


@pytest.mark.parametrize(("uri", "target", "want"), [("file:///r/a%20b+c.ts", "/r", "a b+c.ts"), ("C:\\R\\src\\a.ts", "c:/r", "src/a.ts"), ("/C:/r/a.ts", "C:/r", "a.ts"), ("/r", "/r", "."), ("/r2/a.ts", "/r", "/r2/a.ts"), (None, "/r", "(unknown)"), ("a.ts", "/r/", "a.ts")])
def test_paths(spark, uri, target, want):
    assert one(spark, (uri,), "u string", paths.relative(F.col("u"), target)) == want


def test_small_functions(spark):
    assert one(spark, ("CWE-79, cwe_89 CWE 79",), "t string", fn.cwes_in(F.col("t"))) == ["CWE-79", "CWE-89"]
    assert one(spark, ("One. Two",), "t string", fn.first_sentence(F.col("t"))) == "One."
    assert one(spark, ("w " * 80,), "t string", fn.first_sentence(F.col("t"))) == ("w " * 50).rstrip() + "…"
    a, b = (one(spark, (x, "b"), "x string, y string", fn.fingerprint(F.col("x"), F.col("y"))) for x in (None, ""))
    assert a == b != one(spark, ("b", None), "x string, y string", fn.fingerprint(F.col("x"), F.col("y")))
    assert one(spark, (["CWE-5", "CWE-89"],), "c array<string>", fn.remediation(F.col("c"))).references[0] == "CWE-89"
    assert one(spark, (["CWE-5"],), "c array<string>", fn.remediation(F.col("c"))).references == ["CWE-5"]
    assert [one(spark, (p,), "p string", paths.env_or_backup(F.col("p"))) for p in (".env", "a/.env.local", ".env.example", "x.bak", "env.ts")] == [True, True, False, True, False]
    assert one(spark, ("a\nb\nc", 3), "t string, o int", files.line_of(F.col("t"), F.col("o"))) == 2


def test_routing(spark):
    rows = table(spark, {"file": "node_modules/a.js"}, {"file": "dist/a.js"}, {"file": "dist/b.js", "engine": "gitleaks", "is_secret": True, "rule_id": "aws-key"}, {"file": "dist/c.js", "engine": "gitleaks", "is_secret": True, "rule_id": "generic"}, {"file": ".env", "severity": "critical"}, {"file": ".env.example"}, {"file": "x.bak", "severity": "info"})
    got = {r.file: r for r in route.route(rows).collect()}
    assert set(got) == {"dist/a.js", "dist/b.js", ".env", ".env.example", "x.bak"}
    assert got[".env"].severity == "low" and got[".env"].title.startswith("Only on this machine") and got["x.bak"].severity == "info"
    assert "browsers load it" in got["dist/a.js"].message and got[".env.example"].message == "m"
    assert route.route_stats(route.decided(rows)).first().asDict() == {"dropped_node_modules": 1, "dropped_build_noise": 1, "reframed": 2, "kept": 3}
    ignored = spark.createDataFrame([("src/a.ts",)], "file string")
    assert [r.severity for r in route.route(table(spark, {}, {"file": "src/b.ts"}), ignored).orderBy("file").collect()] == ["low", "high"]


def test_merging(spark):
    rows = [
        {"severity": "critical", "is_secret": True, "fingerprint": "b", "confidence": "low"}, {"engine": "gitleaks", "is_secret": True, "fingerprint": "c", "cwe": ["CWE-noinfo"], "producer_components": ["z", "a"]},
        {"file": "b", "engine": "trivy", "rule_id": "CVE-1", "start_line": 1}, {"file": "b", "engine": "trivy", "rule_id": "CVE-2", "start_line": 1}, {"file": "b", "engine": "trivy", "rule_id": "CVE-1", "start_line": 9, "fingerprint": "sha256:0"},
        {"file": "c", "cwe": ["CWE-2", "CWE-1"]}, {"file": "c", "cwe": ["CWE-1", "CWE-2"], "engine": "opengrep", "confidence": "low"}, {"file": "d", "cwe": ["CWE-noinfo"]},
    ]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = dedup.dedup(table(spark, *rows).repartition(1 + seed)).drop("remediation")
        got = sorted(map(str, out.collect()))
        assert want is None or got == want
        want = got
    by = {r.dedup_key: r for r in out.collect()}
    secret = by["secret|src/a.ts:3-3"]
    assert (secret.severity, secret.fingerprint, secret.engines, secret.cwe, secret.producer_components) == ("critical", "b", ["analyzer", "gitleaks"], ["CWE-798"], ["a", "pipeline", "z"])
    assert by["vuln|b|CVE-1"].start_line == 9 and by["vuln|b|CVE-1"].merged_rows == 2 and "vuln|b|CVE-2" in by
    assert by["general|c:3-3|CWE-1,CWE-2"].engine == "analyzer" and by["general|d:3-3|CWE-noinfo"].cwe == ["CWE-noinfo"]
    assert dedup.dedup_stats(out).first().asDict() == {"before": 8, "after": 5, "merged": 3}
    assert dedup.dedup_stats(dedup.dedup(table(spark, {}).limit(0))).first().before == 0


def test_order_and_counts(spark):
    rows = table(spark, *({"severity": s, "file": f"{i % 3}", "start_line": i, "fingerprint": str(i)} for i, s in enumerate(["low", "critical", "high", "critical", "info"] * 3)))
    top = rank.limited(rows, 4)
    assert [(r.id, r.severity) for r in top.orderBy("id").collect()] == [("F-0001", "critical"), ("F-0002", "critical"), ("F-0003", "critical"), ("F-0004", "critical")]
    assert [(r.file, r.start_line) for r in top.orderBy("id").collect()] == sorted((r.file, r.start_line) for r in rows.where("severity = 'critical'").collect())[:4]
    assert rank.at_least(rows, "high").count() == 9 and summary.severity_summary(rows).first().asDict() == {"critical": 6, "high": 3, "medium": 0, "low": 3, "info": 3, "total": 15}
    assert summary.posture_score(rows).first().posture_score == 0 and summary.posture_score(rows.limit(0)).first().posture_score == 100
    assert rank.top_lines(rows, 2).count() == 2


def test_compliance(spark):
    rows = table(spark, {"cwe": ["CWE-89", "CWE-639"]}, {"cwe": ["CWE-1"], "engine": "trivy", "rule_id": "CVE-9", "owasp": None}, {"cwe": ["CWE-noinfo"]})
    tagged = compliance.tag(rows).collect()
    first = {f.framework: f.controls for f in tagged[0].frameworks}
    assert first["ISO27001:2022"] == ["A.8.26", "A.8.28"] and first["SOC2"] == ["CC6.1", "CC8.1"] and tagged[0].owasp_web == ["A01:2021", "A03:2021"]
    assert {f.framework for f in tagged[1].frameworks} == {"NIST_CSF_2.0", "ISO27001:2022", "SOC2", "CIS_v8.1", "EssentialEight"} and tagged[2].frameworks == [] and tagged[2].owasp_web is None
    cover = {(r.framework, r.control): (r.findings, r.status) for r in compliance.coverage(compliance.tag(rows)).collect()}
    assert cover["ISO27001:2022", "A.8.28"] == (1, "gap") and cover["ISO27001:2022", "A.8.25"] == (0, "clear") and sum(f == "ISO27001:2022" for f, _ in cover) == 7
    assert compliance.coverage(compliance.tag(rows), "nothing").count() == 0


CONTEXT = {"captured": True, "truncated": False, "ran": ["analyzer"], "prior_signatures": {"pipeline": "1"}, "fresh_signatures": {"pipeline": "1"}}


@pytest.mark.parametrize(("change", "finding", "want"), [
    ({}, {}, ("resolved", None)), ({"captured": False}, {}, ("not_rechecked", "prior_config_not_captured")), ({"ran": []}, {}, ("not_rechecked", "engine_did_not_run")),
    ({}, {"engines": ["analyzer", "trivy"]}, ("not_rechecked", "engine_did_not_run")), ({"prior_signatures": None}, {}, ("not_rechecked", "components_not_recorded")), ({}, {"producer_components": None}, ("not_rechecked", "components_not_recorded")),
    ({"fresh_signatures": {"pipeline": "2"}}, {}, ("not_rechecked", "checks_changed")), ({"fresh_signatures": {}}, {}, ("not_rechecked", "checks_changed")), ({"fresh_signatures": {"pipeline": "1", "other": "9"}}, {}, ("resolved", None)),
    ({"truncated": True}, {}, ("not_rechecked", "results_truncated")), ({"captured": False, "truncated": True}, {}, ("not_rechecked", "prior_config_not_captured")),
])
def test_gone_findings(spark, change, finding, want):
    context = spark.createDataFrame([("x", *({**CONTEXT, **change}).values())], diff.CONTEXT)
    prior, fresh = table(spark, {"file": "gone.ts", "fingerprint": "g", **finding}, {"fingerprint": "s"}, {"file": "k.ts", "fingerprint": "old"}), table(spark, {"fingerprint": "s", "start_line": 8}, {"file": "k.ts", "fingerprint": "new"}, {"file": "n.ts", "fingerprint": "n", "severity": "low"})
    rows = diff.diff(prior, fresh, context)
    got = {r.fingerprint: (r.status, r.reason) for r in rows.collect()}
    assert got == {"g": want, "s": ("remaining", None), "new": ("remaining", None), "n": ("introduced", None)}
    shown = {r.fingerprint for r in diff.for_display(rows, "critical").collect()}
    assert shown == ({"g"} if want[0] == "not_rechecked" else set())
    assert diff.diff_summary(rows).first().partial == (want[0] == "not_rechecked")


def sarif_log(results, rules_=()):
    return json.dumps({"runs": [{"tool": {"driver": {"name": "e", "rules": list(rules_)}}, "results": results}]})


def result(rule, uri, line=1, text="m", snippet=None, **more):
    region = {"startLine": line, **({"snippet": {"text": snippet}} if snippet else {})}
    return {"ruleId": rule, "message": {"text": text}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region}}], **more}


def test_sarif(spark):
    logs = [
        ("opengrep", sarif_log([result("a.b.sql", "/r/x.ts", level="error"), {"ruleIndex": 0}], [{"id": "a.b.sql", "name": "n", "properties": {"cwe": ["CWE-89: x", "CWE-564"], "precision": "low", "tags": ["t"]}}])),
        ("trivy", sarif_log([result("CVE-1", "lock.json"), result("L", "y")], [{"id": "CVE-1", "name": "LanguageSpecificPackageVulnerability", "shortDescription": {"text": "A hole"}, "properties": {"security-severity": "9.8"}}, {"id": "L", "name": "License", "properties": {"cwe": "CWE-7"}}])),
        ("gitleaks", sarif_log([result("generic", "/r/s.env", 4, "has topsecret value", "pw = hunter2hunter2"), result("stripe", "/r/t.env", 5, f"k {LIVE}")])),
        ("broken", "{"),
    ]
    out = {(r.rule_id, r.file): r for r in normalize(sarif.results(spark.createDataFrame(logs, "engine string, log string")), "/r").collect()}
    sql = out["sql", "x.ts"]
    assert (sql.cwe, sql.severity, sql.confidence, sql.finding_kind, sql.title) == (["CWE-89", "CWE-564"], "high", "low", "sast", "n")
    assert out["sql", "(unknown)"].severity == "medium" and out["sql", "(unknown)"].start_line == 0
    cve = out["CVE-1", "lock.json"]
    assert (cve.severity, cve.cwe, cve.finding_kind, cve.title) == ("critical", ["CWE-1395"], "vulnerability", "A hole") and "trivy:vulnerability-db" in cve.producer_components
    assert out["L", "y"].cwe == ["CWE-7"] and out["L", "y"].finding_kind == "license" and "trivy:vulnerability-db" not in out["L", "y"].producer_components
    assert out["stripe", "t.env"].severity == "critical" and out["generic", "s.env"].severity == "high" and out["generic", "s.env"].cwe == ["CWE-798"]
    assert not any(x in str(list(out.values())) for x in ("topsecret", "hunter2", LIVE)) and len(out) == 6


def test_scan_and_rescan(spark, tmp_path):
    root, folder = tmp_path / "repo", str(tmp_path / "store")
    for rel, text in {"src/a.ts": "if (user.user_metadata.role === 'admin') go();", ".next/x.js": f"k='{LIVE}'", "node_modules/m/a.ts": "if (user.user_metadata.role === 'admin') go();", "_site/b.js": "x", ".gitleaksignore": "", "n.py": "# gitleaks:allow gitleaks:allowed"}.items():
        os.makedirs((root / rel).parent, exist_ok=True)
        (root / rel).write_text(text)
    listed = files.manifest(spark, str(root))
    assert {r.rel for r in listed.collect()} == {"src/a.ts", ".next/x.js", "_site/b.js", ".gitleaksignore", "n.py"}
    assert {r.rel for r in files.source_files(listed, ("ts", "js")).collect()} == {"src/a.ts"} and files.manifest(spark, str(root / "src/a.ts")).count() == 0
    assert [r.rel for r in files.oversized_build_files(listed, 5, 1000).collect()] == [".next/x.js"]
    channels = {r.channel: (r["count"], r.paths) for r in summary.suppression(files.read_contents(listed)).collect()}
    assert channels == {"gitleaks_ignore": (1, [".gitleaksignore"]), "inline_allow": (1, ["n.py"])}
    first = api.scan(spark, str(root))
    assert {(r.rule_id, r.file) for r in first.top.collect()} == {("client-metadata-authz", "src/a.ts"), ("stripe-live-secret", ".next/x.js")}
    assert [r.engines for r in first.top.where("rule_id = 'stripe-live-secret'").collect()] == [["analyzer", "gitleaks"]]
    assert first.secret_coverage == "unverified" and {c["channel"]: c["paths"] for c in first.suppression} == {"gitleaks_ignore": [".gitleaksignore"], "inline_allow": ["n.py"]}
    assert "secrets: 1 of gitleaks_ignore, coverage unverified" in first.warnings and first.engines() == ["gitleaks", "analyzer"]
    first.save(folder)
    (root / "src/a.ts").write_text("ok")
    (root / "src/c.ts").write_text("const o = { dangerouslyAllowBrowser: true };")
    _, rows = api.rescan(spark, str(root), folder)
    assert {(r.rule_id, r.status) for r in rows.collect()} == {("client-metadata-authz", "resolved"), ("stripe-live-secret", "remaining"), ("llm-key-browser-exposed", "introduced")}
    told = report.describe_changes(rows)
    assert told.startswith("Resolved: 1 | Remaining: 1 | Introduced: 1 | Not re-checked: 0") and "Still present" in told
    told = report.describe_scan(first)
    assert "2 findings — 1 critical, 1 high" in told and "opengrep did not run" in told and LIVE not in told
    assert report.result("x", first.summary())["structured"][0]["total"] == 2
    scan_id = first.envelope.first().scan_id
    cover, posture = api.compliance_report(spark, folder, scan_id, "ISO27001:2022")
    assert cover.count() == 7 and posture.first().posture_score == 100 - 15 - 8
    assert "Detected by analyzer" in api.explain_finding(spark, folder, scan_id, "F-0001").first().explanation
    with pytest.raises(ValueError):
        api.explain_finding(spark, folder, scan_id, "F-9999")
    with pytest.raises(ValueError):
        store.load_findings(spark, folder, "../x")


def test_notes_of_a_scan(spark, tmp_path):
    """Routing, files too large, and a vulnerability scan without its database's signature."""
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist/big.js").write_text("x" * (files.MAX_BYTES + 1))
    (tmp_path / ".env").write_text(f"KEY={LIVE}")
    log = tmp_path / "trivy.sarif"
    log.write_text(json.dumps({"runs": [{"tool": {"driver": {"version": "0.51.1", "rules": []}}, "results": [{"ruleId": "AVD-1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "dist/a.js"}}}]}]}]}))
    got = api.scan(spark, str(tmp_path), sarif_logs={"trivy": str(log)})
    assert got.secret_coverage == "verified" and got.suppression == [] and "trivy@0.51.1" in got.engines()
    said = " | ".join(got.warnings)
    for text in ("1 findings in build output left out", "findings in ignored files reframed", "1 files of build output were too large", "signature is unrecorded"):
        assert text in said, said
    assert api.scan(spark, str(tmp_path), scanners=["sast"]).secret_coverage is None


def test_invocations():
    one = report.invocation_signature("opengrep", ["scan", "<target>"])
    assert one == report.invocation_signature("opengrep", ["scan", "<target>"]) != report.invocation_signature("opengrep", ["scan"]) and one.startswith("sha256:")
    assert set(fn.static_signatures(["pipeline"])) == {"pipeline"}
    with pytest.raises(KeyError):
        fn.static_signatures(["unknown"])


def test_rules_and_sbom(spark, tmp_path):
    assert rules.rules(spark).count() == 35 and rules.rules(spark, "gitleaks").count() == 3
    assert rules.read_manifest(spark, str(tmp_path / "no.json")).first().version == "unknown"
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "custom_rules": [{"id": "a", "engine": "e", "cwe": ["CWE-1"]}]}))
    assert rules.read_manifest(spark, str(tmp_path / "m.json")).first().custom_rules[0].cwe == ["CWE-1"]
    docs = spark.createDataFrame([("c", '{"components": [{"a": 1}, {}]}'), ("s", '{"packages": [1]}'), ("n", "{}")], "rel string, content string")
    assert {r.rel: r.components for r in summary.sbom_components(docs).collect()} == {"c": 2, "s": 1, "n": 0}
    labels = spark.sql("select array(named_struct('engine','a','version','1','ran',true), named_struct('engine','b','version','2','ran',false)) d").select(summary.engine_labels(F.col("d")).alias("x")).first().x
    assert labels == ["a@1"]


def test_latest_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = latest_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("latest_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    want = store.latest(events, "user_id", by="ts", tie="event_id")
    assert sorted(map(str, spark.table("latest_rows").select("user_id", "event_id").collect())) == sorted(map(str, want.select("user_id", "event_id").collect()))
    assert COLUMNS[0] == "fingerprint"
