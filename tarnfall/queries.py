"""The driver's queries over its tables, each with the SQL that an independent engine runs on the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall import cases
from tarnfall.functions import findings as fn
from tarnfall.functions import secrets
from tarnfall.model import CONFIDENCE_RANK, SECRET_ENGINE_RANK, SEVERITY_PENALTY, SEVERITY_RANK
from tarnfall.operators import compliance, dedup, diff, rank, route, summary
from tarnfall.sources import controls, rules
from tarnfall.sources.files import lines
from tarnfall.sources.sample import lineitem_findings
from tarnfall.sources.store import latest
from tarnfall.sources.tables import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- the view of lineitem, for DuckDB ---
_CASE = lambda column, table: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"
_RANK = _CASE("severity", SEVERITY_RANK)
FINDINGS = """
p AS (
  SELECT l_orderkey, l_linenumber, l_partkey pk, l_suppkey sk, 'repo-' || (l_suppkey % 7) AS target,
    CASE WHEN l_partkey % 23 = 0 THEN 'node_modules/p' WHEN l_partkey % 11 = 0 THEN 'dist/c' WHEN l_partkey % 7 = 0 THEN 'tmp/b' ELSE 'src/m' END || (l_partkey % 97) || '.ts' AS file,
    CAST(l_quantity AS INTEGER) AS line, ['opengrep', 'gitleaks', 'trivy', 'analyzer'][l_suppkey % 4 + 1] AS engine,
    (l_suppkey % 4 = 1) OR (l_suppkey % 4 IN (2, 3) AND l_returnflag = 'R') AS is_secret, CAST(round(l_discount * 100) AS INTEGER) AS score, l_partkey % 13 AS kind, l_linestatus AS st,
    list_concat([['CWE-89', 'CWE-79', 'CWE-639', 'CWE-noinfo', 'CWE-327'][l_partkey % 5 + 1]], CASE WHEN l_linenumber % 3 = 0 THEN ['CWE-862'] ELSE [] END) AS cwe
  FROM lineitem),
q AS (
  SELECT *, CASE WHEN is_secret AND kind < 4 THEN 'aws-access-token' WHEN engine = 'trivy' AND kind < 3 THEN 'CVE-2024-' || (pk % 97) WHEN engine = 'trivy' AND kind < 6 THEN 'AVD-' || kind ELSE 'rule-' || kind END AS rule_id,
    CASE WHEN is_secret THEN CASE WHEN score >= 9 THEN 'critical' ELSE 'high' END WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END AS severity,
    CASE WHEN is_secret OR st = 'O' THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN is_secret THEN 'secret' WHEN engine = 'opengrep' THEN 'sast' WHEN engine = 'trivy' THEN 'misconfiguration' ELSE 'other' END AS finding_kind
  FROM p),
f AS (
  SELECT *, 'Finding of ' || rule_id AS title, 'Seen in line ' || line || CASE WHEN pk % 2 = 0 THEN ' of a bundle.' ELSE '.' END AS message,
    'sha256:' || sha256(engine || '|' || file || '|' || line || '|' || line || '|' || cwe[1] || '|' || rule_id || '|') AS fingerprint,
    list_concat(['pipeline', engine || ':binary', engine || ':invocation'], CASE engine WHEN 'opengrep' THEN ['opengrep:ruleset'] WHEN 'gitleaks' THEN ['gitleaks:config', 'gitleaks:effective-ignore'] WHEN 'trivy' THEN ['trivy:checks'] ELSE [] END) AS components
  FROM q)"""
ROUTED = (
    FINDINGS
    + f""",
b AS (SELECT *, CASE WHEN file LIKE 'node_modules/%' THEN 'node_modules' WHEN file LIKE 'dist/%' THEN 'build_output' WHEN file LIKE 'tmp/%' THEN 'gitignored' ELSE 'tracked' END AS bucket FROM f),
d AS (SELECT *, CASE WHEN bucket = 'node_modules' THEN 'dropped_node_modules' WHEN bucket = 'build_output' AND NOT (engine = 'analyzer' OR (is_secret AND rule_id LIKE 'aws-%')) THEN 'dropped_build_noise' WHEN bucket = 'gitignored' THEN 'reframed' ELSE 'kept' END AS decision FROM b),
r AS (
  SELECT * REPLACE (
    CASE WHEN bucket = 'gitignored' AND severity <> 'info' THEN 'low' ELSE severity END AS severity,
    CASE WHEN bucket = 'gitignored' THEN '{route.LOCAL}' || title ELSE title END AS title,
    CASE WHEN bucket = 'gitignored' THEN message || '{route.LOCAL_NOTE}' WHEN bucket = 'build_output' AND message NOT LIKE '%bundle%' THEN message || '{route.SHIPPED}' ELSE message END AS message)
  FROM d WHERE decision IN ('kept', 'reframed'))"""
)
MERGED = (
    ROUTED
    + f""",
k AS (SELECT *, CASE WHEN is_secret THEN 'secret|' || file || ':' || line || '-' || line WHEN engine = 'trivy' THEN 'vuln|' || file || '|' || rule_id ELSE 'general|' || file || ':' || line || '-' || line || '|' || array_to_string(list_sort(cwe), ',') END AS dedup_key FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY target, dedup_key ORDER BY {_RANK} DESC, CASE WHEN is_secret THEN {_CASE("engine", SECRET_ENGINE_RANK)} ELSE 0 END DESC, {_CASE("confidence", CONFIDENCE_RANK)} DESC, fingerprint, title, message) AS rn FROM k),
u AS (SELECT target, dedup_key, count(*) AS merged_rows, list_sort(list_distinct(flatten(list(cwe)))) AS all_cwe, list_sort(list_distinct(list(engine))) AS all_engines, list_sort(list_distinct(flatten(list(components)))) AS all_components FROM k GROUP BY 1, 2),
m AS (
  SELECT w.* EXCLUDE (cwe, components), merged_rows, all_engines AS engines, all_components AS components,
    CASE WHEN merged_rows > 1 AND len(list_filter(all_cwe, lambda c: c <> 'CWE-noinfo')) > 0 THEN list_filter(all_cwe, lambda c: c <> 'CWE-noinfo') ELSE cwe END AS cwe
  FROM w JOIN u USING (target, dedup_key) WHERE rn = 1)"""
)
_PAIRS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in controls.cwe_rows())
_BUCKETS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in controls.bucket_rows())
_UNIVERSE = ", ".join(f"('{a}', '{b}')" for a, b in controls.universe_rows())
TAGGED = (
    MERGED
    + f""",
by_cwe(cwe, framework, control) AS (VALUES {_PAIRS}),
by_bucket(bucket, framework, control) AS (VALUES {_BUCKETS}),
tags AS (
  SELECT DISTINCT target, dedup_key, framework, control FROM (
    SELECT e.target, e.dedup_key, b.framework, b.control FROM (SELECT target, dedup_key, unnest(cwe) AS c FROM m) e JOIN by_cwe b ON b.cwe = e.c
    UNION ALL
    SELECT m.target, m.dedup_key, b.framework, b.control FROM m JOIN by_bucket b ON m.engine = 'trivy' AND ((b.bucket = 'vulnerable_component' AND m.rule_id LIKE 'CVE-%') OR (b.bucket = 'misconfig' AND (m.rule_id LIKE 'AVD-%' OR m.rule_id LIKE 'aws-%')))))"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_findings(table(spark, sf_dir, "lineitem"))


IGNORED_FOLDER = "tmp/"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed by a table of the paths that version control ignores."""
    rows = found(spark, sf_dir)
    return route.decided(rows, rows.where(F.col("file").startswith(IGNORED_FOLDER)).select("file"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(route.apply(decided(spark, sf_dir)).drop("l_orderkey", "l_linenumber", "remediation"), ("target",))


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def texts(column: str) -> F.Column:
    return F.array_join(column, ",")


@query("finding_normalize", f"WITH {FINDINGS} SELECT l_orderkey, l_linenumber, severity, confidence, finding_kind, rule_id, fingerprint, array_to_string(components, ',') AS components FROM f")
def finding_normalize(spark, sf_dir):
    return found(spark, sf_dir).select("l_orderkey", "l_linenumber", "severity", "confidence", "finding_kind", "rule_id", "fingerprint", texts("producer_components").alias("components"))


@query("path_bucket", f"WITH {ROUTED} SELECT file, bucket, CAST(count(*) AS BIGINT) AS findings FROM b GROUP BY 1, 2")
def path_bucket(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("file", "bucket").agg(F.count("*").alias("findings"))


@query("route_findings", f"WITH {ROUTED} SELECT l_orderkey, l_linenumber, severity, title, message, fingerprint FROM r")
def route_findings(spark, sf_dir):
    return route.apply(decided(spark, sf_dir)).select("l_orderkey", "l_linenumber", "severity", "title", "message", "fingerprint")


@query("route_stats", f"WITH {ROUTED} SELECT " + ", ".join(f"CAST(count(*) FILTER (decision = '{c}') AS BIGINT) AS {c}" for c in ("dropped_node_modules", "dropped_build_noise", "reframed", "kept")) + " FROM d")
def route_stats(spark, sf_dir):
    return route.route_stats(decided(spark, sf_dir))


@query("dedup_merge", f"WITH {MERGED} SELECT target, dedup_key, fingerprint, severity, engine, title, message, merged_rows, array_to_string(engines, ',') AS engines, array_to_string(cwe, ',') AS cwe, array_to_string(components, ',') AS components FROM m")
def dedup_merge(spark, sf_dir):
    return merged(spark, sf_dir).select("target", "dedup_key", "fingerprint", "severity", "engine", "title", "message", "merged_rows", texts("engines").alias("engines"), texts("cwe").alias("cwe"), texts("producer_components").alias("components"))


@query("dedup_stats", f"WITH {MERGED} SELECT CAST(sum(merged_rows) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS after, CAST(sum(merged_rows) - count(*) AS BIGINT) AS merged FROM m")
def dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(merged(spark, sf_dir))


@query("severity_summary", f"WITH {MERGED} SELECT " + ", ".join(f"CAST(count(*) FILTER (severity = '{s}') AS BIGINT) AS {s}" for s in SEVERITY_RANK) + f", CAST(count(*) AS BIGINT) AS total FROM m WHERE {_RANK} >= 3")
def severity_summary(spark, sf_dir):
    return summary.severity_summary(rank.at_least(merged(spark, sf_dir), "medium"))


@query("engine_counts", f"WITH {FINDINGS} SELECT engine, CAST(count(*) AS BIGINT) AS finding_count FROM f GROUP BY 1")
def engine_counts(spark, sf_dir):
    return summary.engine_counts(found(spark, sf_dir))


@query("posture_by_place", f"WITH {MERGED} SELECT target, file, line AS start_line, CAST(greatest(0, 100 - sum({_CASE('severity', SEVERITY_PENALTY)})) AS INTEGER) AS posture_score FROM m GROUP BY 1, 2, 3")
def posture_by_place(spark, sf_dir):
    return summary.posture_score(merged(spark, sf_dir), "target", "file", "start_line")


_TOP = f"{_RANK} DESC, file, line, fingerprint, array_to_string(cwe, ',')"


@query("display_top", f"WITH {MERGED}, one AS (SELECT * EXCLUDE (rn), row_number() OVER (ORDER BY {_TOP}) AS n FROM m WHERE {_RANK} >= 3) SELECT 'F-' || printf('%04d', n) AS id, severity, file, line AS start_line, fingerprint FROM one WHERE n <= 200")
def display_top(spark, sf_dir):
    """The first 200 findings of all."""
    return rank.limited(rank.at_least(merged(spark, sf_dir), "medium")).select("id", "severity", "file", "start_line", "fingerprint")


@query("top_lines", f"WITH {MERGED}, one AS (SELECT * EXCLUDE (rn), row_number() OVER (ORDER BY {_TOP}) AS n FROM m) SELECT '  • [' || severity || '] ' || title || ' — ' || file || ':' || line || ' (' || array_to_string(cwe, ', ') || ', ' || engine || ')' AS line FROM one WHERE n <= 10")
def top_lines(spark, sf_dir):
    return rank.top_lines(merged(spark, sf_dir)).select("line")


@query("compliance_tags", f"WITH {TAGGED} SELECT target, dedup_key, framework, control FROM tags")
def compliance_tags(spark, sf_dir):
    tagged = compliance.tag(merged(spark, sf_dir))
    crosswalk = [F.struct(F.lit(name).alias("framework"), F.coalesce(column, F.array().cast("array<string>")).alias("controls")) for name, column in ((controls.WEB, "owasp_web"), (controls.LLM, "owasp_llm"))]
    each = tagged.select("target", "dedup_key", F.explode(F.concat("frameworks", F.array(*crosswalk))).alias("x"))
    return each.select("target", "dedup_key", "x.framework", F.explode("x.controls").alias("control"))


_COVERED = TAGGED + f", universe(framework, control) AS (VALUES {_UNIVERSE}), n AS (SELECT u.framework, u.control, count(t.control) AS findings FROM universe u LEFT JOIN tags t USING (framework, control) GROUP BY 1, 2)"


@query("control_coverage", f"WITH {_COVERED} SELECT framework, control, CAST(findings AS BIGINT) AS findings, CASE WHEN findings > 0 THEN 'gap' ELSE 'clear' END AS status FROM n")
def control_coverage(spark, sf_dir):
    return compliance.coverage(compliance.tag(merged(spark, sf_dir)))


@query("compliance_overview", f"WITH {_COVERED} SELECT framework, CAST(count(*) AS BIGINT) AS code_visible_controls, CAST(count(*) FILTER (findings > 0) AS BIGINT) AS controls_with_findings FROM n GROUP BY 1")
def compliance_overview(spark, sf_dir):
    return compliance.overview(compliance.tag(merged(spark, sf_dir)))


ENGINES_SQL = "['opengrep', 'gitleaks', 'trivy', 'analyzer']"
RESCAN = (
    MERGED
    + f""",
prior AS (SELECT * FROM m WHERE length(dedup_key) % 3 <> 0), fresh AS (SELECT * FROM m WHERE length(dedup_key) % 3 <> 1),
gone AS (
  SELECT p.target, p.dedup_key, p.fingerprint, p.severity,
    CASE WHEN p.target = 'repo-0' THEN 'prior_config_not_captured' WHEN p.target = 'repo-2' AND list_contains(p.engines, 'trivy') THEN 'engine_did_not_run' WHEN p.target = 'repo-4' THEN 'components_not_recorded'
      WHEN p.target = 'repo-3' AND list_contains(p.components, 'opengrep:ruleset') THEN 'checks_changed' WHEN p.target = 'repo-1' THEN 'results_truncated' END AS reason
  FROM prior p WHERE NOT EXISTS (SELECT 1 FROM fresh x WHERE x.target = p.target AND x.fingerprint = p.fingerprint) AND NOT EXISTS (SELECT 1 FROM fresh x WHERE x.target = p.target AND x.dedup_key = p.dedup_key)),
here AS (SELECT x.target, x.dedup_key, x.fingerprint, x.severity, CASE WHEN EXISTS (SELECT 1 FROM prior p WHERE x.target = p.target AND x.fingerprint = p.fingerprint) OR EXISTS (SELECT 1 FROM prior p WHERE x.target = p.target AND x.dedup_key = p.dedup_key) THEN 'remaining' ELSE 'introduced' END AS status FROM fresh x),
diffed AS (SELECT target, dedup_key, fingerprint, severity, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'not_rechecked' END AS status, reason FROM gone UNION ALL SELECT target, dedup_key, fingerprint, severity, status, NULL FROM here)"""
)


def context(spark: SparkSession) -> DataFrame:
    """Seven targets, each with a reason of its own why absence may prove nothing."""
    names = ["pipeline", *(f"{e}:{x}" for e in SECRET_ENGINE_RANK for x in ("binary", "invocation")), "opengrep:ruleset", "gitleaks:config", "gitleaks:effective-ignore", "trivy:checks"]
    old = {n: "1" for n in names}
    rows = [
        (f"repo-{t}", t != 0, t == 1, [e for e in SECRET_ENGINE_RANK if not (t == 2 and e == "trivy")], None if t == 4 else old, old | ({"opengrep:ruleset": "2"} if t == 3 else {}))
        for t in range(7)
    ]
    return spark.createDataFrame(rows, diff.CONTEXT)


def rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two scans of one merged table, which is written once: stored scans are tables too
    rows = saved(merged(spark, sf_dir).select("target", "dedup_key", "fingerprint", "severity", "engines", "producer_components"), "merged")
    third = F.length("dedup_key") % 3
    return diff.diff(rows.where(third != 0), rows.where(third != 1), context(spark))


@query("rescan_status", f"WITH {RESCAN} SELECT * FROM diffed")
def rescan_status(spark, sf_dir):
    return rescan(spark, sf_dir).select("target", "dedup_key", "fingerprint", "severity", "status", "reason")


@query("rescan_summary", f"WITH {RESCAN} SELECT target, " + ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s}" for s in ("resolved", "remaining", "introduced", "not_rechecked")) + ", coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL))), ','), '') AS reasons, count(*) FILTER (status = 'not_rechecked') > 0 AS partial FROM diffed GROUP BY 1")
def rescan_summary(spark, sf_dir):
    return diff.diff_summary(rescan(spark, sf_dir)).withColumn("reasons", texts("reasons"))


@query("rescan_display", f"WITH {RESCAN} SELECT target, dedup_key, status FROM diffed WHERE status = 'not_rechecked' OR {_RANK} >= 4")
def rescan_display(spark, sf_dir):
    return diff.for_display(rescan(spark, sf_dir), "high").select("target", "dedup_key", "status")


@query("latest_per_target", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_target(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), "user_id", by="ts", tie="event_id").select("user_id", "event_id", "event_type", "value")


@query("last_state_of_kind", "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS events, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2")
def last_state_of_kind(spark, sf_dir):
    """The last event of each user and kind decides its state."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("events"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


_LINES = "SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents WHERE text IS NOT NULL)"


@query("document_lines", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(length(line)) AS INTEGER) AS longest FROM ({_LINES}) GROUP BY 1")
def document_lines(spark, sf_dir):
    each = lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), F.col("text").alias("content")))
    return each.groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


_TOKEN = r'token = "[0-9a-f]{40}"'


@query("token_lines_redacted", f"SELECT doc_id, line_no, '[redacted potential secret: generic-token]' AS shown, 'sha256:' || sha256(regexp_extract(line, '{_TOKEN}')) AS value_hash FROM ({_LINES}) WHERE regexp_matches(line, '{_TOKEN}')")
def token_lines_redacted(spark, sf_dir):
    """Secrets of unknown shape: the whole line gives way to a marker."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(_TOKEN))
    each = lines(docs.select(F.col("doc_id").alias("rel"), F.col("text").alias("content"))).where(F.col("line").rlike(_TOKEN))
    return each.select(F.col("file").alias("doc_id"), "line_no", secrets.redact_unknown(F.col("line"), F.lit("generic-token")).alias("shown"), secrets.value_hash(F.regexp_extract("line", _TOKEN, 0)).alias("value_hash"))


@query("markup_sinks", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script')) AS INTEGER) AS scripts, CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM pages")
def markup_sinks(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all(html, F.lit("(?i)<script"), F.lit(0))).alias("scripts"), (F.length(html) - F.length(F.replace(html, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))


@query("role_positions", "SELECT conv_id, CAST(count(*) FILTER (role = 'system') AS BIGINT) AS system_turns, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS user_turns, CAST(min(turn) FILTER (role = 'system') AS BIGINT) AS first_system FROM conversations GROUP BY 1")
def role_positions(spark, sf_dir):
    role = F.col("role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(role == "system").alias("system_turns"), F.count_if(role == "user").alias("user_turns"), F.min(F.when(role == "system", F.col("turn"))).cast("long").alias("first_system"))


@query("cwe_extract", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'CWE-' || (p_size % 9) || CASE WHEN p_size % 9 = p_partkey % 50 THEN '' ELSE ',CWE-' || (p_partkey % 50) END ELSE 'CWE-noinfo' END AS cwes FROM part")
def cwe_extract(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 2 == 1, F.format_string("%s: see cwe_%d and CWE %d, again Cwe-%d", "p_name", F.col("p_size") % 9, F.col("p_partkey") % 50, F.col("p_size") % 9)).otherwise(F.col("p_name"))
    cwe = fn.with_fallback(fn.cwes_in(text), F.lit(False), F.lit("opengrep"), F.lit("x"))
    return part.select("p_partkey", texts(cwe).alias("cwes"))


@query("remediation_first", f"WITH {FINDINGS} SELECT l_orderkey, l_linenumber, CASE WHEN cwe[1] IN ('CWE-89', 'CWE-79') THEN cwe[1] WHEN list_contains(cwe, 'CWE-862') THEN 'CWE-862' ELSE cwe[1] END AS reference FROM f")
def remediation_first(spark, sf_dir):
    return found(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("remediation.references")[0].alias("reference"))


_RULES = ", ".join(f"('{i}', '{e}')" for i, e, *_ in rules.rule_rows())


@query("rules_by_engine", f"WITH {FINDINGS}, known AS (SELECT engine, CAST(count(*) AS BIGINT) AS rules FROM (VALUES {_RULES}) r(id, engine) GROUP BY 1) SELECT f.engine, CAST(count(*) AS BIGINT) AS findings, coalesce(any_value(rules), 0) AS rules FROM f LEFT JOIN known USING (engine) GROUP BY 1")
def rules_by_engine(spark, sf_dir):
    """How many findings each engine has made, and how many rules of it this package lists."""
    known = rules.rules(spark).groupBy("engine").agg(F.count("*").alias("rules"))
    counts = found(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("findings"))
    return counts.join(known, "engine", "left").select("engine", "findings", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"))


QUERIES |= cases.QUERIES
ORACLES |= cases.ORACLES
