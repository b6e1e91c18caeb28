"""What a user calls: scan, rescan, compliance report, explanation, rules, bill of materials.

Every plan is lazy DataFrames from sources to findings; envelopes are small dictionaries. A scan of a folder takes the
analyzers' findings and any SARIF logs of external engines.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.functions.findings import PIPELINE, static_signatures
from tarnfall.model import MAX_FINDINGS, SCAN, SCANNERS, SEVERITY_RANK, nested
from tarnfall.operators import compliance, dedup, diff, rank, route, summary
from tarnfall.operators.detect.runner import run_analyzers
from tarnfall.operators.detect.secret_rules import secret_rules
from tarnfall.operators.detect.tree_rules import tree_rules
from tarnfall.operators.normalize import normalize
from tarnfall.sources.ignore_rules import IGNORE_FILE, ignored_below
from tarnfall.sources import files as source_files
from tarnfall.sources import rules, sarif, store

#: The engines of each scanner; an empty or missing choice is all of them.
ENGINES_OF = {"sast": "opengrep", "secret": "gitleaks", "vuln": "trivy", "misconfig": "trivy", "license": "trivy", "ai": "analyzer"}
DISCLAIMER = "What code shows of a control, no audit and no certification."


def wanted(scanners: list[str] | None) -> list[str]:
    """The engines to run, in a fixed order."""
    if unknown := set(scanners or ()) - set(SCANNERS):
        raise ValueError(f"unknown scanners: {sorted(unknown)}")
    return list(dict.fromkeys(ENGINES_OF[s] for s in SCANNERS if not scanners or s in scanners))


MOST_PATHS = 20


def routing_notes(stats) -> list[str]:
    """What routing has left out or reframed."""
    said = {"dropped_node_modules": "in installed packages left out", "dropped_build_noise": "in build output left out as noise", "reframed": "in ignored files reframed as local"}
    return [f"{stats[c]} findings {text}" for c, text in said.items() if stats[c]]


def size_notes(listed: DataFrame) -> list[str]:
    """Files of build output that are too large to be read."""
    large = source_files.oversized_build_files(listed, source_files.MAX_BYTES, 1 << 40, source_files.CODE).count()
    return [f"{large} files of build output were too large to be read"] if large else []


class Scan:
    """One scan: ``findings`` (before the limit), ``top`` (after it, with ids), the one-row ``envelope``, counts, and what
    limits them: ``warnings``, ``suppression`` channels, ``secret_coverage`` (verified, unverified, or None if secrets were
    not asked for)."""

    def __init__(self, envelope: DataFrame, findings: DataFrame, top: DataFrame, stats: DataFrame, warnings: list[str], suppression: list[dict] = (), secret_coverage: str | None = None):
        self.envelope, self.findings, self.top, self.route_stats, self.warnings = envelope, findings, top, stats, warnings
        self.suppression, self.secret_coverage = list(suppression), secret_coverage

    def engines(self) -> list[str]:
        """engine@version of the engines that ran."""
        return self.envelope.select(summary.engine_labels(F.col("engine_details")).alias("x")).first().x

    def summary(self) -> DataFrame:
        return summary.severity_summary(self.findings)

    def overview(self) -> DataFrame:
        """Coverage of all findings, whether or not they fit into the limit."""
        return compliance.overview(self.findings)

    def save(self, folder: str) -> None:
        """What is stored is what was shown: later reports and comparisons see the limited findings."""
        scan_id = self.envelope.first().scan_id
        store.save_scan(self.envelope, self.top.withColumn("scan_id", F.lit(scan_id)), folder)


def scan(spark: SparkSession, path: str, sarif_logs: dict[str, str] | None = None, scanners: list[str] | None = None, threshold: str | None = None, most: int = MAX_FINDINGS, ignored: DataFrame | None = None, signatures: dict[str, str] | None = None) -> Scan:
    """Scans a folder. ``sarif_logs``: engine and path of its log; a missing file means that the engine did not run.

    ``ignored``: paths (file) that version control ignores; without it the folder's ignore files decide, or file names where
    there are none. ``signatures``: of the external engines' components, as far as they are known.
    """
    if threshold is not None and threshold not in SEVERITY_RANK:
        raise ValueError(f"unknown severity: {threshold}")
    started, engines = datetime.now(timezone.utc).replace(tzinfo=None), wanted(scanners)
    listed = source_files.manifest(spark, path)
    read = source_files.read_contents(source_files.source_files(listed, include_built=True)).persist()
    known, warnings = static_signatures([PIPELINE]) | (signatures or {}), []
    logs = sarif.read_logs(spark, {e: p for e, p in (sarif_logs or {}).items() if e in engines})
    ran = {r.engine for r in logs.select("engine").distinct().collect()}
    raw = normalize(sarif.results(logs), path)
    if "gitleaks" in engines and "gitleaks" not in ran:
        raw, ran = raw.unionByName(secret_rules(read)), ran | {"gitleaks"}
        warnings.append("secrets: only the rules that need no external engine ran")
    if "opengrep" in engines and "opengrep" not in ran:
        raw = raw.unionByName(tree_rules(read))  # the engine counts as not run: its other rules prove nothing
        warnings.append("patterns: only the rules on Python that need no external engine ran")
    if "analyzer" in engines:
        own, notes, more = run_analyzers(read, apart=True)
        raw, ran, known, warnings = raw.unionByName(own), ran | {"analyzer"}, known | more, warnings + notes
    warnings += [f"{e} did not run: no log" for e in engines if e not in ran]
    raw = raw.persist()
    if ignored is None and not read.where(F.regexp_extract("rel", r"([^/]*)$", 1) == IGNORE_FILE).isEmpty():
        ignored = ignored_below(read, raw.select("file"))
    decided = route.decided(raw, ignored)
    merged = compliance.tag(dedup.dedup(route.apply(decided)))
    shown = rank.at_least(merged, threshold).persist()
    counts = {r.engine: r.finding_count for r in summary.engine_counts(raw).collect()}
    stats = route.route_stats(decided)
    warnings += routing_notes(stats.first()) + size_notes(listed)
    channels, coverage = [], None
    if "gitleaks" in engines:
        channels = [r.asDict() for r in summary.suppression(read).withColumn("paths", F.slice("paths", 1, MOST_PATHS)).collect()]  # three rows
        coverage = "unverified" if "gitleaks" not in ran or any(c["channel"] == "gitleaks_ignore" for c in channels) else "verified"
        warnings += [f"secrets: {c['count']} of {c['channel']}, {c['handling'].replace('_', ' ')}" for c in channels]
    if "trivy" in ran and "trivy:vulnerability-db" not in known:
        warnings.append("dependencies: the vulnerability database's signature is unrecorded, so later scans cannot prove fixes")
    total = shown.count()
    version = {r.engine: r.version for r in sarif.versions(logs).collect()}  # a row for each log
    details = [(e, version.get(e), e in ran, e in ran, counts.get(e, 0), None, None) for e in engines]
    row = (f"scan-{uuid.uuid4()}", path.rstrip("/"), started, total > most, total, details, known, (list(scanners) if scanners else None, threshold, most), None)
    return Scan(spark.createDataFrame([row], SCAN), shown, rank.limited(shown, most), stats, warnings, channels, coverage)


def rescan(spark: SparkSession, path: str, folder: str, prior_id: str | None = None, threshold: str | None = None, **options) -> tuple[Scan, DataFrame]:
    """Scans again and compares with a stored scan (the latest of the folder if no id is given).

    The new scan has no threshold, so that a finding that became less severe still counts as there; the threshold, the
    prior scan's unless another is given, only hides rows of the result.
    """
    scans = store.load_scans(spark, folder)
    prior = scans.where(F.col("scan_id") == store.checked_id(prior_id)) if prior_id else store.latest(scans.where(F.col("target") == path.rstrip("/")))
    row = prior.first()
    if row is None:
        raise ValueError("no prior scan")
    config = row.scan_config
    options = {"scanners": config and config.scanners, "most": (config and config.max_findings) or MAX_FINDINGS} | options
    fresh = scan(spark, path, **options)
    old = store.load_findings(spark, folder, row.scan_id).withColumn("target", F.lit(row.target))
    new = fresh.top.withColumn("target", F.lit(row.target))
    both = [c for c in old.columns if c in new.columns]
    compared = diff.diff(old.select(both), new.select(both), diff.context_of(prior, fresh.envelope.withColumn("target", F.lit(row.target))))
    return fresh, diff.for_display(compared, threshold or (config and config.severity_threshold))


def compliance_report(spark: SparkSession, folder: str, scan_id: str, framework: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Coverage by control and the posture score of a stored scan's findings."""
    stored = store.load_findings(spark, folder, scan_id)
    return compliance.coverage(stored, framework), summary.posture_score(stored)


#: What weaknesses mean, in a sentence each.
MEANING = {
    "CWE-798": "A credential in the source lets everyone who reads it act as its owner.", "CWE-312": "Sensitive data in cleartext is open to everyone who reads the file.",
    "CWE-285": "Actors can do what they should not be allowed to.", "CWE-862": "A resource can be reached without a check.", "CWE-863": "The check that guards a resource is wrong.",
    "CWE-89": "Input can change the structure of an SQL statement.", "CWE-79": "Input can run as script in a page.", "CWE-77": "Input can change the command that is run.",
    "CWE-94": "Input can run as code.", "CWE-1426": "Untrusted text can steer a model, or its output is trusted too far.",
}


def explain_finding(spark: SparkSession, folder: str, scan_id: str, finding_id: str) -> DataFrame:
    """One row: the finding, its explanation, why it matters, and its remediation; an unknown id is an error that lists the first ids."""
    stored = store.load_findings(spark, folder, scan_id)
    meaning = F.array_compact(F.transform("cwe", lambda c: F.try_element_at(F.create_map(*(F.lit(x) for pair in MEANING.items() for x in pair)), c)))
    told = F.concat(
        "message", F.lit("\n\nDetected by "), F.array_join("engines", " + "), F.lit(" (rule: "), "rule_id", F.lit("). Confidence: "), "confidence", F.lit("."),
        F.when(F.size(meaning) > 0, F.concat(F.lit("\n\n"), F.array_join(meaning, "\n"))).otherwise(""),
    )
    why = F.when(F.col("severity").isin("critical", "high"), "A weakness of high impact that an attacker can plausibly use: fix it before shipping.").otherwise("Less impact at once, but it weakens the application and should be fixed.")
    one = nested(stored.where(F.col("id") == finding_id)).withColumns({"explanation": told, "why_it_matters": why, "references": F.col("remediation.references")})
    if one.isEmpty():
        raise ValueError(f"no such finding; the first are {[r.id for r in stored.select('id').orderBy('id').limit(20).collect()]}")
    return one


def list_rules(spark: SparkSession, engine: str | None = None) -> DataFrame:
    return rules.rules(spark, engine)


def sbom_components(spark: SparkSession, path: str) -> DataFrame:
    """rel and number of components of the SBOM documents below a folder, or of one file."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("rel"), F.col("value").alias("content"))
    return summary.sbom_components(read)
