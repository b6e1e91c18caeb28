"""The secrets rules that can be run without an external engine: a pattern, keywords, an allow list, and for values of no known
shape the entropy that a value must have.

One automaton of all rules' keywords goes once over each file, whatever the number of rules, and says which rules may hold
where; only the lines of files that have a rule's keyword are looked at by its pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.functions import findings as f
from tarnfall.functions import secrets
from tarnfall.model import COLUMNS, lookup
from tarnfall.operators.normalize import conform
from tarnfall.sources.files import lines
from tarnfall.sources.rules import ALLOWED, GENERIC_RULES, SECRET_RULES


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: F.when(c == "", sum_).otherwise(sum_ - share(c) * F.log2(share(c))))


def keyed_files(files: DataFrame, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """rel, rule_id of each file (rel, content) and each rule of which it holds a keyword, in whatever case."""
    rules_of: dict[str, list[str]] = {}
    for rule, words in keywords.items():
        for w in words:
            rules_of.setdefault(w.lower(), []).append(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, rules in rules_of.items():
            machine.add_word(word, rules)
        machine.make_automaton()
        for batch in batches:
            rows = []
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found: set[str] = set()
                for _, rules in machine.iter((content or "").lower()):
                    found.update(rules)
                    if len(found) == len(keywords):
                        break
                rows += [{"rel": rel, "rule_id": rule} for rule in sorted(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("rel", pa.string()), ("rule_id", pa.string())]))

    return files.select("rel", "content").mapInArrow(run, "rel string, rule_id string")


def secret_values(files: DataFrame) -> DataFrame:
    """file, line_no, line, rule_id, title and value of each match; a value of a generic rule has the entropy it asks for."""
    known = {rule: (name, pattern, 0, None, keys) for rule, name, pattern, keys in SECRET_RULES} | {rule: (name, pattern, 1, least, keys) for rule, name, pattern, keys, least in GENERIC_RULES}
    keyed = keyed_files(files, {rule: keys for rule, (*_, keys) in known.items()})
    some = files.select("rel", "content").join(keyed.select("rel").distinct(), "rel", "left_semi")
    each = lines(some).join(keyed.withColumnRenamed("rel", "file"), "file")
    held = reduce(lambda out, x: out.when(F.col("rule_id") == x[0], F.regexp_extract_all("line", F.lit(x[1][1]), F.lit(x[1][2]))), known.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    rows = each.withColumn("value", F.explode(held)).where(~F.col("value").contains(ALLOWED))
    least = lookup(F.col("rule_id"), {rule: F.lit(float(x[3])) for rule, x in known.items() if x[3]})
    shaped = F.col("rule_id").isin(*(rule for rule, *_ in SECRET_RULES)) | (secrets.find_secret(F.col("value")).isNull() & (entropy(F.col("value")) >= least))
    return rows.where(shaped).select("file", "line_no", "line", "rule_id", lookup(F.col("rule_id"), {rule: x[0] for rule, x in known.items()}).alias("title"), "value")


def secret_rules(files: DataFrame) -> DataFrame:
    """files: rel, content. One finding for each rule and match of a line. The keyword is looked for in the whole file."""
    live = F.coalesce(secrets.find_secret(F.col("value"))["live"], F.lit(False))
    generic = F.col("rule_id").isin(*(rule for rule, *_ in GENERIC_RULES))
    rows = secret_values(files).withColumns({
        "engine": F.lit("gitleaks"), "engines": F.array(F.lit("gitleaks")), "cwe": F.array(F.lit("CWE-798")), "start_line": F.col("line_no"), "end_line": F.col("line_no"),
        "severity": F.when(live, "critical").otherwise("high"), "snippet": secrets.redact_unknown(F.col("line"), F.col("rule_id")), "message": F.concat("title", F.lit(" found.")),
        "confidence": F.when(generic, "medium").otherwise("high"), "is_secret": F.lit(True), "finding_kind": F.lit("secret"), "secret_value_hash": secrets.value_hash(F.col("value")),
    })
    rows = rows.withColumns({
        "remediation": f.remediation(F.col("cwe")), "producer_components": f.components(F.col("engine"), F.col("finding_kind")),
        "fingerprint": f.fingerprint(F.col("engine"), F.col("file"), F.col("start_line"), F.col("end_line"), F.lit("CWE-798"), F.col("rule_id"), F.col("secret_value_hash")),
    })
    return conform(rows).select(COLUMNS)
