"""Authorization that trusts metadata which clients can write, line by line and through variables of the same file.

Executors turn the files that mention such metadata into one index of tokens: file, line, place, the token, its neighbours,
and whether it stands in a condition. All the rest are joins and groups of that index: variables that hold a field of the
metadata are joined to their uses by file and token, and what a use does is told by its neighbours.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.functions.source_tokens import Token, closing, tokens
from tarnfall.operators.detect.build import analyzer_findings
from tarnfall.sources.files import CODE, lines
from tarnfall.sources.tables import saved

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: The sources, role-like fields, privileged names, comparisons, and methods that test.
META = ("user_metadata", "raw_user_meta_data")
ROLE_FIELD = r"(?i)^(?:role|roles|is_?admin|admin|permission|permissions|claims|is_?staff|is_?superuser)$"
PRIVILEGED = ("admin", "administrator", "superadmin", "super_admin", "superuser", "owner", "root", "staff", "moderator", "sysadmin")
COMPARE = ("===", "!==", "==", "!=")
TESTS, NAMED_TESTS = ("includes", "some", "every", "has", "indexOf"), ("includes", "startsWith", "some", "indexOf")

AROUND = ("p2", "p1", "n1", "n2", "n3", "n4")
INDEX = "file string, line int, at int, kind string, token string, " + ", ".join(f"{x} string" for x in AROUND) + ", tested boolean, holds string, declares boolean"


def shown(t: Token | None) -> str | None:
    """A token as a neighbour: strings keep a quote in front, so that they are told from names."""
    return None if t is None else ("'" + t.text if t.kind in ("string", "text") else t.text)


def bindings(own: list[Token], line: list[int]) -> Iterator[tuple[int, str | None]]:
    """The places of declared names, each with the field of the metadata that it is given (None: of something else)."""
    for i, t in enumerate(own):
        if t.kind != "name" or t.text not in ("const", "let", "var") or i + 2 >= len(own):
            continue
        stop = closing(own, i + 1) if own[i + 1].text == "{" else i + 1
        if stop + 1 >= len(own) or own[stop + 1].text != "=":
            continue
        value = []
        for j in range(stop + 2, len(own)):
            if line[j] != line[stop + 1] or own[j].text == ";" and own[j].kind == "op":
                break
            value.append(j)
        meta = next((j for j in value if own[j].text in META and own[j].kind == "name"), None)
        if own[i + 1].text != "{":
            after = [t.text for t in own[meta + 1 : meta + 4]] if meta is not None else []
            if after[:2] == ["?.", "["]:
                after = after[1:]
            yield i + 1, after[1] if len(after) > 1 and after[0] in (".", "?.", "[") else None
            continue
        part = i + 2
        while part < stop:
            end = part
            while end < stop and own[end].text != ",":
                end += 1
            if part < end:
                alias = part + 2 if part + 2 < end and own[part + 1].text == ":" else part
                yield alias, own[part].text if meta is not None else None
            part = end + 1


def index_of(file: str, content: str) -> list[dict]:
    """The rows of one file's index."""
    own = [*tokens(content)]
    breaks = [k for k, c in enumerate(content) if c == "\n"]
    line = [bisect.bisect_left(breaks, t.at) + 1 for t in own]
    declared = dict(bindings(own, line))
    conditions: list[tuple[int, int]] = []
    for i, t in enumerate(own[:-1]):
        if t.kind == "name" and t.text in ("if", "while") and own[i + 1].text == "(":
            conditions.append((i, closing(own, i + 1)))
    tested = {k for a, b in conditions for k in range(a + 2, b) if line[k] == line[a]}
    rows = []
    for i, t in enumerate(own):
        near = {name: shown(own[k]) if 0 <= (k := i + step) < len(own) and line[k] == line[i] else None for name, step in zip(AROUND, (-2, -1, 1, 2, 3, 4), strict=True)}
        rows.append({"file": file, "line": line[i], "at": i, "kind": t.kind, "token": t.text, **near, "tested": i in tested, "holds": declared.get(i), "declares": i in declared})
    return rows


def token_index(files: DataFrame) -> DataFrame:
    """One row for each token of the files (rel, content), with its neighbours of the same line."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(index_of(rel, content or ""), schema=schema)

    return files.select("rel", "content").mapInArrow(run, INDEX)


def _is(name: str, *values: str) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def _privileged(name: str) -> Column:
    return F.coalesce(F.lower(name).isin(*(f"'{x}" for x in PRIVILEGED)), F.lit(False))


def metadata_authz(files: DataFrame) -> DataFrame:
    """files: rel, ext, content. One finding for each line that decides on such metadata."""
    some = files.where(F.col("ext").isin(*CODE) & F.col("content").rlike(rf"{_B}(?:{'|'.join(META)}){_E}"))
    index = saved(token_index(some), "tokens")
    compared = lambda side: _is(side, *COMPARE)
    method = lambda names: _is("n1", ".", "?.") & _is("n2", *names) & _is("n3", "(")
    ternary = _is("n1", "?") & ~_is("n2", ":")
    # what a variable's own use says
    guards = compared("n1") | compared("p1") | method(TESTS) | F.col("tested") | ternary | _is("p1", "!")
    names_role = (compared("n1") & _privileged("n2")) | (compared("p1") & _privileged("p2")) | (method(NAMED_TESTS) & _privileged("n4"))
    name, value = F.col("kind") == "name", ~_is("p1", ".", "?.")
    held = index.where("holds IS NOT NULL").groupBy("file", "token").agg(F.max_by("holds", "at").alias("field"))
    told = index.where("declares").select("file", "token", "line").distinct()  # a line that declares the name is no decision on it
    uses = index.where(name & value & (guards | names_role)).select("file", "token", "line", guards.alias("guards"), names_role.alias("names_role"))
    uses = uses.join(held, ["file", "token"]).join(told, ["file", "token", "line"], "left_anti")
    by_variable = uses.where((F.col("field").rlike(ROLE_FIELD) & F.col("guards")) | F.col("names_role")).select("file", "line")
    # what a line does that reads a field of the metadata itself
    read = (F.col("token").isin(*META) & name) & _is("n1", ".", "?.", "[")
    field = F.when(read, F.ltrim(F.when(_is("n1", "?.") & _is("n2", "["), F.col("n3")).otherwise(F.col("n2")), F.lit("'")))
    op = F.col("kind") == "op"
    deciding = (op & F.col("token").isin(*COMPARE)) | (name & F.col("token").isin(*TESTS) & _is("p1", ".", "?.") & _is("n1", "(")) | (name & F.col("token").isin("if", "while") & _is("n1", "(")) | (op & (F.col("token") == "?") & ~_is("n1", ":"))
    of_role = (op & F.col("token").isin(*COMPARE) & (_privileged("n1") | _privileged("p1"))) | (name & F.col("token").isin(*NAMED_TESTS) & _is("p1", ".", "?.") & _is("n1", "(") & _privileged("n2"))
    by_line = index.groupBy("file", "line").agg(F.max(read).alias("reads"), F.max(F.coalesce(field.rlike(ROLE_FIELD), F.lit(False))).alias("role"), F.max(deciding).alias("decides"), F.max(of_role).alias("of_role"))
    by_line = by_line.where("reads AND ((role AND decides) OR of_role)").select("file", "line")
    hits = by_line.unionByName(by_variable).distinct()
    seen = lines(some).join(hits.withColumnRenamed("line", "line_no"), ["file", "line_no"]).select(
        "file", F.col("line_no").alias("start_line"), F.col("line").alias("snippet"),
        F.lit("Permission taken from metadata that users can edit").alias("title"), F.lit("high").alias("severity"),
        F.lit("The value that decides here is part of the account's own metadata, and every signed-in user may change theirs. Take it from a place that only the server writes to.").alias("message"),
        F.lit("medium").alias("confidence"),
    )
    return analyzer_findings(seen, "client-metadata-authz", ("A01:2021",))
