"""All analyzers over one table of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tarnfall.functions.findings import AI_INVOCATION, RULE_COMPONENT, static_signatures
from tarnfall.model import BUILD_DIRS, FINDING
from tarnfall.operators.detect.client_secrets import client_secrets
from tarnfall.operators.detect.metadata_authz import metadata_authz
from tarnfall.operators.detect.row_security import edge_functions, row_security
from tarnfall.operators.detect.taint import dangerous_html, prompt_injection

#: Analyzer, and whether it reads build output too.
ANALYZERS: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {
    "client-secrets": (client_secrets, True),
    "row-security": (row_security, False),
    "edge-functions": (edge_functions, False),
    "prompt-injection": (prompt_injection, False),
    "client-metadata-authz": (metadata_authz, False),
    "dangerous-html": (dangerous_html, False),
}


def run_analyzers(files: DataFrame, names=tuple(ANALYZERS), apart: bool = False) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Findings of all analyzers, notes on those that fail, and the signatures of all components: they are recorded even
    where nothing was found.

    files: rel, ext, size, content, build output included. All analyzers are one plan, and one that cannot be planned is
    left out; ``apart`` runs each on its own and keeps its rows, so that one that fails on some file is left out as well.
    """
    source = files.where(~F.arrays_overlap(F.slice(F.split("rel", "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0))), F.array(*map(F.lit, BUILD_DIRS))))
    out, notes = files.sparkSession.createDataFrame([], FINDING), []
    for name in names:
        analyzer, built = ANALYZERS[name]
        try:
            found = analyzer(files if built else source)
            if apart:
                found = found.persist()
                found.count()
            out = out.unionByName(found)
        except (PySparkException, Py4JJavaError) as e:
            notes.append(f"{name} did not run: {type(e).__name__}")
    return out, notes, static_signatures([AI_INVOCATION, *dict.fromkeys(RULE_COMPONENT.values())])
