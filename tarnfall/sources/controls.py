"""Control mappings as small dimension tables: a published draft that was never reconciled, and no claim of compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Frameworks and their controls, by weakness and by group of weaknesses, and what code can show of each.
CSF, ISO, SOC2, CIS, ESSENTIAL = FRAMEWORKS = ("NIST_CSF_2.0", "ISO27001:2022", "SOC2", "CIS_v8.1", "EssentialEight")
WEB, LLM = "OWASP_Web_2021", "OWASP_LLM_2025"
AUTHORIZATION = ((ISO, "A.8.28"), (ISO, "A.8.26"), (CSF, "PR.AA-05"), (SOC2, "CC6.1"), (CIS, "16.10"), (WEB, "A01:2021"))
INJECTION = ((ISO, "A.8.28"), (CSF, "PR.PS-06"), (SOC2, "CC8.1"), (CIS, "16.1"), (WEB, "A03:2021"))
COMMAND = ((ISO, "A.8.28"), (CSF, "PR.PS-06"), (CIS, "16.1"), (WEB, "A03:2021"))
BY_CWE = {
    "CWE-798": ((ISO, "A.8.28"), (ISO, "A.8.24"), (ISO, "A.8.12"), (CSF, "PR.AA-05"), (CSF, "PR.DS-01"), (SOC2, "CC6.1"), (CIS, "16.12"), (CIS, "3.11"), (WEB, "A07:2021"), (LLM, "LLM02:2025")),
    "CWE-312": ((ISO, "A.8.24"), (ISO, "A.8.12"), (CSF, "PR.DS-01"), (SOC2, "CC6.1"), (CIS, "3.11"), (WEB, "A02:2021"), (LLM, "LLM02:2025")),
    "CWE-285": AUTHORIZATION,
    "CWE-862": AUTHORIZATION,
    "CWE-863": AUTHORIZATION,
    "CWE-89": INJECTION,
    "CWE-79": INJECTION,
    "CWE-77": COMMAND,
    "CWE-94": COMMAND,
    "CWE-1426": ((ISO, "A.8.28"), (ISO, "A.8.26"), (CSF, "PR.PS-06"), (LLM, "LLM01:2025")),
    "CWE-327": ((ISO, "A.8.24"), (CSF, "PR.DS-01"), (CSF, "PR.DS-02"), (CIS, "3.10"), (CIS, "3.11"), (WEB, "A02:2021")),
    "CWE-502": ((ISO, "A.8.28"), (CSF, "PR.PS-06"), (WEB, "A08:2021")),
    "CWE-918": ((ISO, "A.8.28"), (WEB, "A10:2021")),
}
#: group: its weaknesses that have no entry of their own, and their controls
BUCKETS = {
    "credentials": (("CWE-259", "CWE-321", "CWE-322", "CWE-540", "CWE-256"), ((ISO, "A.8.24"), (ISO, "A.8.12"), (CSF, "PR.DS-01"), (SOC2, "CC6.1"), (CIS, "16.12"), (WEB, "A07:2021"))),
    "crypto": (("CWE-326", "CWE-328", "CWE-916", "CWE-330", "CWE-295"), ((ISO, "A.8.24"), (CSF, "PR.DS-01"), (CSF, "PR.DS-02"), (SOC2, "CC6.7"), (CIS, "3.10"), (CIS, "3.11"), (WEB, "A02:2021"))),
    "access": (("CWE-284", "CWE-639", "CWE-732", "CWE-269", "CWE-306"), AUTHORIZATION),
    "injection": (("CWE-78", "CWE-90", "CWE-917", "CWE-643", "CWE-611", "CWE-1336"), INJECTION),
    "misconfig": (("CWE-16", "CWE-1188", "CWE-1004", "CWE-614", "CWE-668"), ((ISO, "A.8.27"), (CSF, "PR.PS-06"), (SOC2, "CC6.6"), (CIS, "16.1"), (WEB, "A05:2021"))),
    "vulnerable_component": (("CWE-1035", "CWE-1395", "CWE-937"), ((ISO, "A.8.8"), (CSF, "ID.RA-01"), (SOC2, "CC7.1"), (CIS, "7.1"), (ESSENTIAL, "PatchApplications"), (WEB, "A06:2021"))),
}
UNIVERSE = {
    CSF: ("PR.DS-01", "PR.DS-02", "PR.AA-05", "PR.PS-06", "ID.RA-01"),
    ISO: ("A.8.8", "A.8.12", "A.8.24", "A.8.25", "A.8.26", "A.8.27", "A.8.28"),
    SOC2: ("CC6.1", "CC6.6", "CC6.7", "CC7.1", "CC8.1"),
    CIS: ("2.1", "3.10", "3.11", "7.1", "16.1", "16.10", "16.12"),
    ESSENTIAL: ("PatchApplications",),
    WEB: ("A01:2021", "A02:2021", "A03:2021", "A05:2021", "A06:2021", "A07:2021", "A08:2021", "A10:2021"),
    LLM: ("LLM01:2025", "LLM02:2025", "LLM05:2025", "LLM06:2025"),
}


def cwe_rows() -> list[tuple[str, str, str]]:
    """(cwe, framework, control): a weakness's own entry, else those of the groups it is in."""
    own = [(cwe, *pair) for cwe, pairs in BY_CWE.items() for pair in pairs]
    return own + [(cwe, *pair) for weaknesses, pairs in BUCKETS.values() for cwe in weaknesses if cwe not in BY_CWE for pair in pairs]


def bucket_rows() -> list[tuple[str, str, str]]:
    return [(name, *pair) for name, (_, pairs) in BUCKETS.items() for pair in pairs]


def universe_rows() -> list[tuple[str, str]]:
    return [(framework, control) for framework, names in UNIVERSE.items() for control in names]


def universe(spark: SparkSession) -> DataFrame:
    """framework, control: the denominators of coverage, a fixed small table."""
    return spark.createDataFrame(universe_rows(), "framework string, control string")
