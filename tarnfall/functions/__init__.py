"""Column expressions: severity, fingerprints, redaction, CWE handling."""
