"""Relational operators over findings: routing, dedup, ranking, compliance, diff."""
