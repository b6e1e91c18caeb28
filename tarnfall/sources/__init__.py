"""Readers and writers: file manifests, SARIF logs, rule manifests, the scan store."""
