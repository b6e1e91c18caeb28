"""Detectors: files in, findings out."""
