"""Scans with declared schemas, script corpora and views of the shared test tables."""
