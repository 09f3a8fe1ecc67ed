"""Readers, fingerprints, metadata files and sinks."""
