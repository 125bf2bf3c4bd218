"""Readers, mapping-driven projection, the canonical merge and sinks."""
