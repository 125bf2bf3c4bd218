"""Reusable column expressions and distributed statistics."""
