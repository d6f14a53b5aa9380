"""Operators over provenance tables.  Each takes and returns DataFrames; the schemas are in ``stemma.sources.schemas``."""
