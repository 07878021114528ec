"""Execution on Spark: joins, fixpoint, equality, provenance."""
