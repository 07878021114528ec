"""Builtin predicates as Column expressions."""
