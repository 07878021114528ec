"""Closures that are kept up with streams of facts."""
