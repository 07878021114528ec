"""Readers and writers of facts and rules."""
