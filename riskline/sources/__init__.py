"""Schemas, readers, writers and the cohort derived from the given tables."""
