"""Spanloom: HTML notes to typed, ordered, cross-referenced text spans on Spark."""
