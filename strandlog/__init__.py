"""Typed tables kept as append-only change logs, read and written with Spark."""
