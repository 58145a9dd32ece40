"""Streams over change logs."""
