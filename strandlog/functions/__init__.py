"""Scalar functions as Spark columns, and a few on the driver."""
