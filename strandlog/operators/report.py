"""Report aggregates over live tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_day(rows: DataFrame, when: Column | str, **totals: Column) -> DataFrame:
    """(day, n, totals...): rows and sums per UTC day."""
    c = F.col(when) if isinstance(when, str) else when
    return rows.groupBy(F.to_date(c).alias("day")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in totals.items()])


def per_key(rows: DataFrame, *keys: str, **totals: Column) -> DataFrame:
    """(keys..., n, totals...)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in totals.items()])


def distribution(rows: DataFrame, value: Column, width: float) -> DataFrame:
    """(bucket, n): a histogram with buckets of equal width."""
    return rows.groupBy((F.floor(value / width) * width).cast("double").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def log_statistics(log: DataFrame, bytes_col: str = "_bytes", chunk_col: str = "_chunk") -> DataFrame:
    """One row: operations, puts, tombstones, bytes, chunks."""
    return log.agg(
        F.count(F.lit(1)).alias("operations"),
        F.coalesce(F.sum(F.when(F.col("_op") == "R", 1).otherwise(0)), F.lit(0)).alias("puts"),
        F.coalesce(F.sum(F.when(F.col("_op") == "D", 1).otherwise(0)), F.lit(0)).alias("tombstones"),
        F.coalesce(F.sum(bytes_col), F.lit(0)).alias("bytes"),
        F.count_distinct(chunk_col).alias("chunks"),
    )
