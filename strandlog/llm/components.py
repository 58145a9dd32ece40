"""Connected components by alternating large-star and small-star rounds.

Every round groups the links by node with partial aggregation and writes the rewritten
links to the shared folder, so nothing is collected and no lineage grows. A hub with very
many links is one key on the wide side of a join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import land, unland


def _signature(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    out = e.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.distinct()


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for each node that has a link, the smallest node it can reach."""
    s, d = F.col(src), F.col(dst)
    e = land(links.filter(s != d).select(F.greatest(s, d).alias("a"), F.least(s, d).alias("b")).distinct(), "links")
    before = _signature(e)
    while before[0]:
        last, e = e, land(_small(_large(e)), "stars")
        unland(last)
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
