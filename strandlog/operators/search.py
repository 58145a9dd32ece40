"""Word search over text columns: an inverted index and queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def terms(rows: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """(term, id, n): words of ASCII letters and digits, lower-cased, with their counts."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return rows.select(F.explode(words).alias("term"), F.col(id_col).alias("id")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))


def dictionary(index: DataFrame) -> DataFrame:
    """(term, documents, occurrences)."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))


def store(index: DataFrame, path: str) -> None:
    """Keep an index as files sorted by term: a query reads the row groups of its terms only."""
    index.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored index."""
    return spark.read.parquet(path)


def search(index: DataFrame, query: str) -> DataFrame:
    """(id, score): ids that hold every word of the query, by their count of them."""
    import re

    wanted = sorted(set(re.findall(WORD, query.lower())))
    if not wanted:
        return index.select("id", F.col("n").alias("score")).filter(F.lit(False))
    hits = index.filter(F.col("term").isin(wanted))  # pushed to the index files
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("_terms"), F.sum("n").alias("score")).filter(F.col("_terms") == len(wanted)).drop("_terms")
