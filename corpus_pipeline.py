"""A corpus pipeline over ``documents``: filter, deduplicate, redact, pack.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the
last returns the packed pieces with their ids. ``run`` writes every stage's rows to the shared folder as
Parquet and reads them again, so a lost executor costs at most one stage's tasks.

Defined results: null and empty texts are not toxic, equal to each other (one of them stays), near nothing, hold no personal
data and are one piece of the end id. Rows with a null id are scored and compared like others. Of rows that
are repeated, under one id or several, one stays; an id with several texts keeps one row per text that
stays. An empty table gives no rows. Further columns of ``documents`` ride along up to the packing, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import exact_dedup, minhash_dedup, packing, pii, toxicity
from strandlog.llm._common import land


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. The model learns from ``labels`` of the rows it is given."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest id stays."""
    return minhash_dedup.keep(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("pii", redact),
    ("best-fit packing", pack),
]

#: The toxicity model and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
