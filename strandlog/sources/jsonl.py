"""The older log: one JSON object per operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KINDS, Table

VERSION = 1


def encode(log: DataFrame, table: Table, timestamp_ms) -> DataFrame:
    """``log`` with ``line``; members in the order the format has them."""
    data = F.struct(*[F.col(n) for n in sorted(table.names)])
    whole = F.struct(
        F.lit(VERSION).alias("_v"), F.col("_tx").alias("_tx"), F.when(F.col("_op") == "R", "put").otherwise("delete").alias("_op"),
        timestamp_ms.alias("_ts"), F.lit(table.name).alias("table"), data.alias("data"),
    )
    return log.withColumn("line", F.to_json(whole))


def decode(lines: DataFrame, table: Table, column: str = "line") -> DataFrame:
    """(_tx, _op, _ts, fields): other versions, tables and broken lines raise."""
    data = T.StructType([T.StructField(f.name, KINDS[f.kind]) for f in table.fields])
    schema = T.StructType([T.StructField("_v", T.LongType()), T.StructField("_tx", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_ts", T.LongType()), T.StructField("table", T.StringType()), T.StructField("data", data)])
    j = F.from_json(F.col(column), schema, {"mode": "FAILFAST"})
    rows = lines.withColumn("_j", j)
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col(column)))
    version = F.when(F.coalesce(F.col("_j._v") == VERSION, F.lit(False)), F.col("_j._tx")).otherwise(bad("unsupported version").cast("long"))
    op = F.when(F.col("_j._op") == "put", "R").when(F.col("_j._op") == "delete", "D").otherwise(bad("unknown operation"))
    name = F.col("_j.table") == table.name
    return rows.filter(name).drop("_tx", "_op", "_ts").select(*[c for c in lines.columns if c != column], version.alias("_tx"), op.alias("_op"), F.col("_j._ts").alias("_ts"), *[F.col(f"_j.data.{f.name}").alias(f.name) for f in table.fields])


def load(spark: SparkSession, path: str, table: Table) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_name").alias("_file"), F.posexplode(F.split("value", "\n", -1)).alias("_pos", "line")).filter(F.trim("line") != "")
    return decode(lines, table)
