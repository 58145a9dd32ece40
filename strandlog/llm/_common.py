"""Shared helpers: the shared work folder and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_strandlog_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="strandlog-py-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._strandlog_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) is a folder of our own set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir names the folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own folder in the shared one.

    Results are read from there as long as the application runs; at a normal end of the
    driver the folder goes.
    """
    own = f"{shared_dir(spark)}/strandlog-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_clear, path, path.getFileSystem(spark._jsc.hadoopConfiguration()))
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


_own_folders: set[str] = set()


def _clear(path, files) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        files.delete(path, True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of our own through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, and every executor can read it again after a loss.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unland(*frames: DataFrame) -> None:
    """Delete the files of landed frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if any(path.startswith(own) or path.startswith(own.replace("file://", "file:")) for own in _own_folders):
                drop_path(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have landed: it does so once their plans are collected."""
    spark._jvm.System.gc()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_: Column, *more: Column) -> Column:
    """One text that tells rows apart by their id, which may be null, and more columns."""
    told = F.when(id_.isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), id_.cast("string")))
    return F.concat_ws(":", *(c.cast("string") for c in more), told)


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``; repeated ones go before the shuffle, task by task."""
    n = fresh("_nth", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns)))).filter(F.col(n) == 1).drop(n)


#: A key with more than this share of a table's rows is dealt over ``SALTS`` tasks.
HEAVY_SHARE, SALTS = 1 / 1000, 64


def heavy_keys(counts: DataFrame, count: str = "_rows", least: int = 1000) -> DataFrame | None:
    """The keys of ``counts`` (key columns and their number of rows) with over ``HEAVY_SHARE`` of all rows; None without any.

    There are fewer than 1 / ``HEAVY_SHARE`` of them in any table, so they can be broadcast.
    """
    total, most = counts.agg(F.sum(count), F.max(count)).first()
    bound = max(least, int((total or 0) * HEAVY_SHARE))
    return counts.filter(F.col(count) > bound).drop(count) if (most or 0) > bound else None


def spread_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame | None, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """``left`` joined with ``right``, which holds few rows per key, on ``on``; rows of heavy keys are dealt over ``SALTS``
    tasks by a hash of their columns ``by`` (all), and meet a copy of the right rows in each."""
    if heavy is None:
        return left.join(right, on, how)
    flag, salt = fresh("_heavy", left, right), fresh("_salt", left, right)
    marked = F.broadcast(heavy.select(*on).distinct().withColumn(flag, F.lit(True)))  # fewer than 1 / HEAVY_SHARE rows
    share = F.pmod(F.xxhash64(*(by or left.columns)), F.lit(SALTS)).cast("int")
    one = left.join(marked, on, "left").withColumn(salt, F.when(F.col(flag), share).otherwise(0)).drop(flag)
    copies = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other = right.join(marked, on, "left").withColumn(salt, F.explode(copies)).drop(flag)
    return one.join(other, [*on, salt], how).drop(salt)


#: Hashes that are broadcast to leave rows out of a join, at most.
MARKS = 1 << 20


def only_marked(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``rows`` without most of those whose key ``wanted`` does not have, so that they need not travel to a join.

    What is broadcast are hashes of the wanted keys modulo ``MARKS``, so never more than that many.
    """
    mark = fresh("_mark", rows)
    h = F.pmod(F.xxhash64(*key), F.lit(MARKS)).alias(mark)
    return rows.select("*", h).join(F.broadcast(wanted.select(h).distinct()), mark, "left_semi").drop(mark)


def broadcast_bytes(spark: SparkSession, value):
    """Broadcast a value whose size the caller has bounded."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; the folder may be given in STRANDLOG_TOKENIZERS."""
    at = os.environ.get("STRANDLOG_TOKENIZERS")
    if at:
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)
