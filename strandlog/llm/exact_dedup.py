"""Exact deduplication with disk-backed keyed streaming state.

The documents run through a Structured Streaming aggregation keyed by the digest of
their normalised text. Its state lives in RocksDB, has no watermark and so never
expires, and keeps per digest the smallest document id (the stable identifier), the
number of rows, and the locator (landed file and row) of the content that id stands for.
The documents are landed once, with their normalised text, so the locator leads to the bytes.
The finished state is read back as a table with Spark's state reader. Digests seen more
than once are hits; the bytes of every hit are compared in full with those at its class's
locator, and members whose bytes differ (a digest collision) form classes of
their own by (digest, bytes).

The stream runs in a session of its own, so its settings touch no other query. A state folder
given by the caller is kept, and a later run goes on from it; otherwise it goes with the run.

Everything here is DataFrame and SQL work inside the JVM.

Defined results: null text counts as empty; a null id counts as the smallest; equal ids with equal text count twice in
``group_size``, and all rows of that id are reported; an empty table gives no rows;
columns besides the id and the text are ignored, whatever they are called. ``keep`` keeps one row of
each class, also where the same row occurs several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_path, fresh, heavy_keys, land, once, only_marked, row_key, spread_join, unland, work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stateful query's own session.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # over all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: White space as the contract has it: space and the controls 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest, _norm): id, SHA-256 of the normalised text, the text itself."""
    norm = docs.select(docs[id_col].alias("_id"), normalised(docs[text_col]).alias("_norm"))
    return norm.select("_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("_digest"), "_norm")


class StreamDedup:
    """Keyed state over a stream of landed digests, one checkpoint folder per corpus.

    ``feed`` may be called again with a later landing of the same stream: the state goes
    on from where it was. ``state`` gives one row per digest.
    """

    def __init__(self, spark: SparkSession, checkpoint: str | None = None, max_bytes_per_trigger: int = 64 << 30):
        self.spark = spark
        self.checkpoint = checkpoint or work_path(spark, "dedup-state")
        self.max_bytes = max_bytes_per_trigger

    def feed(self, folder: str, schema) -> None:
        """Take in the files of ``folder`` not seen so far."""
        own = self.spark.newSession()
        for k, v in self.spark.conf.getAll.items():
            if self.spark.conf.isModifiable(k):
                own.conf.set(k, v)
        for k, v in STATE_CONF.items():  # the state store's own settings are no registered ones
            own.conf.set(k, v)
        rows = (
            own.readStream.schema(schema)
            .option("maxBytesPerTrigger", self.max_bytes)
            .parquet(folder)
            .select("_digest", "_id", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at"))
        )
        keyed_state = rows.groupBy("_digest").agg(F.min(F.struct("_id", "_at")).alias("_first"), F.count(F.lit(1)).alias("_rows"))
        query = (
            keyed_state.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def state(self) -> DataFrame:
        """(_digest, keep, at, rows): what the state retains for each digest."""
        kept = self.spark.read.format("statestore").load(self.checkpoint)
        first = next(f.name for f in kept.schema["value"].dataType.fields if f.dataType.typeName() == "struct")
        rows = next(f.name for f in kept.schema["value"].dataType.fields if f.dataType.typeName() == "long")
        return kept.select(
            F.col("key")["_digest"].alias("_digest"),
            F.col("value")[first]["_id"].alias("_keep"),
            F.col("value")[first]["_at"].alias("_locator"),
            F.col("value")[rows].alias("_rows"),
        )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, locator.

    ``locator`` names the landed file and row that held the kept row's content while the run compared it;
    the landed texts go at its end.
    """
    spark = docs.sparkSession
    landing = work_path(spark, "dedup-in")
    rows = keyed(docs, id_col, text_col)
    rows.write.parquet(landing)
    landed = spark.read.schema(rows.schema).parquet(landing)
    if landed.isEmpty():
        return landed.select(
            F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), F.col("_digest").alias("text_sha256"), F.lit("").alias("locator"),
        )
    stream = StreamDedup(spark, checkpoint)
    stream.feed(landing, landed.schema)
    state = land(stream.state(), "dedup-classes")
    if checkpoint is None:
        drop_path(spark, stream.checkpoint)

    heavy = heavy_keys(state.select("_digest", "_rows"))
    differing = differing_hits(landed, state, heavy)
    clash = not differing.isEmpty()
    out = spread_join(landed.select("_id", "_digest"), state, ["_digest"], heavy).select(
        "_id", F.col("_keep").alias("_keep_id"), F.col("_rows").alias("_size"), "_digest",
        F.concat_ws(":", F.col("_locator.file"), F.col("_locator.row").cast("string")).alias("_at"),
    )
    if clash:
        out = split_clashes(landed, out, differing)
    out = land(out, "dedup-told")  # a narrow table takes the place of the landed texts
    drop_path(spark, landing)
    unland(state)
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep_id")).alias("kept"), F.col("_digest").alias("text_sha256"), F.col("_at").alias("locator"),
    )


def differing_hits(landed: DataFrame, state: DataFrame, heavy: DataFrame) -> DataFrame:
    """(_digest): digests whose members are not all equal byte for byte.

    The rows of digests seen more than once are held against the content at their class's
    locator; those of a hot class are dealt over many tasks. Only texts of such digests travel, and a few
    others.
    """
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    hits = state.filter(F.col("_rows") > 1).select("_digest", "_locator")
    spots = hits.select(F.col("_locator").alias("_place"))
    met = only_marked(landed.select("_digest", at.alias("_place"), F.col("_norm").cast("binary").alias("_bytes")), hits, "_digest")
    first = only_marked(met, spots, "_place").join(hits, "_digest")
    kept = first.filter(F.col("_place") == F.col("_locator")).select("_digest", "_locator", F.col("_bytes").alias("_kept"))
    others = spread_join(met, kept, ["_digest"], heavy, by=["_place"]).filter((F.col("_place") != F.col("_locator")) & (F.col("_bytes") != F.col("_kept")))
    return land(others.select("_digest"), "dedup-differing").distinct()


def split_clashes(landed: DataFrame, out: DataFrame, differing: DataFrame) -> DataFrame:
    """Reassign the classes of digests whose members differ, by digest and bytes."""
    members = landed.select("_digest", "_id", "_norm").join(differing, "_digest", "left_semi")
    classes = members.groupBy("_digest", "_norm").agg(F.min("_id").alias("_keep_id"), F.count(F.lit(1)).alias("_size"))
    mended = members.join(classes, ["_digest", "_norm"]).select("_id", "_keep_id", "_size", "_digest", F.lit(None).cast("string").alias("_at"))
    return out.join(differing, "_digest", "left_anti").select("_id", "_keep_id", "_size", "_digest", "_at").unionByName(mended)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one of each class.

    A row is found by its id and its normalised text, so an id that stays for one text
    does not keep the rows it has with others.
    """
    key = fresh("_row_key", docs)
    kept = dedup(docs, id_col, text_col).filter("kept").select(row_key(F.col(id_col), F.col("text_sha256")).alias(key)).distinct()
    digest = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    return once(docs.withColumn(key, row_key(F.col(id_col), digest)), key).join(kept, key, "left_semi").select(*docs.columns)
