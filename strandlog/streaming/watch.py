"""Live subscriptions: the answers to a selector as a log grows.

``states`` keeps the last operation per id as native streaming state and emits every
id that a batch of the log touched, ``selected`` tells which of them answer a selector.
``watch_database`` follows a database's commits: each micro-batch of new manifests is one step
from the last version delivered to the newest one, and a callback gets the touched rows that
answer now and the ids that answered before and no longer do. Delivery is at least once;
a micro-batch that is repeated after a failure brings the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.read import matches
from ..plans import Plan
from ..schema import Table

if TYPE_CHECKING:
    from ..database import Database


def log_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Operations of the batches below a log folder, as they arrive."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def states(log: DataFrame, table: Table) -> DataFrame:
    """(id, last operation) of touched ids; state per id, without expiry."""
    last = F.max(F.struct("_batch", "_pos", "_op", *[F.col(n) for n in table.names if n != "id"])).alias("s")
    return log.groupBy("id").agg(last).select("id", "s.*").select("_batch", "_pos", "_op", *table.names)


def answers(table: Table, plan: Plan) -> Column:
    """Whether a row answers the plan."""
    found = F.lit(True)
    if plan.op in ("get", "find") and plan.lookup is not None and plan.key:
        found &= matches(table, plan.lookup, plan.lookup_key)
    for name, bound in plan.range.items():
        c = F.col(plan.lookup)
        found &= {"gte": c >= F.lit(bound), "gt": c > F.lit(bound), "lt": c < F.lit(bound), "lte": c <= F.lit(bound)}[name]
    return F.coalesce(found, F.lit(False))


def selected(changed: DataFrame, table: Table, plan: Plan) -> DataFrame:
    """``changed`` with ``_in``: whether the row now answers the plan."""
    return changed.withColumn("_in", (F.col("_op") == "R") & answers(table, plan))


def watch_database(db: Database, plan: Plan, deliver: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``deliver(rows, left, revision)`` for the commits since the last call, as they come."""
    table = db.schema.table(plan.table)
    name = table.name

    def step(manifests: DataFrame, _: int) -> None:
        versions = sorted(json.loads(r["value"])["version"] for r in manifests.select("value").collect())  # a manifest each
        if not versions:
            return
        old, new = db.manifest_of(versions[0] - 1), db.manifest_of(versions[-1])
        seen = {b["at"] for b in db._state(name, old)["batches"]}
        fresh = [b for v in versions for b in db._state(name, db.manifest_of(v))["batches"] if b["at"] not in seen and not b["whole"]]
        fresh = list({b["at"]: b for b in fresh}.values())  # compacted meanwhile or not
        touched = db._batches(name, fresh).select("id").distinct()
        was = db.live(name, old).filter(answers(table, plan)).select("id")
        now = db.live(name, new).filter(answers(table, plan))
        left = touched.join(was, "id", "left_semi").join(now.select("id"), "id", "left_anti")
        if fresh:
            deliver(now.join(touched, "id", "left_semi"), left, versions[-1])

    source = db.spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.json").text(db.files.at("manifest"))
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_per_window(events: DataFrame, when: str, size: str, late: str, *keys: str) -> DataFrame:
    """Row counts per time window and key, closed once the watermark has passed."""
    return events.withWatermark(when, late).groupBy(F.window(when, size), *keys).agg(F.count(F.lit(1)).alias("n"))
