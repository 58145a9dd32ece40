"""Batches of changes against a live table.

A batch is a DataFrame of the table's columns plus ``_seq`` (its order). Conflicts are
joins that must come out empty; they look at the state before the batch, so a key
that another change of the same batch frees is still taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AlreadyExists, InvalidInput, NotFound, PlanError
from ..functions.text import value_text
from ..schema import Table


def repeated_ids(batch: DataFrame) -> DataFrame:
    """(id, n): ids that a batch touches more than once."""
    return batch.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def insert_conflicts(batch: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of an insert batch whose id is live."""
    return batch.join(live.select("id"), "id", "left_semi")


def _unique_keys(df: DataFrame, table: Table, name: str) -> DataFrame:
    fields = [x.field for x in table.all_lookups if x.unique and x.field != "id"]
    if not fields:
        return df.select(F.lit("").alias("field"), F.lit("").alias("key"), F.col("id").alias(name)).filter(F.lit(False))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), value_text(F.col(f), table.kind(f)).alias("key")) for f in fields))
    return df.select(F.explode(pairs).alias("_p"), F.col("id").alias(name)).select("_p.field", "_p.key", name)


def unique_conflicts(batch: DataFrame, live: DataFrame, table: Table) -> DataFrame:
    """(field, key, id): unique keys of the batch that another live row or batch row holds."""
    new = _unique_keys(batch, table, "id")
    old = _unique_keys(live, table, "_owner")
    taken = new.join(old, ["field", "key"]).filter(F.col("id") != F.col("_owner")).select("field", "key", "id")
    twice = new.groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1").select("field", "key", "id")
    return taken.unionByName(twice).distinct()


def check_batch(batch: DataFrame, live: DataFrame, table: Table, insert_only: bool, touched: DataFrame | None = None, lost: DataFrame | None = None) -> None:
    """Raise what forbids the batch. All conflicts come from one job.

    ``touched`` are the ids of all its operations, if it does more than put rows; ``lost`` (id,
    field, key) are changes whose row was not found.
    """
    none = F.lit("")
    found = [repeated_ids(batch if touched is None else touched).select(F.lit("twice").alias("why"), "id", none.alias("field"), none.alias("key"))]
    if lost is not None:
        found.append(lost.select(F.lit("without").alias("why"), "id", "field", "key"))
    if insert_only:
        found.append(insert_conflicts(batch, live).select(F.lit("exists").alias("why"), "id", none.alias("field"), none.alias("key")))
    if any(x.unique and x.field != "id" for x in table.all_lookups):
        found.append(unique_conflicts(batch, live, table).select(F.lit("taken").alias("why"), "id", "field", "key"))
    bad = reduce(DataFrame.unionByName, found).orderBy(F.desc("why")).limit(1).collect()
    if bad:
        b = bad[0]
        if b["why"] == "twice":
            raise InvalidInput(f"batch touches {table.name} {b['id']!r} more than once")
        if b["why"] == "without":
            raise NotFound(f"{table.name} has no row with {b['field']} = {b['key']!r}")
        what = f"id {b['id']!r}" if b["why"] == "exists" else f"{b['field']} = {b['key']!r}"
        raise AlreadyExists(f"{table.name} already has {what}")


def upsert(live: DataFrame, batch: DataFrame) -> DataFrame:
    """Live rows with those of the batch put in."""
    return live.join(batch.select("id"), "id", "left_anti").unionByName(batch.select(*live.columns))


def patched(live: DataFrame, patches: DataFrame, table: Table) -> DataFrame:
    """Full rows of the patched ids; absent patch columns and nulls keep the old value."""
    given = [c for c in patches.columns if c in table.names and c != "id"]
    if not given:
        raise PlanError("a patch sets at least one field")
    news = patches.select("id", *[F.col(c).alias(f"_new_{c}") for c in given])
    rows = live.join(news, "id")
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in table.names])


def patch(live: DataFrame, patches: DataFrame, table: Table) -> DataFrame:
    """Live rows with patches merged in; patches of unknown ids must have been refused."""
    given = [c for c in patches.columns if c in table.names and c != "id"]
    news = patches.select("id", *[F.col(c).alias(f"_new_{c}") for c in given])
    rows = live.join(news, "id", "left")
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in table.names])


def missing(changes: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Changes whose row does not exist."""
    return changes.join(live.select(key), key, "left_anti")


def require_present(changes: DataFrame, live: DataFrame, table: Table, key: str = "id") -> None:
    lost = missing(changes, live, key).select(key).first()
    if lost:
        raise NotFound(f"{table.name} has no row with {key} = {lost[0]!r}")


def remove(live: DataFrame, ids: DataFrame) -> DataFrame:
    return live.join(ids.select("id"), "id", "left_anti")


def resolve(changes: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``changes`` with the id of the row that their unique key names, null if none."""
    return changes.join(live.select(key, "id"), key, "left")


def assign_tx(batch: DataFrame, first: int, order: str = "_seq") -> DataFrame:
    """``batch`` with ``_tx`` from ``first`` on: its ``_seq`` runs 0, 1, 2, ..."""
    return batch.withColumn("_tx", (F.col(order) + F.lit(first)).cast("long"))


def sequence(batch: DataFrame, key: str) -> DataFrame:
    """``batch`` with ``_seq`` in the order of a key, for batches of any size."""
    from .live import numbered

    return numbered(batch, key, "_seq")
