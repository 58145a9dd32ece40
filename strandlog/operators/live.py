"""Current state of a change log: the last operation of each id in log order wins.

Order columns come from the log itself (batch, position); transaction ids may repeat
between tables and are never the order. ``row_number() = 1`` over the ids compiles to
WindowGroupLimit on both sides of the exchange, so each task sends one row per id.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidData
from ..schema import Table

PUT, DELETE = "R", "D"


def _desc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def last_operations(log: DataFrame, id_col: str = "id", order: Sequence[str] = ("_batch", "_pos")) -> DataFrame:
    """The last operation of each id."""
    w = Window.partitionBy(id_col).orderBy(*_desc(order))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def live_state(log: DataFrame, id_col: str = "id", order: Sequence[str] = ("_batch", "_pos"), op_col: str = "_op") -> DataFrame:
    """The rows that are put and not deleted since."""
    return last_operations(log, id_col, order).filter(F.col(op_col) == PUT)


def live_state_wide(log: DataFrame, id_col: str = "id", order: Sequence[str] = ("_batch", "_pos"), op_col: str = "_op") -> DataFrame:
    """As ``live_state`` for very wide rows: winners are found on narrow rows first."""
    win = live_state(log.select(id_col, *order, op_col), id_col, order, op_col).select(id_col, *order)
    return log.join(win, [id_col, *order], "left_semi")


def deleted_ids(log: DataFrame, id_col: str = "id", order: Sequence[str] = ("_batch", "_pos"), op_col: str = "_op") -> DataFrame:
    """Ids whose last operation is a tombstone."""
    return last_operations(log, id_col, order).filter(F.col(op_col) == DELETE).select(id_col)


def history(log: DataFrame, id_col: str = "id", order: Sequence[str] = ("_batch", "_pos")) -> DataFrame:
    """``log`` with ``version`` (from 1) and ``is_last`` per id."""
    w = Window.partitionBy(id_col).orderBy(*order)
    return log.withColumn("version", F.row_number().over(w).cast("long")).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())


def apply_log(snapshot: DataFrame, log: DataFrame, id_col: str = "id", order: Sequence[str] = ("_batch", "_pos"), op_col: str = "_op") -> DataFrame:
    """A snapshot brought forward by later operations; reads the log once per side."""
    last = last_operations(log, id_col, order)
    puts = last.filter(F.col(op_col) == PUT).select(*snapshot.columns)
    return snapshot.join(last.select(id_col), id_col, "left_anti").unionByName(puts)


def concat_logs(*logs: DataFrame) -> DataFrame:
    """Segments put one after the other; their order columns tell them apart."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out


def max_tx(*logs: DataFrame) -> int:
    """The largest transaction id over all tables' logs, 0 if there is none."""
    return concat_logs(*(x.select("_tx") for x in logs)).agg(F.max("_tx")).first()[0] or 0


def index_entries(live: DataFrame, table: Table) -> DataFrame:
    """(field, key, id) for every declared lookup, keys in their text form."""
    from ..functions.text import value_text

    pairs = F.array(*(F.struct(F.lit(x.field).alias("field"), value_text(F.col(x.field), table.kind(x.field)).alias("key")) for x in table.all_lookups))
    return live.select(F.explode(pairs).alias("_p"), "id").select("_p.field", "_p.key", "id")


def inverted_index(live: DataFrame, table: Table) -> DataFrame:
    """(field, key, ids): ordered id sets.

    For a key that very many rows share use ``index_entries``: its rows stay apart.
    """
    return index_entries(live, table).groupBy("field", "key").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def unique_violations(live: DataFrame, table: Table) -> DataFrame:
    """(field, key, n): keys of unique lookups that more than one id holds."""
    unique = [x.field for x in table.all_lookups if x.unique]
    entries = index_entries(live, table).filter(F.col("field").isin(unique))
    return entries.groupBy("field", "key").agg(F.count_distinct("id").alias("n")).filter("n > 1")


def check_unique(live: DataFrame, table: Table) -> DataFrame:
    found = unique_violations(live, table).first()
    if found:
        raise InvalidData(f"{found['n']} rows of {table.name!r} hold {found['field']} = {found['key']!r}")
    return live


def numbered(rows: DataFrame, key: str = "id", name: str = "_pos", buckets: int | None = None) -> DataFrame:
    """``rows`` with their place in key order, from 0.

    No global window: rows fall into ranges of the key by a bounded sample, ranges are
    counted, and each row is numbered inside its range from where the smaller ranges end.
    A row finds its range by binary search, so the work a row and the code generated stay
    small at any number of ranges. The counts, one per range, come to the driver: rows joined
    with them on the range can get a filter from Spark that names a column of another join.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = _bounds(rows, key, n)
    dealt = rows.withColumn("_b", _range_of(F.col(key), bounds))
    sizes = {r["_b"]: r["_n"] for r in dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).collect()}  # a row per range
    starts = F.array(*(F.lit(x).cast("long") for x in accumulate((sizes.get(b, 0) for b in range(len(bounds))), initial=0)))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(key)) + F.get(starts, F.col("_b")) - 1
    return dealt.withColumn(name, at.cast("long")).drop("_b")


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most ``key``."""
    if not bounds:
        return F.lit(0)
    all_ = F.array(*map(F.lit, bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    # behind the last bound there is null, which is not at most anything
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.try_element_at(all_, at + step) <= key, at + step).otherwise(at))


def compacted(live: DataFrame, first_tx: int, id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """Live rows as a fresh log: ids ascending, new transaction ids from ``first_tx`` on."""
    return numbered(live, id_col, "_pos", buckets).withColumn("_tx", (F.col("_pos") + first_tx).cast("long")).withColumn("_op", F.lit(PUT))


def _bounds(live: DataFrame, id_col: str, n: int) -> list:
    """Up to n - 1 split points from a bounded sample of the ids."""
    sample = [r[0] for r in live.select(id_col).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(64 * n).collect()]
    sample.sort(key=lambda x: x.encode() if isinstance(x, str) else x)
    step = len(sample) / n
    return list(dict.fromkeys(sample[int(i * step)] for i in range(1, n))) if sample else []
