"""Queries over the test tables for every operator, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .functions import text as fn
from .operators import live, mutate, read, report, search
from .plans import change, selector
from .schema import DatabaseSchema, Table, table
from .sources import jsonl, pack, segment
from .sources.files import Files, scratch

ORDERS = table("orders", "id: id", "o_custkey: int", "o_orderstatus: text", "o_totalprice: float", many=("o_custkey", "o_orderstatus"))
CUSTOMERS = table("customers", "id: id", "c_name: text", "c_mktsegment: text", "c_acctbal: float", unique=("c_name",), many=("c_mktsegment",))
EVENTS = table("events", "id: id", "event_type: text", "value: float", many=("event_type",))


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a log: one id per user, ``error`` is a tombstone."""
    e = _read(spark, sf, "events")
    return e.select(
        F.lit(0).cast("long").alias("_batch"), F.col("event_id").cast("long").alias("_pos"), F.col("event_id").cast("long").alias("_tx"),
        F.when(F.col("event_type") == "error", "D").otherwise("R").alias("_op"),
        F.col("user_id").cast("string").alias("id"), "event_type", F.col("value").cast("double").alias("value"),
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def order_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a batch of changes: every fifth an existing id, the rest new ones."""
    o = orders(spark, sf)
    k = F.col("id").cast("long")
    return o.withColumn("id", F.when(k % 5 == 0, F.col("id")).otherwise(F.concat(F.lit("n"), "id"))).withColumn("o_orderstatus", F.lit("X"))


def order_patches(spark: SparkSession, sf: str) -> DataFrame:
    """A patch of every order; nulls leave a field as it is."""
    k = F.col("id").cast("long")
    return orders(spark, sf).select("id", F.when(k % 7 == 0, "P").alias("o_orderstatus"), F.when(k % 2 == 0, F.lit(1.5)).alias("o_totalprice"))


LOG_SQL = """log AS (
  SELECT 0::BIGINT AS _batch, event_id::BIGINT AS _pos, event_id::BIGINT AS _tx,
         CASE WHEN event_type = 'error' THEN 'D' ELSE 'R' END AS _op,
         CAST(user_id AS VARCHAR) AS id, event_type, value::DOUBLE AS value FROM events
), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY _pos DESC) = 1)"""
ORDERS_SQL = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders)"
CUSTOMERS_SQL = "c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_mktsegment, c_acctbal::DOUBLE AS c_acctbal FROM customer)"
BATCH_SQL = f"""{ORDERS_SQL}, b AS (
  SELECT CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN id ELSE 'n' || id END AS id, o_custkey, 'X' AS o_orderstatus, o_totalprice FROM o)"""
PATCH_SQL = f"""{ORDERS_SQL}, p AS (
  SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'P' END AS o_orderstatus, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 1.5::DOUBLE END AS o_totalprice FROM o)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- live state ------------------------------------------------------------------------


@query(f"WITH {LOG_SQL} SELECT id, event_type, value, _tx FROM last WHERE _op = 'R'")
def live_state(spark, sf):
    return live.live_state(event_log(spark, sf)).select("id", "event_type", "value", "_tx")


@query(f"WITH {LOG_SQL} SELECT id, event_type, value FROM last WHERE _op = 'R'")
def live_state_wide(spark, sf):
    return live.live_state_wide(event_log(spark, sf)).select("id", "event_type", "value")


@query(f"WITH {LOG_SQL} SELECT count(*) AS n FROM last WHERE _op = 'R'")
def live_count(spark, sf):
    return read.count(live.live_state(event_log(spark, sf)))


@query(f"WITH {LOG_SQL} SELECT id FROM last WHERE _op = 'D'")
def deleted_ids(spark, sf):
    return live.deleted_ids(event_log(spark, sf))


@query(f"WITH {LOG_SQL} SELECT id, _tx, _op, row_number() OVER w AS version, lead(1) OVER w IS NULL AS is_last FROM log WINDOW w AS (PARTITION BY id ORDER BY _pos)")
def version_history(spark, sf):
    return live.history(event_log(spark, sf)).select("id", "_tx", "_op", "version", "is_last")


@query(f"WITH {LOG_SQL} SELECT id, event_type, value FROM last WHERE _op = 'R'")
def incremental_apply(spark, sf):
    """Snapshot of the first half of the log, then the second half."""
    log = event_log(spark, sf)
    cols = ["id", "event_type", "value"]
    cut = log.agg(F.max("_pos")).first()[0] // 2
    return live.apply_log(live.live_state(log.filter(F.col("_pos") < cut)).select(*cols), log.filter(F.col("_pos") >= cut))


@query("SELECT max(event_id)::BIGINT AS max_tx, max(event_id)::BIGINT + 1 AS next_tx FROM events")
def next_tx(spark, sf):
    log = event_log(spark, sf)
    top = live.max_tx(log.filter("_pos % 2 = 0"), log.filter("_pos % 2 = 1"))
    return spark.createDataFrame([(top, top + 1)], "max_tx long, next_tx long")


# -- reads -----------------------------------------------------------------------------


@query(f"WITH {ORDERS_SQL} SELECT * FROM o WHERE id = '777'")
def get_by_id(spark, sf):
    return read.get(orders(spark, sf), ORDERS, "id", "777")


@query(f"WITH {CUSTOMERS_SQL} SELECT * FROM c WHERE c_name = (SELECT min(c_name) FROM c)")
def get_unique(spark, sf):
    c = customers(spark, sf)
    return read.get(c, CUSTOMERS, "c_name", c.agg(F.min("c_name")).first()[0])


@query(f"WITH {ORDERS_SQL} SELECT * FROM o WHERE o_custkey = 7")
def find_many(spark, sf):
    return read.find(orders(spark, sf), ORDERS, "o_custkey", "7")


@query(f"WITH {ORDERS_SQL} SELECT * FROM o WHERE o_orderstatus = 'F' ORDER BY id LIMIT 50 OFFSET 100")
def find_page(spark, sf):
    return read.page(read.find(orders(spark, sf), ORDERS, "o_orderstatus", "F"), 50, "100")


@query(f"WITH {ORDERS_SQL} SELECT * FROM o ORDER BY id LIMIT 100")
def scan_page_first(spark, sf):
    return read.page(orders(spark, sf))


@query(f"WITH {ORDERS_SQL} SELECT * FROM o ORDER BY id LIMIT 100 OFFSET 900")
def scan_page_later(spark, sf):
    return read.page(orders(spark, sf), 100, "900")


@query(f"WITH {ORDERS_SQL} SELECT * FROM o WHERE id > '1234' ORDER BY id LIMIT 100")
def scan_page_after_key(spark, sf):
    return read.page_after(orders(spark, sf), "1234", 100)


@query(f"WITH {ORDERS_SQL} SELECT CASE WHEN 900 + 100 < count(*) THEN '1000' END AS next_cursor, count(*) AS total FROM o")
def page_cursor(spark, sf):
    n = read.count(orders(spark, sf)).first()["n"]
    return spark.createDataFrame([(read.next_cursor(read.checked_cursor("900"), read.checked_limit(None), n), n)], "next_cursor string, total long")


@query(f"WITH {ORDERS_SQL} SELECT * FROM o ORDER BY id")
def read_table(spark, sf):
    return read.scan(orders(spark, sf))


@query(f"WITH {ORDERS_SQL} SELECT count(*) AS n FROM o WHERE o_orderstatus = 'O'")
def count_lookup(spark, sf):
    return read.count(orders(spark, sf), ORDERS, "o_orderstatus", "O")


@query(f"WITH {ORDERS_SQL} SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM o GROUP BY 1")
def lookup_cardinality(spark, sf):
    return read.cardinality(orders(spark, sf), ORDERS, "o_custkey")


@query(f"WITH {ORDERS_SQL} SELECT * FROM o WHERE o_custkey >= 10 AND o_custkey < 40")
def range_lookup(spark, sf):
    return read.between(orders(spark, sf), ORDERS, "o_custkey", gte=10, lt=40)


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderdate, CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderdate DESC, id LIMIT 200")
def recent_first(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderdate", F.col("o_orderkey").cast("string").alias("id"))
    return read.top(o, 200, F.desc("o_orderdate"))


@query("SELECT conv_id::VARCHAR AS conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) ORDER BY turn LIMIT 5")
def conversation_thread(spark, sf):
    c = _read(spark, sf, "conversations")
    first = c.agg(F.min("conv_id").alias("conv_id"))
    rows = c.join(first, "conv_id", "left_semi").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return read.top(rows, 5, "turn").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")


@query(f"WITH {CUSTOMERS_SQL}, {ORDERS_SQL} SELECT o.id, o.o_totalprice, c.c_name FROM o JOIN c ON CAST(o.o_custkey AS VARCHAR) = c.id")
def parent_children(spark, sf):
    o = orders(spark, sf).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return read.children(customers(spark, sf), o, "o_custkey").select("id", "o_totalprice", "c_name")


# -- indexes and constraints -----------------------------------------------------------


@query(f"""WITH {CUSTOMERS_SQL} SELECT 'id' AS field, id AS key, id FROM c UNION ALL SELECT 'c_name', c_name, id FROM c UNION ALL SELECT 'c_mktsegment', c_mktsegment, id FROM c""")
def lookup_index(spark, sf):
    return live.index_entries(customers(spark, sf), CUSTOMERS).orderBy("field", "key", "id")


@query(f"WITH {CUSTOMERS_SQL} SELECT field, key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'id' AS field, id AS key, id FROM c UNION ALL SELECT 'c_name', c_name, id FROM c UNION ALL SELECT 'c_mktsegment', c_mktsegment, id FROM c) GROUP BY field, key")
def inverted_index(spark, sf):
    i = live.inverted_index(customers(spark, sf), CUSTOMERS)
    return i.select("field", "key", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"))


@query(f"WITH {CUSTOMERS_SQL} SELECT 'c_mktsegment' AS field, c_mktsegment AS key, count(DISTINCT id) AS n FROM c GROUP BY c_mktsegment HAVING count(DISTINCT id) > 1")
def unique_violations(spark, sf):
    strict = Table("customers", CUSTOMERS.fields, (type(CUSTOMERS.lookups[0])("c_mktsegment", True),))
    return live.unique_violations(customers(spark, sf), strict)


@query(f"WITH {BATCH_SQL} SELECT b.* FROM b SEMI JOIN o ON b.id = o.id")
def insert_conflicts(spark, sf):
    return mutate.insert_conflicts(order_batch(spark, sf), orders(spark, sf))


@query(f"""WITH {CUSTOMERS_SQL}, b AS (SELECT 'n' || id AS id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN c_name ELSE c_name || 'x' END AS c_name FROM c)
SELECT 'c_name' AS field, b.c_name AS key, b.id FROM b JOIN c ON b.c_name = c.c_name AND b.id <> c.id""")
def unique_conflicts(spark, sf):
    c = customers(spark, sf)
    k = F.col("id").cast("long")
    b = c.withColumn("c_name", F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("x")))).withColumn("id", F.concat(F.lit("n"), "id"))
    return mutate.unique_conflicts(b, c, CUSTOMERS)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def batch_repeats(spark, sf):
    return mutate.repeated_ids(_read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")))


# -- changes ---------------------------------------------------------------------------


@query(f"WITH {BATCH_SQL} SELECT * FROM o WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b")
def upsert_merge(spark, sf):
    return mutate.upsert(orders(spark, sf), order_batch(spark, sf))


@query(f"WITH {PATCH_SQL} SELECT o.id, o.o_custkey, coalesce(p.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(p.o_totalprice, o.o_totalprice) AS o_totalprice FROM o LEFT JOIN p ON o.id = p.id")
def patch_merge(spark, sf):
    return mutate.patch(orders(spark, sf), order_patches(spark, sf), ORDERS)


@query(f"WITH {PATCH_SQL} SELECT o.id, o.o_custkey, coalesce(p.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(p.o_totalprice, o.o_totalprice) AS o_totalprice FROM o JOIN p ON o.id = p.id")
def patched_rows(spark, sf):
    return mutate.patched(orders(spark, sf), order_patches(spark, sf), ORDERS)


@query(f"WITH {ORDERS_SQL} SELECT * FROM o WHERE o_orderstatus <> 'F'")
def remove_merge(spark, sf):
    o = orders(spark, sf)
    return mutate.remove(o, o.filter("o_orderstatus = 'F'"))


@query(f"WITH {BATCH_SQL} SELECT b.id FROM b ANTI JOIN o ON b.id = o.id")
def missing_rows(spark, sf):
    return mutate.missing(order_batch(spark, sf), orders(spark, sf)).select("id")


@query(f"WITH {CUSTOMERS_SQL}, b AS (SELECT CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN c_name || '?' ELSE c_name END AS c_name FROM c) SELECT b.c_name, c.id FROM b LEFT JOIN c ON b.c_name = c.c_name")
def resolve_by_lookup(spark, sf):
    c = customers(spark, sf)
    b = c.select(F.when(F.col("id").cast("long") % 4 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name")).alias("c_name"))
    return mutate.resolve(b, c, "c_name")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS _seq, (row_number() OVER (ORDER BY o_orderkey) + 999)::BIGINT AS _tx FROM orders")
def batch_tx_assign(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    return mutate.assign_tx(mutate.sequence(o, "o_orderkey"), 1000).select("id", "_seq", "_tx")


@query(f"WITH {ORDERS_SQL} SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS _pos, (row_number() OVER (ORDER BY id) + 26)::BIGINT AS _tx, 'R' AS _op FROM o")
def compact_renumber(spark, sf):
    return live.compacted(orders(spark, sf), 27).select("id", "_pos", "_tx", "_op")


# -- text formats ----------------------------------------------------------------------

_ESC = lambda c: f"replace(replace(replace(replace({c}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"
NOTES = table("notes", "id: id", "role: text", "body: text", "turn: int")


def notes(spark, sf):
    c = _read(spark, sf, "conversations")
    return c.select(
        F.lit(0).cast("long").alias("_batch"), F.col("turn").cast("long").alias("_pos"), (F.col("turn") + 1).cast("long").alias("_tx"),
        F.when(F.col("turn") % 5 == 4, "D").otherwise("R").alias("_op"),
        F.concat_ws(":", "conv_id", "turn").alias("id"), "role", F.concat(F.lit("\\\t\r\n"), "text").alias("body"), F.col("turn").cast("long").alias("turn"),
    )


@query(f"""SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 5 = 4 THEN 'D' || chr(9) || (turn + 1) || chr(9) || conv_id || ':' || turn
ELSE 'R' || chr(9) || (turn + 1) || chr(9) || conv_id || ':' || turn || chr(9) || {_ESC('role')} || chr(9) || {_ESC("chr(92) || chr(9) || chr(13) || chr(10) || text")} || chr(9) || turn END AS line FROM conversations""")
def segment_encode(spark, sf):
    return segment.encode(notes(spark, sf), NOTES).select("id", "line")


@query(f"""WITH l AS (SELECT turn, CASE WHEN turn % 5 = 4 THEN 'D' || chr(9) || (turn + 1) || chr(9) || conv_id || ':' || turn
ELSE 'R' || chr(9) || (turn + 1) || chr(9) || conv_id || ':' || turn || chr(9) || {_ESC('role')} || chr(9) || {_ESC("chr(92) || chr(9) || chr(13) || chr(10) || text")} || chr(9) || turn END AS line FROM conversations)
SELECT count(*) AS operations, count(*) FILTER (turn % 5 <> 4) AS puts, count(*) FILTER (turn % 5 = 4) AS tombstones, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes, count(DISTINCT turn) AS chunks FROM l""")
def log_statistics(spark, sf):
    """Bytes and chunks of a log as its segments hold them; a batch of turns each, a chunk of a batch each."""
    log = notes(spark, sf)
    log = log.withColumn("_batch", F.regexp_extract("id", "[0-9]+$", 0).cast("long"))
    placed = segment.chunked(log, NOTES, 1)
    return report.log_statistics(placed.withColumn("_op", F.substring("line", 1, 1)).withColumn("_bytes", F.octet_length("line") + 1).withColumnRenamed("_chunk_no", "_chunk"))


@query("""SELECT conv_id || ':' || turn AS id, (turn + 1)::BIGINT AS _tx, CASE WHEN turn % 5 = 4 THEN 'D' ELSE 'R' END AS _op,
CASE WHEN turn % 5 <> 4 THEN role END AS role, CASE WHEN turn % 5 <> 4 THEN chr(92) || chr(9) || chr(13) || chr(10) || text END AS body, CASE WHEN turn % 5 <> 4 THEN turn::BIGINT END AS turn FROM conversations""")
def segment_decode(spark, sf):
    lines = segment.encode(notes(spark, sf), NOTES).select(F.lit("zzz").alias("_chunk"), F.col("_pos").cast("int").alias("_pos"), "line")
    return segment.decode(lines, NOTES).select("id", "_tx", "_op", "role", "body", "turn")


@query("""WITH k AS (SELECT o_orderkey % 46656 AS k FROM orders), d AS (SELECT k, 46655 - k AS r FROM k)
SELECT k::BIGINT AS k, substr('0123456789abcdefghijklmnopqrstuvwxyz', (r // 1296 + 1)::INT, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', ((r // 36) % 36 + 1)::INT, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', (r % 36 + 1)::INT, 1) AS name, k::BIGINT AS back FROM d""")
def chunk_name(spark, sf):
    k = _read(spark, sf, "orders").select((F.col("o_orderkey") % 46656).cast("long").alias("k"))
    named = k.withColumn("name", fn.chunk_name(F.col("k")))
    return named.withColumn("back", fn.chunk_number(F.col("name")))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN trim(o_orderstatus) = 'F' THEN 'closed' ELSE trim(o_orderstatus) END AS cleaned FROM orders")
def clean_text(spark, sf):
    o = _read(spark, sf, "orders")
    padded = F.when(F.col("o_orderstatus") == "F", F.lit(" \t\n")).otherwise(F.concat(F.lit("\t "), "o_orderstatus", F.lit("\n")))
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), fn.clean_text(padded, "closed").alias("cleaned"))


@query("""SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN right(t, 2) = '.0' THEN left(t, length(t) - 2) ELSE t END AS price FROM (SELECT p_partkey, CAST(p_retailprice::DOUBLE AS VARCHAR) AS t FROM part)""")
def float_key_text(spark, sf):
    return _read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), fn.float_column_text(F.col("p_retailprice").cast("double")).alias("price"))


@query("SELECT conv_id || ':' || turn AS id, (turn + 1)::BIGINT AS _tx, CASE WHEN turn % 5 = 4 THEN 'D' ELSE 'R' END AS _op, role, chr(92) || chr(9) || chr(13) || chr(10) || text AS body, turn::BIGINT AS turn FROM conversations")
def json_log_round_trip(spark, sf):
    lines = jsonl.encode(notes(spark, sf), NOTES, F.lit(5).cast("long")).select("line")
    return jsonl.decode(lines, NOTES).select("id", "_tx", "_op", "role", "body", "turn")


@query("SELECT c.cid, m.turn::BIGINT AS turn, m.role, m.text FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS cid FROM (SELECT DISTINCT conv_id FROM conversations)) c JOIN conversations m ON m.conv_id = c.conv_id")
def pack_round_trip(spark, sf):
    """Conversations to pack blocks and back."""
    c = _read(spark, sf, "conversations")
    ids = live.numbered(c.select("conv_id").distinct(), "conv_id", "cid").withColumn("cid", F.col("cid") + 1)
    said = c.join(ids, "conv_id").select("cid", F.col("turn").cast("long").alias("turn"), "role", "text")
    heads = ids.select("cid", *[F.lit(0).cast("long").alias(x) for x in ("source_id", "domain_id", "flags")])
    blocks = pack.encode(heads, said)
    lines = blocks.select(F.col("cid").cast("string").alias("_file"), F.posexplode(F.split("block", "\n", -1)).alias("_pos", "line"))
    return pack.messages(pack.records(lines))


@query("""SELECT conv_id, kind, coalesce(turn, 0)::BIGINT AS turn, value FROM (
SELECT conv_id, 'tag' AS kind, NULL AS turn, CAST(turn AS VARCHAR) AS value FROM conversations WHERE turn < 2
UNION ALL SELECT conv_id, 'property', turn, role FROM conversations WHERE turn < 3 AND turn <> 1
UNION ALL SELECT conv_id, 'property', turn, 'changed' FROM conversations WHERE turn = 1
UNION ALL SELECT conv_id, 'call', turn, text FROM conversations WHERE turn = 1
UNION ALL SELECT conv_id, 'result', turn, text FROM conversations WHERE turn = 2) t
WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) AND NOT (kind = 'property' AND conv_id = (SELECT min(conv_id) FROM conversations))""")
def pack_records(spark, sf):
    """Tags, properties, calls and results written to pack files, updated, and read back."""
    c = _read(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("long"))
    ids = live.numbered(c.filter("turn = 0").select("conv_id").distinct(), "conv_id", "cid")
    said = c.join(ids, "conv_id")
    first = c.agg(F.min("conv_id").alias("conv_id"))
    folder = scratch(spark, "packs")
    pack.write(
        ids.select("cid", *[F.lit(0).cast("long").alias(x) for x in ("source_id", "domain_id", "flags")]), said.select("cid", "turn", "role", "text"), folder, {"role": {"u": "user"}},
        tagged=said.filter("turn < 2").select("cid", F.col("turn").alias("tag_id")),
        props=said.filter("turn < 3").select("cid", F.col("turn").cast("string").alias("key"), F.col("role").alias("value")),
        called=said.filter("turn = 1").select("cid", "turn", F.lit(0).cast("long").alias("call"), F.lit(7).cast("long").alias("tool_id"), F.col("text").alias("args")),
        told=said.filter("turn = 2").select("cid", "turn", F.lit(0).cast("long").alias("call"), "text"),
    )
    gone = ids.join(first, "conv_id", "left_semi").select("cid")
    pack.write_updates(folder, said.filter("turn = 1").join(gone, "cid", "left_anti").select("cid", F.lit("P.1").alias("path"), F.lit("changed").alias("value")), gone)
    r = pack.records(pack.lines(spark, folder))
    _, props = pack.with_updates(r)
    none = F.lit(0).cast("long")
    found = (
        pack.tags(r).select("cid", F.lit("tag").alias("kind"), none.alias("turn"), F.col("tag_id").cast("string").alias("value"))
        .unionByName(props.select("cid", F.lit("property").alias("kind"), F.col("key").cast("long").alias("turn"), "value"))
        .unionByName(pack.calls(r).select("cid", F.lit("call").alias("kind"), "turn", F.col("args").alias("value")))
        .unionByName(pack.results(r).select("cid", F.lit("result").alias("kind"), "turn", F.col("text").alias("value")))
    )
    return found.join(ids, "cid").select("conv_id", "kind", "turn", "value")


# -- reports and search ----------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def report_by_day(spark, sf):
    return report.per_day(_read(spark, sf, "events"), "ts", total=F.col("value")).withColumn("total", F.round("total", 3))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def report_by_kind(spark, sf):
    return report.per_key(_read(spark, sf, "events"), "event_type", total=F.col("value")).withColumn("total", F.round("total", 3))


@query("SELECT (floor(octet_length(encode(html)) / 500.0) * 500)::DOUBLE AS bucket, count(*) AS n FROM pages GROUP BY 1")
def report_distribution(spark, sf):
    return report.distribution(_read(spark, sf, "pages"), F.octet_length("html"), 500)


TERMS_SQL = "t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), i AS (SELECT term, id, count(*) AS n FROM t GROUP BY 1, 2)"


@query(f"WITH {TERMS_SQL} SELECT * FROM i")
def text_index(spark, sf):
    return search.terms(_read(spark, sf, "documents"), "text", "doc_id")


@query(f"WITH {TERMS_SQL} SELECT term, count(*) AS documents, sum(n)::BIGINT AS occurrences FROM i GROUP BY term")
def text_dictionary(spark, sf):
    return search.dictionary(search.terms(_read(spark, sf, "documents"), "text", "doc_id"))


@query(f"WITH {TERMS_SQL} SELECT id, sum(n)::BIGINT AS score FROM i WHERE term IN ('the', 'that') GROUP BY id HAVING count(*) = 2")
def text_search(spark, sf):
    return search.search(search.terms(_read(spark, sf, "documents"), "text", "doc_id"), "The that")


@query(f"WITH {TERMS_SQL} SELECT id, sum(n)::BIGINT AS score FROM i WHERE term IN ('the', 'that') GROUP BY id HAVING count(*) = 2")
def stored_text_search(spark, sf):
    """The same from an index that is stored and read back."""
    folder = scratch(spark, "index")
    search.store(search.terms(_read(spark, sf, "documents"), "text", "doc_id"), folder)
    return search.search(search.load(spark, folder), "The that")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'License')")
def substring_search(spark, sf):
    return read.contains(_read(spark, sf, "documents"), "text", "License").select("doc_id", "source")


@query("""SELECT event_type, count(*) AS rows, round(sum(value), 3) AS total FROM (SELECT event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, value FROM events WHERE event_id % 2 = 1) GROUP BY 1""")
def concat_segments(spark, sf):
    log = event_log(spark, sf)
    both = live.concat_logs(log.filter("_pos % 2 = 0"), log.filter("_pos % 2 = 1"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 3).alias("total"))



# -- storage and streams ---------------------------------------------------------------


def _database(spark: SparkSession, *tables: Table) -> Database:
    return Database(spark, scratch(spark, "db"), "main", DatabaseSchema.of(*tables)).init()


@query(f"WITH {CUSTOMERS_SQL} SELECT * FROM c")
def database_bulk_insert(spark, sf):
    """A table of any size as one batch, read back from the log."""
    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    return db.live("customers")


@query(f"""WITH {CUSTOMERS_SQL} SELECT id, c_name, CASE WHEN id = '1' THEN 'PATCHED' WHEN id = '2' THEN 'SET' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN id = '2' THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM c WHERE id <> '3'
UNION ALL SELECT 'new', 'new name', 'NEW', 1.5""")
def database_changes(spark, sf):
    """Insert, upsert, patch and remove through plans, over a snapshot."""
    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    db.refresh("customers")
    second = db.get(selector.id("customers", "2")).asDict()
    db.write(change.add("customers", {"id": "new", "c_name": "new name", "c_mktsegment": "NEW", "c_acctbal": 1.5}))
    db.write_many([change.edit_id("customers", "1", {"c_mktsegment": "PATCHED"}), change.set("customers", second | {"c_mktsegment": "SET", "c_acctbal": 0.5}), change.remove_id("customers", "3")])
    return db.live("customers")


@query(f"""WITH {CUSTOMERS_SQL} SELECT id, c_name, c_mktsegment, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM c WHERE CAST(id AS BIGINT) % 7 <> 0""")
def database_frames(spark, sf):
    """Patches and removes as DataFrames of any size."""
    db = _database(spark, CUSTOMERS)
    c = customers(spark, sf)
    db.append_frame("customers", c)
    k = F.col("id").cast("long")
    db.patch_frame("customers", c.filter(k % 3 == 0).select("id", F.lit(0.5).alias("c_acctbal")))
    db.remove_frame("customers", c.filter(k % 7 == 0))
    return db.live("customers")


@query(f"""WITH {CUSTOMERS_SQL} SELECT id, c_name, CASE WHEN CAST(id AS BIGINT) BETWEEN 1 AND 40 AND CAST(id AS BIGINT) % 2 = 0 THEN 'BY NAME' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN CAST(id AS BIGINT) BETWEEN 1 AND 40 AND CAST(id AS BIGINT) % 2 = 1 THEN 0.25 ELSE c_acctbal END AS c_acctbal FROM c WHERE CAST(id AS BIGINT) NOT BETWEEN 41 AND 60""")
def database_write_many(spark, sf):
    """Sixty patches and removes, by id and by a unique lookup, as one batch; then batches until a snapshot is due."""
    db = _database(spark, CUSTOMERS)
    db.snapshot_every = 3
    db.append_frame("customers", customers(spark, sf))
    names = {r["id"]: r["c_name"] for r in db.live("customers").filter(F.col("id").cast("long") <= 60).collect()}
    db.write_many(
        [change.edit("customers", "c_name", names[str(i)], {"c_mktsegment": "BY NAME"}) if i % 2 == 0 else change.edit_id("customers", str(i), {"c_acctbal": 0.25}) for i in range(1, 41)]
        + [change.remove("customers", "c_name", names[str(i)]) if i % 2 == 0 else change.remove_id("customers", str(i)) for i in range(41, 61)]
    )
    row = db.get(selector.id("customers", "1")).asDict()
    db.write(change.set("customers", row))
    assert db.manifest()["tables"]["customers"]["snapshot"] is not None
    return db.live("customers")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, c_name, ((row_number() OVER (ORDER BY id) - 1) // 40)::BIGINT AS page FROM c ORDER BY id LIMIT 120")
def database_pages(spark, sf):
    """Three pages by key, each from where the last one ended."""
    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    rows, after = [], None
    for n in range(3):
        page = db.get(selector.all("customers").limit(40).after(after))
        rows += [(r["id"], r["c_name"], n) for r in page.rows]
        after = page.next_after
        if after is None:
            break
    return spark.createDataFrame(rows, "id string, c_name string, page long")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, 'now' AS what FROM c WHERE c_mktsegment = 'BUILDING' AND CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT id, 'left' FROM c WHERE c_mktsegment = 'BUILDING' AND CAST(id AS BIGINT) % 2 = 1")
def database_watch(spark, sf):
    """What a subscription to one market segment delivers when half of its rows move away and half change."""
    db = _database(spark, CUSTOMERS)
    c = customers(spark, sf)
    db.append_frame("customers", c)
    out, checkpoint = scratch(spark, "told"), scratch(spark, "check")

    def deliver(rows, left, revision):
        told = rows.select("id", F.lit("now").alias("what")).unionByName(left.select("id", F.lit("left").alias("what")))
        told.withColumn("revision", F.lit(revision)).write.mode("append").parquet(out)

    watching = selector.many("customers", "c_mktsegment", "BUILDING")
    db.watch(watching, deliver, checkpoint, once=True).awaitTermination()
    first = db.revision
    odd = F.col("id").cast("long") % 2 == 1
    db.patch_frame("customers", c.select("id", F.when(odd, F.lit("AWAY")).alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal")))
    db.watch(watching, deliver, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(out).filter(F.col("revision") > first).select("id", "what")


@query("SELECT conv_id || ':' || turn AS id, (turn + 1)::BIGINT AS _tx FROM conversations WHERE NOT (conv_id = (SELECT max(conv_id) FROM conversations) AND turn = (SELECT max(turn) FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)))")
def segment_repair(spark, sf):
    """Segments whose last line is torn, mended in place."""
    folder = scratch(spark, "torn")
    c = notes(spark, sf)
    end = _read(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(1).select("id")
    segment.export(c.join(end, "id", "left_anti"), NOTES, "h", folder)
    Files(spark, folder).create(f"{folder}/zzy.6", (segment.preamble(NOTES, "h") + "R\t9\tlast").encode())
    segment.repair_files(spark, folder, NOTES)
    return segment.load(spark, folder, NOTES).select("id", "_tx")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, c_name, (row_number() OVER (ORDER BY id) + count(*) OVER ())::BIGINT AS _tx FROM c")
def database_compaction(spark, sf):
    """The log after compaction: rows by id, numbers from where the old log ended."""
    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    db.compact("customers")
    return db.log("customers").select("id", "c_name", "_tx")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, c_name, c_mktsegment, c_acctbal, 'US-1' AS region FROM c")
def database_add_field(spark, sf):
    from .schema import Field

    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    return db.add_field("customers", Field("region", "text"), "US-1", unique=False).live("customers")


@query("""SELECT conv_id || ':' || turn AS id, (turn + 1)::BIGINT AS _tx, CASE WHEN turn % 5 = 4 THEN 'D' ELSE 'R' END AS _op,
CASE WHEN turn % 5 <> 4 THEN role END AS role, CASE WHEN turn % 5 <> 4 THEN chr(92) || chr(9) || chr(13) || chr(10) || text END AS body, CASE WHEN turn % 5 <> 4 THEN turn::BIGINT END AS turn FROM conversations""")
def segment_files(spark, sf):
    """A log written as segment files and scanned back."""
    folder = scratch(spark, "segments")
    segment.export(notes(spark, sf), NOTES, DatabaseSchema.of(NOTES).hash(), folder)
    return segment.load(spark, folder, NOTES).select("id", "_tx", "_op", "role", "body", "turn")


@query(f"WITH {LOG_SQL} SELECT id, _op, event_type, value FROM last")
def watch_states(spark, sf):
    """The last operation per id from streaming state, after the log has run through."""
    from .streaming import watch

    folder, out = scratch(spark, "stream"), scratch(spark, "states")
    event_log(spark, sf).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    changed = watch.states(watch.log_stream(spark, folder, schema), EVENTS)
    q = changed.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "check")).foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return live.last_operations(spark.read.parquet(out)).select("id", "_op", "event_type", "value")


@query(f"WITH {LOG_SQL} SELECT id, event_type = 'click' AND _op = 'R' AS answers FROM last")
def watch_selector(spark, sf):
    """Which touched ids answer a selector now."""
    from .streaming import watch

    last = live.last_operations(event_log(spark, sf))
    return watch.selected(last, EVENTS, selector.many("events", "event_type", "click").into_plan()).select("id", F.col("_in").alias("answers"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, sf):
    """Counts per hour and kind from a stream with a watermark, run through once."""
    from .streaming import watch

    out = scratch(spark, "windows")
    folder = scratch(spark, "events")
    _read(spark, sf, "events").write.parquet(folder)
    e = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = watch.counts_per_window(e, "ts", "1 hour", "1 hour", "event_type")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "check")).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/last")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/last").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# -- the interface ---------------------------------------------------------------------

SCHEMA_TEXT = """schema! {
  users { id id; name text; email text; is_ai_user bool; lookup email unique; }
  chats { id id; owner_id id; title text; created_at int; score float; lookup owner_id; lookup created_at; }
}"""


@query("""SELECT * FROM (VALUES
('chats', 0, 'id', 'id', 'unique'), ('chats', 1, 'owner_id', 'id', 'many'), ('chats', 2, 'title', 'text', NULL), ('chats', 3, 'created_at', 'int', 'many'), ('chats', 4, 'score', 'float', NULL),
('users', 0, 'id', 'id', 'unique'), ('users', 1, 'name', 'text', NULL), ('users', 2, 'email', 'text', 'unique'), ('users', 3, 'is_ai_user', 'bool', NULL)) t(name, place, field, kind, lookup)""")
def schema_text(spark, sf):
    """Tables, fields and lookups of a compiled schema text."""
    from .ddl import compile_schema

    rows = []
    for t in compile_schema(SCHEMA_TEXT).tables.values():
        lookups = {x.field: "unique" if x.unique else "many" for x in t.all_lookups}
        rows += [(t.name, i, f.name, f.kind, lookups.get(f.name)) for i, f in enumerate(t.fields)]
    return spark.createDataFrame(rows, "name string, place int, field string, kind string, lookup string")


@query("""SELECT r_name AS text, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(r_name) + 1), lambda i: ord(r_name[i])::UHUGEINT)),
lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS hash FROM region""")
def text_hash(spark, sf):
    """64-bit FNV-1a of the region names."""
    from .functions.hashing import fnv1a64

    names = [r["r_name"] for r in _read(spark, sf, "region").collect()]
    return spark.createDataFrame([(n, str(fnv1a64(n.encode()))) for n in names], "text string, hash string")


@query("""SELECT * FROM (VALUES (0, 'SIX' || chr(9) || '1' || chr(9) || 'table' || chr(9) || 'notes' || chr(9) || 'h'), (1, '@field' || chr(9) || 'id' || chr(9) || 'id'), (2, '@field' || chr(9) || 'role' || chr(9) || 'text'),
(3, '@field' || chr(9) || 'body' || chr(9) || 'text'), (4, '@field' || chr(9) || 'turn' || chr(9) || 'int'), (5, '@lookup' || chr(9) || 'id' || chr(9) || 'unique'), (6, '@data'),
(7, 'id' || chr(9) || 'role' || chr(9) || 'body' || chr(9) || 'turn')) t(place, line)""")
def segment_preamble(spark, sf):
    """The lines a segment starts with, and the header of the older form."""
    lines = [*segment.preamble(NOTES, "h").splitlines(), segment.header(NOTES)]
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, c_name, CASE WHEN id = '5' THEN 'APPLIED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM c WHERE id NOT IN ('3', '4')")
def database_delete(spark, sf):
    """Tombstones, also of a row that never was, and records put and deleted as operations."""
    db = _database(spark, CUSTOMERS)
    c = customers(spark, sf)
    db.append_frame("customers", c)
    db.delete("customers", "3")
    db.delete("customers", "never")
    rows = {r["id"]: r.asDict() for r in c.filter("id IN ('4', '5')").collect()}
    db.apply("delete", "customers", rows["4"])
    db.apply("put", "customers", rows["5"] | {"c_mktsegment": "APPLIED"})
    return db.live("customers")


@query(f"WITH {CUSTOMERS_SQL}, {ORDERS_SQL} SELECT 'customers' AS name, count(*) + 1 AS n FROM c UNION ALL SELECT 'orders', count(*) - 1 FROM o")
def database_several_tables(spark, sf):
    """Changes of two tables in one commit."""
    db = _database(spark, CUSTOMERS, ORDERS)
    db.append_frame("customers", customers(spark, sf))
    db.append_frame("orders", orders(spark, sf))
    before = db.revision
    some = db.scan("orders", 1).rows[0]["id"]
    db.apply_changes([change.add("customers", {"id": "x", "c_name": "x", "c_mktsegment": "X", "c_acctbal": 0.0}), change.remove_id("orders", some)])
    assert db.revision == before + 1
    return spark.createDataFrame([(t, db.count(t)) for t in ("customers", "orders")], "name string, n long")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, c_name, c_mktsegment, c_acctbal FROM c WHERE id <> '7'")
def database_rebuild(spark, sf):
    """A snapshot computed from the whole log, exported as Parquet and read back."""
    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    db.write(change.remove_id("customers", "7"))
    db.rebuild("customers")
    assert not db.refresh("customers")
    folder = scratch(spark, "export")
    db.export_snapshot("customers", folder)
    return spark.read.parquet(folder).select("id", "c_name", "c_mktsegment", "c_acctbal")


@query(f"WITH {CUSTOMERS_SQL} SELECT id, c_mktsegment, c_acctbal FROM c")
def database_drop_field(spark, sf):
    db = _database(spark, CUSTOMERS)
    db.append_frame("customers", customers(spark, sf))
    return db.drop_field("customers", "c_name").live("customers")


@query(f"""WITH {CUSTOMERS_SQL} SELECT 'one' AS what, id FROM c WHERE c_name = (SELECT min(c_name) FROM c) UNION ALL SELECT 'many', id FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM c WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'all', CAST(count(*) AS VARCHAR) FROM c
UNION ALL (SELECT 'page', id FROM c ORDER BY id LIMIT 5) UNION ALL (SELECT 'handle', id FROM c WHERE c_name = (SELECT max(c_name) FROM c)) UNION ALL SELECT 'json', id FROM c WHERE id = '2'""")
def database_requests(spark, sf):
    """Requests of every kind: by unique key, by lookup, counts, pages, handles, and a plan as JSON."""
    from .plans import Plan

    db = _database(spark, CUSTOMERS)
    c = customers(spark, sf)
    db.append_frame("customers", c)
    db.refresh("customers")
    low, high = c.agg(F.min("c_name"), F.max("c_name")).first()
    building, many, after = selector.many("customers", "c_mktsegment", "BUILDING").limit(1000), [], None
    while True:  # page by page, as a lookup may hold more rows than a request gives
        part = [r["id"] for r in db.get(building.after(after))]
        many += part
        if len(part) < 1000:
            break
        after = part[-1]
    told = [("one", db.get(selector.one("customers", "c_name", low))["id"]), *(("many", i) for i in many)]
    told += [("count", str(db.get(selector.count("customers").by("c_mktsegment", "BUILDING")))), ("all", str(db.get(selector.count("customers"))))]
    told += [("page", r["id"]) for r in db.get(selector.all("customers").limit(5)).rows]
    told += [("handle", db.customers.by.c_name(high)["id"])]
    told += [("json", r["id"]) for r in db.execute(Plan.from_json(selector.id("customers", "2").into_plan().to_json())).rows]
    return spark.createDataFrame(told, "what string, id string")


@query("SELECT 'put' AS what, 'a' AS id UNION ALL SELECT 'rejected', 'type' UNION ALL SELECT 'rejected', 'field' UNION ALL SELECT 'rejected', 'unique' UNION ALL SELECT 'rejected', 'lookup' UNION ALL SELECT 'rejected', 'reserved'")
def database_validation(spark, sf):
    """What record and schema checks refuse."""
    from .errors import StrandlogError
    from .schema import check_name

    db = _database(spark, CUSTOMERS)
    row = {"id": "a", "c_name": "n", "c_mktsegment": "s", "c_acctbal": 1.0}
    db.insert("customers", row)
    bad = {
        "type": lambda: db.upsert("customers", row | {"c_acctbal": "1"}), "field": lambda: db.upsert("customers", row | {"more": 1}), "unique": lambda: db.insert("customers", row | {"id": "b"}),
        "lookup": lambda: db.get(selector.many("customers", "c_acctbal", 1.0)), "reserved": lambda: check_name("_tx"),
    }
    told = [("put", r["id"]) for r in db.scan("customers").rows]
    for name, call in bad.items():
        try:
            call()
        except StrandlogError:
            told.append(("rejected", name))
    return spark.createDataFrame(told, "what string, id string")
