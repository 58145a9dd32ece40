"""A database: change logs in Parquet, versioned snapshots, one manifest per commit.

``<root>/<workspace>/`` holds ``manifest/<version>.json``, and per table folders below
``<table>/log`` and ``<table>/snapshot``. A commit writes its data first, each attempt to a folder
of its own that is never written again, and then creates the next manifest file, which must
not exist: that creation is the commit point and the writers' lock at once, on any file
system with exclusive creation. A writer that comes second deletes its own folder and
changes nothing. Readers use the newest manifest, so they never see half a commit; nothing
that a manifest has named goes before ``vacuum``, so lazy readers live through compaction.

A manifest tells each table's layout; a schema that differs is refused on open, before every
read and before every write. Snapshots follow the log by themselves: once enough batches
have come since the last one, the write that brings the next also writes a snapshot.

Reads come back as DataFrames over snapshot and later batches; everything row-sized runs
in Spark. Only requests of at most ``MAX_LIMIT`` rows collect anything.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidInput, Locked, NotFound, PlanError, SchemaError, StrandlogError
from .functions.text import key_text, value_text
from .operators import live as live_ops
from .operators import mutate, read, search
from .plans import Page, Plan, ReadRequest, WriteChange, WriteRequest
from .schema import DatabaseSchema, Field, Table, check_name
from .sources import segment
from .sources.files import Files

LOG = [T.StructField("_batch", T.LongType()), T.StructField("_pos", T.LongType()), T.StructField("_tx", T.LongType()), T.StructField("_op", T.StringType())]
#: Durability: what happens before a write returns. ``fast`` leaves the manifest to the file system's buffers,
#: ``safe`` syncs it, ``paranoid`` also reads the data back before the commit.
DURABILITY = ("fast", "safe", "paranoid")
#: A snapshot is due after so many batches, if they hold at least 1/SHARE of its bytes or are eight times as many.
SNAPSHOT_EVERY, SHARE = 16, 8
#: Hours for which ``vacuum`` leaves what readers may still hold.
READERS = 24.0


@dataclass(frozen=True)
class Appended:
    """What a write did."""

    table: str
    first_tx: int
    rows: int
    version: int

    @property
    def txs(self) -> range:
        return range(self.first_tx, self.first_tx + self.rows)


@dataclass(frozen=True)
class Compacted:
    table: str
    live_rows: int
    first_tx: int
    next_tx: int
    batches_before: int
    bytes_before: int
    bytes_after: int


class Database:
    """Tables of a schema in a workspace folder."""

    def __init__(self, spark: SparkSession, root: str, workspace: str = "main", schema: DatabaseSchema | None = None, durability: str = "safe", snapshot_every: int = SNAPSHOT_EVERY):
        if durability not in DURABILITY:
            raise InvalidInput(f"durability is one of {', '.join(DURABILITY)}")
        self.spark, self.workspace, self.schema, self.durability = spark, workspace, schema or DatabaseSchema(), durability
        self.snapshot_every = snapshot_every
        self.files = Files(spark, f"{root.rstrip('/')}/{workspace}")

    # -- manifest ------------------------------------------------------------------

    def manifest(self) -> dict[str, Any]:
        """The newest manifest; an empty one before ``init``."""
        names = [n for n in self.files.names(self.files.at("manifest")) if n.endswith(".json")]
        if not names:
            return {"version": 0, "next_tx": 1, "schema_hash": self.schema.hash(), "tables": {}}
        return json.loads(self.files.read(self.files.at("manifest", names[-1])))

    def manifest_of(self, version: int) -> dict[str, Any]:
        """The manifest of a version; an empty one where it is not kept."""
        path = self.files.at("manifest", f"{version:020d}.json")
        if not self.files.exists(path):
            return {"version": version, "next_tx": 1, "schema_hash": self.schema.hash(), "tables": {}}
        return json.loads(self.files.read(path))

    def _commit(self, old: dict[str, Any], new: dict[str, Any], *staged: str) -> dict[str, Any]:
        """Make ``new`` the next version; where another writer was first, drop ``staged`` and raise."""
        new = new | {"version": old["version"] + 1, "schema_hash": self.schema.hash()}
        if not self.files.create(self.files.at("manifest", f"{new['version']:020d}.json"), json.dumps(new, sort_keys=True).encode(), self.durability != "fast"):
            self._drop(*staged)
            raise Locked(f"version {new['version']} of {self.workspace!r} was written meanwhile")
        return new

    def _drop(self, *staged: str) -> None:
        for path in staged:
            self.files.delete(path)

    @contextlib.contextmanager
    def _attempt(self, *staged: str):
        """Folders of an attempt go if it fails before its commit."""
        try:
            yield
        except Exception:
            self._drop(*staged)
            raise

    def init(self) -> Database:
        """Create the folders and the first manifest, if there is none; refuse another layout."""
        self.files.make(self.files.at("manifest"))
        m = self.manifest()
        lacking = [t for t in self.schema.tables if t not in m["tables"]]
        for t in self.schema.tables:
            self._state(t, m)
        if m["version"] == 0 or lacking:
            self._commit(m, m | {"tables": m["tables"] | {t: self._empty(t) for t in lacking}})
        return self

    def _empty(self, table: str) -> dict[str, Any]:
        return {"batches": [], "next_batch": 0, "snapshot": None, "snapshot_batch": -1, "text": {}, "layout": self.schema.table(table).layout()}

    @property
    def revision(self) -> int:
        """Grows with every commit."""
        return self.manifest()["version"]

    # -- tables --------------------------------------------------------------------

    def _log_schema(self, t: Table) -> T.StructType:
        return T.StructType([*LOG, *(T.StructField(f.name, f.dataType) for f in t.struct())])

    def _state(self, table: str, m: dict[str, Any]) -> dict[str, Any]:
        layout = self.schema.table(table).layout()
        found = m["tables"].get(table)
        if found and found["layout"] != layout:
            raise SchemaError(f"{table!r} is stored as {found['layout']}, the schema says {layout}")
        return found or self._empty(table)

    def _path(self, table: str, number: int, kind: str = "log") -> str:
        """A folder for one attempt at a batch or snapshot; no other attempt has it."""
        return self.files.at(table, kind, f"{number:020d}-{uuid.uuid4().hex[:12]}")

    def _batch(self, number: int, path: str, rows: int, whole: bool = False) -> dict[str, Any]:
        """What a manifest tells of a batch; ``whole`` ones restate the table."""
        return {"n": number, "at": path.rsplit("/", 1)[1], "rows": rows, "bytes": self.files.size(path), "whole": whole}

    def _later(self, s: dict[str, Any]) -> list[dict[str, Any]]:
        return [b for b in s["batches"] if b["n"] > s["snapshot_batch"]]

    def log(self, table: str, since: int = -1, m: dict[str, Any] | None = None) -> DataFrame:
        """A table's operations after batch ``since``."""
        s = self._state(table, m or self.manifest())
        return self._batches(table, [b for b in s["batches"] if b["n"] > since])

    def _batches(self, table: str, batches: list[dict[str, Any]]) -> DataFrame:
        schema = self._log_schema(self.schema.table(table))
        paths = [self.files.at(table, "log", b["at"]) for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def statistics(self, table: str) -> dict[str, int]:
        """Rows, bytes and batches of a table's log, from the manifest."""
        batches = self._state(table, self.manifest())["batches"]
        return {"operations": sum(b["rows"] for b in batches), "bytes": sum(b["bytes"] for b in batches), "batches": len(batches)}

    def live(self, table: str, m: dict[str, Any] | None = None) -> DataFrame:
        """Current rows: the snapshot brought forward by the later batches."""
        m = m or self.manifest()
        t, s = self.schema.table(table), self._state(table, m)
        later = self.log(table, s["snapshot_batch"], m)
        if s["snapshot"] is None:
            return live_ops.live_state(later).select(*t.names)
        snapshot = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in t.struct()])).parquet(self.files.at(table, "snapshot", s["snapshot"]))
        if not self._later(s):
            return snapshot
        return live_ops.apply_log(snapshot, later)

    read_table = live

    def rebuild(self, table: str) -> None:
        """Recompute the snapshot from the whole log, checking unique lookups."""
        m = self.manifest()
        rows = live_ops.live_state(self.log(table, m=m)).select(*self.schema.table(table).names)
        self._snapshot(table, live_ops.check_unique(rows, self.schema.table(table)), m)

    def refresh(self, table: str) -> bool:
        """Write a snapshot if the log has moved on; whether one was written."""
        m = self.manifest()
        s = self._state(table, m)
        if s["snapshot"] is not None and not self._later(s):
            return False
        self._snapshot(table, live_ops.check_unique(self.live(table, m), self.schema.table(table)), m)
        return True

    def _snapshot(self, table: str, rows: DataFrame, m: dict[str, Any]) -> None:
        s = self._state(table, m)
        path = self._path(table, m["version"] + 1, "snapshot")
        lookups = [x.field for x in self.schema.table(table).all_lookups]
        writer = rows.repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.bloom.filter.adaptive.enabled", "true")
        for f in lookups:  # row groups that cannot hold a key are skipped
            writer = writer.option(f"parquet.bloom.filter.enabled#{f}", "true")
        with self._attempt(path):
            writer.parquet(path)
            state = s | {"snapshot": path.rsplit("/", 1)[1], "snapshot_bytes": self.files.size(path), "snapshot_batch": max((b["n"] for b in s["batches"]), default=-1)}
            self._commit(m, m | {"tables": m["tables"] | {table: state}}, path)

    def _keep_up(self, *tables: str) -> None:
        """Write the snapshots that are due. Another writer's commit in between leaves it to the next write."""
        m = self.manifest()
        for table in tables:
            s = self._state(table, m)
            later = self._later(s)
            heavy = SHARE * sum(b["bytes"] for b in later) >= s.get("snapshot_bytes", 0)
            if len(later) >= self.snapshot_every and (heavy or len(later) >= 8 * self.snapshot_every):
                with contextlib.suppress(Locked):
                    self.refresh(table)

    # -- writes --------------------------------------------------------------------

    def _stage(self, table: str, ops: DataFrame, rows: int, m: dict[str, Any]) -> tuple[dict[str, Any], str]:
        """Write operations (``_op``, ``_seq``, fields) as the table's next batch: the new manifest, the folder."""
        t, s = self.schema.table(table), self._state(table, m)
        batch = s["next_batch"]
        path = self._path(table, batch)
        out = mutate.assign_tx(ops, m["next_tx"]).select(F.lit(batch).cast("long").alias("_batch"), F.col("_seq").cast("long").alias("_pos"), "_tx", "_op", *t.names)
        with self._attempt(path):
            out.write.parquet(path)
            if self.durability == "paranoid":
                found = self.spark.read.schema(self._log_schema(t)).parquet(path).count()
                if found != rows:
                    raise StrandlogError(f"batch {batch} of {table} holds {found} of {rows} rows")
        new = s | {"batches": [*s["batches"], self._batch(batch, path, rows)], "next_batch": batch + 1}
        return m | {"next_tx": m["next_tx"] + rows, "tables": m["tables"] | {table: new}}, path

    def _frame(self, t: Table, ops: Sequence[tuple[str, dict[str, Any]]], places: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), *(T.StructField(f.name, f.dataType) for f in t.struct())])
        plain = lambda v: str(v) if isinstance(v, str) else v
        return self.spark.createDataFrame([(i, op, *(plain(r.get(n)) for n in t.names)) for i, (op, r) in zip(places or range(len(ops)), ops)], schema)

    def _put(self, table: str, ops: Sequence[tuple[str, dict[str, Any]]], insert_only: bool, m: dict[str, Any] | None = None) -> Appended:
        first = m or self.manifest()
        if not ops:
            return Appended(table, first["next_tx"], 0, first["version"])
        return self._append(table, self._frame(self.schema.table(table), ops), len(ops), insert_only, first)

    def _append(self, table: str, frame: DataFrame, rows: int, insert_only: bool, m: dict[str, Any], lost: DataFrame | None = None) -> Appended:
        self._check(self.schema.table(table), frame, insert_only, m, lost)
        staged, path = self._stage(table, frame, rows, m)
        new = self._commit(m, staged, path)
        self._keep_up(table)
        return Appended(table, m["next_tx"], rows, new["version"])

    def _check(self, t: Table, frame: DataFrame, insert_only: bool, m: dict[str, Any], lost: DataFrame | None = None) -> None:
        mutate.check_batch(frame.filter("_op = 'R'").drop("_op", "_seq"), self.live(t.name, m), t, insert_only, frame.select("id"), lost)

    def insert(self, table: str, record: dict[str, Any]) -> Appended:
        return self.insert_many(table, [record])

    def insert_many(self, table: str, records: Iterable[dict[str, Any]]) -> Appended:
        t = self.schema.table(table)
        return self._put(table, [("R", t.check(dict(r))) for r in records], True)

    def upsert(self, table: str, record: dict[str, Any]) -> Appended:
        return self._put(table, [("R", self.schema.table(table).check(dict(record)))], False)

    put = upsert

    def delete(self, table: str, id: str) -> Appended:  # noqa: A002
        """A tombstone, whether or not the row exists."""
        self.schema.table(table)
        return self._put(table, [("D", {"id": id})], False)

    def apply(self, op: str, table: str, record: dict[str, Any]) -> Appended:
        """Put or delete a record; deletes are checked in full too."""
        t = self.schema.table(table)
        t.check(dict(record))
        if op not in ("put", "delete"):
            raise InvalidInput(f"unknown operation {op!r}")
        return self.upsert(table, record) if op == "put" else self.delete(table, record["id"])

    def append_frame(self, table: str, rows: DataFrame, insert_only: bool = True) -> Appended:
        """Insert or upsert a DataFrame of any size as one batch."""
        t, m = self.schema.table(table), self.manifest()
        batch = t.check_frame(rows)
        mutate.check_batch(batch, self.live(table, m), t, insert_only)
        return self._append_numbered(table, batch.withColumn("_op", F.lit("R")), m)

    def _append_numbered(self, table: str, ops: DataFrame, m: dict[str, Any]) -> Appended:
        """Append operations (``_op``, fields) of any number, in the order of their ids."""
        path = self._path(table, m["version"] + 1, "staging")
        with self._attempt(path):
            # ranges of ids are numbered by their share of the whole, so no task sees all rows
            live_ops.numbered(ops, "id", "_seq").write.parquet(path)
            staged = self.spark.read.parquet(path)
            n = staged.count()
            new, folder = self._stage(table, staged, n, m)
        self._drop(path)
        done = self._commit(m, new, folder)
        self._keep_up(table)
        return Appended(table, m["next_tx"], n, done["version"])

    def patch_frame(self, table: str, patches: DataFrame) -> Appended:
        """Patch rows by id, any number: ``id`` and the fields to set; nulls leave a field as it is."""
        t, m = self.schema.table(table), self.manifest()
        for c in patches.columns:
            t.kind(c)
        live = self.live(table, m)
        mutate.require_present(patches, live, t)
        rows = mutate.patched(live, patches, t)
        mutate.check_batch(rows, live, t, False, patches.select("id"))
        return self._append_numbered(table, rows.withColumn("_op", F.lit("R")), m)

    def remove_frame(self, table: str, ids: DataFrame) -> Appended:
        """Remove the rows with the ids of a DataFrame, any number; all of them must exist."""
        t, m = self.schema.table(table), self.manifest()
        live = self.live(table, m)
        mutate.require_present(ids.select("id"), live, t)
        gone = ids.select("id").distinct()
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in t.struct() if f.name != "id"]
        return self._append_numbered(table, gone.select("id", *blank, F.lit("D").alias("_op")), m)

    def _patch_value(self, t: Table, plan: Plan) -> dict[str, Any]:
        if not plan.value:
            raise PlanError("a patch sets at least one field")
        if "id" in plan.value:
            raise PlanError(f"the id of a {t.name} row stays as it is")
        return t.check_values(plan.value)

    def _changes(self, t: Table, plans: Sequence[Plan], m: dict[str, Any]) -> tuple[DataFrame, DataFrame | None]:
        """What write plans come down to against the state in ``m``: operations (``_seq``, ``_op``,
        fields), and (id, field, key) of those whose row is missing. One join per lookup that
        they use, whatever their number."""
        direct, by = [], {}
        for i, p in enumerate(plans):
            if p.op in ("insert", "upsert"):
                direct.append((i, "R", t.check(dict(p.value))))
            elif p.op in ("patch", "remove"):
                value = self._patch_value(t, p) if p.op == "patch" else {}
                key = p.lookup_key
                if not t.lookup(p.lookup or "").unique:
                    raise PlanError(f"{t.name}.{p.lookup} is no unique lookup")
                by.setdefault(p.lookup, []).append((i, "R" if p.op == "patch" else "D", key_text(key), value))
            else:
                raise PlanError(f"{p.op} is no write")
        ops = self._frame(t, [(op, r) for _, op, r in direct], [i for i, _, _ in direct]) if direct else None
        lost, live = None, self.live(t.name, m)
        others = [f for f in t.struct() if f.name != "id"]
        for field, rows in by.items():
            asked = self.spark.createDataFrame(
                [(i, op, key, *(x for f in others for x in (f.name in v, v.get(f.name)))) for i, op, key, v in rows],
                T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_key", T.StringType())]
                             + [x for f in others for x in (T.StructField(f"_has_{f.name}", T.BooleanType()), T.StructField(f"_new_{f.name}", f.dataType))]),
            )
            met = asked.join(live.withColumn("_key", value_text(F.col(field), t.kind(field))), "_key", "left")
            fields = [
                (F.when(F.col("_op") == "R", F.when(F.col(f"_has_{n}"), F.col(f"_new_{n}")).otherwise(F.col(n))) if n != "id" else F.col(n)).alias(n)
                for n in t.names
            ]
            told = met.filter("id IS NOT NULL").select("_seq", "_op", *fields)
            gone = met.filter("id IS NULL").select("id", F.lit(field).alias("field"), F.col("_key").alias("key"))
            ops = told if ops is None else ops.unionByName(told)
            lost = gone if lost is None else lost.unionByName(gone)
        return ops, lost

    def write(self, request: WriteRequest) -> Appended:
        return self.execute(request.into_plan())

    def write_many(self, requests: Sequence[WriteRequest]) -> Appended | None:
        """One batch of one table: inserts only, or any other writes; nothing for nothing."""
        plans = [r.into_plan() for r in requests]
        if not plans:
            return None
        if len({p.table for p in plans}) > 1:
            raise InvalidInput("a batch is of one table")
        inserts = [p.op == "insert" for p in plans]
        if any(inserts) and not all(inserts):
            raise PlanError("inserts do not mix with other writes in a batch")
        return self._apply(plans, all(inserts))

    def _apply(self, plans: Sequence[Plan], insert_only: bool) -> Appended:
        m = self.manifest()
        table = plans[0].table
        ops, lost = self._changes(self.schema.table(table), plans, m)
        return self._append(table, ops, len(plans), insert_only, m, lost)

    def apply_changes(self, requests: Sequence[WriteRequest]) -> list[Appended]:
        """Changes of several tables in one commit; each table's as a batch of its own."""
        m = first = self.manifest()
        by: dict[str, list[Plan]] = {}
        for r in requests:
            p = r.into_plan()
            by.setdefault(p.table, []).append(p)
        out, staged = [], []
        for table, plans in by.items():
            t = self.schema.table(table)
            with self._attempt(*staged):
                ops, lost = self._changes(t, plans, first)
                self._check(t, ops, all(p.op == "insert" for p in plans), first, lost)
                out.append((table, m["next_tx"], len(plans)))
                m, path = self._stage(table, ops, len(plans), m)
            staged.append(path)
        new = self._commit(first, m, *staged) if out else first
        self._keep_up(*by)
        return [Appended(t, tx, n, new["version"]) for t, tx, n in out]

    def patch_by_id(self, table: str, id: str, value: dict[str, Any]) -> Appended:  # noqa: A002
        return self.execute(Plan("patch", table, value=value).with_lookup("id", id))

    # -- reads ---------------------------------------------------------------------

    def get(self, request: ReadRequest) -> Any:
        return request.from_outcome(self.execute(request.into_plan()))

    def execute(self, plan: Plan) -> Any:
        """A page for get, find and scan, a number for count, ``Appended`` for writes."""
        t, m = self.schema.table(plan.table), self.manifest()
        if plan.op == "insert":
            return self.insert_many(plan.table, [plan.value])
        if plan.op in ("upsert", "patch", "remove"):
            return self._apply([plan], False)
        live = self.live(plan.table, m)
        if plan.op == "get":
            return Page(read.get(live, t, plan.lookup or "", plan.lookup_key).collect(), None)
        if plan.op == "count":
            if plan.lookup is None:
                return read.count(live).first()["n"]
            return read.count(live, t, plan.lookup, plan.lookup_key).first()["n"]
        limit, offset = read.checked_limit(plan.limit), read.checked_cursor(plan.cursor)
        if plan.op == "find" and plan.range:
            rows, order = read.between(live, t, plan.lookup or "", **plan.range), [plan.lookup, "id"]
        elif plan.op == "find":
            rows, order = live.filter(read.matches(t, t.lookup(plan.lookup or "").field, plan.lookup_key)), ["id"]
        else:
            rows, order = live, ["id"]
        if plan.after is not None:  # at a cost that does not grow with the place
            if offset or len(order) > 1:
                raise PlanError("after goes with the order of ids and without a cursor")
            rows = rows.filter(F.col("id") > F.lit(plan.after))
        # one row more than the page tells whether there is another; nothing is counted
        got = rows.orderBy(*order).offset(offset).limit(limit + 1).collect()
        more = len(got) > limit
        return Page(got[:limit], str(offset + limit) if more and plan.after is None else None, got[limit - 1]["id"] if more and len(order) == 1 else None)

    def get_by_id(self, table: str, id: str):  # noqa: A002
        return next(iter(self.execute(Plan("get", table).with_lookup("id", id)).rows), None)

    def get_by(self, table: str, lookup: str, key: Any):
        return next(iter(self.execute(Plan("get", table).with_lookup(lookup, key)).rows), None)

    def get_many_by(self, table: str, lookup: str, key: Any) -> list:
        return self.execute(Plan("find", table, limit=read.MAX_LIMIT).with_lookup(lookup, key)).rows

    def scan(self, table: str, limit: int | None = None, cursor: str | None = None) -> Page:
        return self.execute(Plan("scan", table, limit=limit, cursor=cursor))

    def count(self, table: str, lookup: str | None = None, key: Any = None) -> int:
        plan = Plan("count", table)
        return self.execute(plan if lookup is None else plan.with_lookup(lookup, key))

    # -- maintenance ---------------------------------------------------------------

    def compact(self, table: str) -> Compacted:
        """Rewrite the live rows, by id, as the only batch, with new transaction ids.

        Old files stay until ``vacuum``.
        """
        m = self.manifest()
        s = self._state(table, m)
        first = max(m["next_tx"], live_ops.max_tx(self.log(table, m=m)) + 1)
        n, path = self._restate(self.schema.table(table), live_ops.compacted(self.live(table, m), first), first, m)
        return Compacted(table, n, first, first + n, len(s["batches"]), sum(b["bytes"] for b in s["batches"]), self.files.size(path))

    def _restate(self, t: Table, rows: DataFrame, first: int, m: dict[str, Any]) -> tuple[int, str]:
        """Commit numbered rows as the table's only batch: their number and folder. What was
        there stays for readers until ``vacuum``."""
        batch = (m["tables"].get(t.name) or self._empty(t.name))["next_batch"]
        path = self._path(t.name, batch)
        with self._attempt(path):
            rows.select(F.lit(batch).cast("long").alias("_batch"), "_pos", "_tx", "_op", *t.names).write.parquet(path)
            n = self.spark.read.parquet(path).count()
            state = self._empty(t.name) | {"layout": t.layout(), "batches": [self._batch(batch, path, n, True)], "next_batch": batch + 1}
            self._commit(m, m | {"next_tx": first + n, "tables": m["tables"] | {t.name: state}}, path)
        return n, path

    def vacuum(self, keep: int = 1, hours: float = READERS) -> int:
        """Delete what no kept manifest names: the number of folders.

        Kept are the newest ``keep`` manifests and all that were the newest at some time in the
        last ``hours``; folders younger than that stay too, as a writer may be about to name them.
        """
        since = (time.time() - 3600 * hours) * 1000
        found = self.files.times(self.files.at("manifest"))
        names = [n for n in sorted(found) if n.endswith(".json")]
        ends = [*(found[n] for n in names[1:]), float("inf")]  # when the next one took its place
        kept = {n for n, end in zip(names, ends) if end > since} | set(names[-keep:])
        for n in names:
            if n not in kept:
                self.files.delete(self.files.at("manifest", n))
        held = [json.loads(self.files.read(self.files.at("manifest", n))) for n in sorted(kept)]
        gone = 0
        for t in self.schema.tables:
            states = [m["tables"].get(t) or self._empty(t) for m in held]
            used = {b["at"] for s in states for b in s["batches"]} | {s["snapshot"] for s in states} | {x["at"] for s in states for x in s.get("text", {}).values()}
            for folder in ("log", "snapshot", "staging", "text"):
                for n, when in self.files.times(self.files.at(t, folder)).items():
                    if n not in used and when <= since:
                        self.files.delete(self.files.at(t, folder, n))
                        gone += 1
        return gone

    def add_field(self, table: str, field: Field, default: Any, unique: bool | None = None) -> Database:
        """Add a field with a default to every row (and maybe a lookup on it)."""
        from .schema import Lookup

        t = self.schema.table(table)
        check_name(field.name)
        if field.name in t.names:
            raise SchemaError(f"{table} has a field {field.name!r}")
        lookups = t.lookups if unique is None else (*t.lookups, Lookup(field.name, unique))
        return self._reshape(Table(table, (*t.fields, field), lookups), self.live(table).withColumn(field.name, F.lit(default)))

    def drop_field(self, table: str, name: str) -> Database:
        t = self.schema.table(table)
        t.kind(name)
        if name == "id":
            raise SchemaError("id stays")
        return self._reshape(Table(table, tuple(f for f in t.fields if f.name != name), tuple(x for x in t.lookups if x.field != name)), self.live(table).drop(name))

    def _reshape(self, t: Table, rows: DataFrame) -> Database:
        m = self.manifest()
        rows = live_ops.check_unique(t.check_frame(rows), t)
        before = self.schema
        self.schema = DatabaseSchema.of(*(t if x.name == t.name else x for x in self.schema.tables.values()))
        try:
            self._restate(t, live_ops.compacted(rows, m["next_tx"]), m["next_tx"], m)
        except Exception:
            self.schema = before
            raise
        return self

    # -- exchange ------------------------------------------------------------------

    def export_segments(self, table: str, folder: str, cap: int = segment.CHUNK_BYTES) -> int:
        return segment.export(self.log(table), self.schema.table(table), self.schema.hash(), folder, cap)

    def import_segments(self, table: str, folder: str) -> int:
        """Take over the operations of a folder of segments as one batch, in their order."""
        t, m = self.schema.table(table), self.manifest()
        log = segment.load(self.spark, folder, t)
        last = live_ops.last_operations(log).withColumn("_seq", F.lit(0))
        puts = last.filter("_op = 'R'").select(*t.names)
        live_ops.check_unique(puts, t)
        s = self._state(table, m)
        batch = s["next_batch"]
        path = self._path(table, batch)
        # chunk and line make one position that keeps the file order
        pos = F.col("_batch") * (1 << 32) + F.col("_pos")
        with self._attempt(path):
            log.select(F.lit(batch).cast("long").alias("_batch"), pos.alias("_pos"), "_tx", "_op", *t.names).write.parquet(path)
            stored = self.spark.read.parquet(path)
            n, top = stored.agg(F.count(F.lit(1)), F.max("_tx")).first()
            new = s | {"batches": [*s["batches"], self._batch(batch, path, n)], "next_batch": batch + 1}
            self._commit(m, m | {"next_tx": max(m["next_tx"], (top or 0) + 1), "tables": m["tables"] | {table: new}}, path)
        return n

    # -- word search ---------------------------------------------------------------

    def index_text(self, table: str, field: str) -> None:
        """Store a word index of a field over the live rows; searches use it until the table changes."""
        m = self.manifest()
        s = self._state(table, m)
        self.schema.table(table).kind(field)
        path = self._path(table, m["version"] + 1, "text")
        with self._attempt(path):
            search.store(search.terms(self.live(table, m), field), path)
            told = {"at": path.rsplit("/", 1)[1], "next_batch": s["next_batch"]}
            self._commit(m, m | {"tables": m["tables"] | {table: s | {"text": s.get("text", {}) | {field: told}}}}, path)

    def search(self, table: str, field: str, query: str) -> DataFrame:
        """(id, score): rows whose field holds every word of the query; by the stored index where it is current."""
        m = self.manifest()
        s = self._state(table, m)
        stored = s.get("text", {}).get(field)
        if stored and stored["next_batch"] == s["next_batch"]:
            return search.search(search.load(self.spark, self.files.at(table, "text", stored["at"])), query)
        return search.search(search.terms(self.live(table, m), field), query)

    # -- subscriptions -------------------------------------------------------------

    def watch(self, request: ReadRequest, deliver, checkpoint: str, once: bool = False):
        """Call ``deliver(rows, left, revision)`` for each commit that touches a selector's answers.

        ``rows`` are the touched rows that answer it now, ``left`` the ids that did and no longer
        do. A streaming query over the manifests; delivery is at least once.
        """
        from .streaming import watch

        return watch.watch_database(self, request.into_plan(), deliver, checkpoint, once)

    def export_snapshot(self, table: str, folder: str, compression: str = "zstd") -> None:
        """Live rows as Parquet, for reports elsewhere."""
        self.live(table).write.option("compression", compression).parquet(folder)

    def __getattr__(self, name: str):
        """``db.notes`` is a handle of the table ``notes``."""
        schema = self.__dict__.get("schema")
        if schema is not None and name in schema.tables:
            return TableHandle(self, name)
        raise AttributeError(name)


class TableHandle:
    """A table's requests by name: ``db.notes.by.title("x")``, ``db.notes.add(...)``."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name
        self.by = _By(self)

    def add(self, **record: Any) -> Appended:
        return self.db.insert(self.name, record)

    def set(self, **record: Any) -> Appended:
        return self.db.upsert(self.name, record)

    def edit(self, id: str, **patch: Any) -> Appended:  # noqa: A002
        return self.db.patch_by_id(self.name, id, patch)

    def remove(self, id: str) -> Appended:  # noqa: A002
        return self.db.execute(Plan("remove", self.name).with_lookup("id", id))

    def get(self, id: str):  # noqa: A002
        return self.db.get_by_id(self.name, id)

    def page(self, limit: int | None = None, cursor: str | None = None) -> Page:
        return self.db.scan(self.name, limit, cursor)

    def count(self) -> int:
        return self.db.count(self.name)

    @property
    def frame(self) -> DataFrame:
        return self.db.live(self.name)


class _By:
    def __init__(self, handle: TableHandle):
        self._handle = handle

    def __getattr__(self, field: str):
        h = self._handle
        lookup = h.db.schema.table(h.name).lookup(field)
        return (lambda key: h.db.get_by(h.name, field, key)) if lookup.unique else (lambda key: h.db.get_many_by(h.name, field, key))


__all__ = ["Appended", "Compacted", "Database", "TableHandle", "WriteChange"]
