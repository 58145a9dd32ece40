"""Requests that turn into plans, and make of the outcome what they promise."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Row

from ..operators.read import MAX_LIMIT
from .envelope import Plan


@dataclass(frozen=True)
class Page:
    """At most ``MAX_LIMIT`` rows, and where the next page starts: as an offset, and as the key of
    the last row (``after``), which costs the same at any place."""

    rows: list[Row]
    next_cursor: str | None
    next_after: str | None = None


@runtime_checkable
class ReadRequest(Protocol):
    def into_plan(self) -> Plan: ...

    def from_outcome(self, outcome: Any) -> Any: ...


@runtime_checkable
class WriteRequest(Protocol):
    def into_plan(self) -> Plan: ...


@dataclass(frozen=True)
class GetOne:
    """No row or one."""

    plan: Plan

    def into_plan(self) -> Plan:
        return self.plan

    def from_outcome(self, outcome: Page) -> Row | None:
        return next(iter(outcome.rows), None)


@dataclass(frozen=True)
class GetMany:
    """Rows under a lookup, up to the largest limit unless told otherwise."""

    plan: Plan

    def limit(self, n: int) -> GetMany:
        return replace(self, plan=self.plan.with_limit(n))

    def cursor(self, c: str | None) -> GetMany:
        return replace(self, plan=self.plan.with_cursor(c))

    def after(self, key: str | None) -> GetMany:
        return replace(self, plan=self.plan.with_after(key))

    def into_plan(self) -> Plan:
        return self.plan if self.plan.limit is not None else self.plan.with_limit(MAX_LIMIT)

    def from_outcome(self, outcome: Page) -> list[Row]:
        return outcome.rows


@dataclass(frozen=True)
class GetPage:
    """One page of a table."""

    plan: Plan

    def limit(self, n: int) -> GetPage:
        return replace(self, plan=self.plan.with_limit(n))

    def cursor(self, c: str | None) -> GetPage:
        return replace(self, plan=self.plan.with_cursor(c))

    def after(self, key: str | None) -> GetPage:
        return replace(self, plan=self.plan.with_after(key))

    def into_plan(self) -> Plan:
        return self.plan

    def from_outcome(self, outcome: Page) -> Page:
        return outcome


@dataclass(frozen=True)
class GetCount:
    """The number of live rows of a table, or under a lookup."""

    plan: Plan

    def by(self, lookup: str, key: Any) -> GetCount:
        return replace(self, plan=self.plan.with_lookup(lookup, key))

    def into_plan(self) -> Plan:
        return self.plan

    def from_outcome(self, outcome: int) -> int:
        return outcome


@dataclass(frozen=True)
class WriteChange:
    """One change of one row."""

    plan: Plan

    def into_plan(self) -> Plan:
        return self.plan


class selector:
    """Builders of read requests."""

    @staticmethod
    def id(table: str, key: str) -> GetOne:
        return GetOne(Plan("get", table).with_lookup("id", key))

    @staticmethod
    def one(table: str, lookup: str, key: Any) -> GetOne:
        return GetOne(Plan("get", table).with_lookup(lookup, key))

    @staticmethod
    def many(table: str, lookup: str, key: Any) -> GetMany:
        return GetMany(Plan("find", table).with_lookup(lookup, key))

    @staticmethod
    def between(table: str, lookup: str, **bounds: Any) -> GetMany:
        return GetMany(Plan("find", table, lookup=lookup).with_range(**bounds))

    @staticmethod
    def all(table: str) -> GetPage:
        return GetPage(Plan("scan", table))

    @staticmethod
    def count(table: str) -> GetCount:
        return GetCount(Plan("count", table))


class change:
    """Builders of write requests."""

    @staticmethod
    def add(table: str, record: dict[str, Any]) -> WriteChange:
        return WriteChange(Plan("insert", table, value=dict(record)))

    @staticmethod
    def set(table: str, record: dict[str, Any]) -> WriteChange:
        return WriteChange(Plan("upsert", table, value=dict(record)))

    @staticmethod
    def edit(table: str, lookup: str, key: Any, patch: dict[str, Any]) -> WriteChange:
        return WriteChange(Plan("patch", table, value=dict(patch)).with_lookup(lookup, key))

    @staticmethod
    def edit_id(table: str, key: str, patch: dict[str, Any]) -> WriteChange:
        return change.edit(table, "id", key, patch)

    @staticmethod
    def remove(table: str, lookup: str, key: Any) -> WriteChange:
        return WriteChange(Plan("remove", table).with_lookup(lookup, key))

    @staticmethod
    def remove_id(table: str, key: str) -> WriteChange:
        return change.remove(table, "id", key)
