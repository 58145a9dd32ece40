"""The plan: one bound request, the only form the database executes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from ..errors import PlanError

READS = ("get", "find", "scan", "count")
WRITES = ("insert", "upsert", "patch", "remove")


@dataclass(frozen=True)
class Plan:
    op: str
    table: str
    lookup: str | None = None
    key: dict[str, Any] = field(default_factory=dict)
    value: dict[str, Any] = field(default_factory=dict)
    range: dict[str, Any] = field(default_factory=dict)
    limit: int | None = None
    cursor: str | None = None
    after: str | None = None

    def __post_init__(self):
        if self.op not in READS + WRITES:
            raise PlanError(f"unknown operation {self.op!r}")

    def with_lookup(self, lookup: str, key: Any) -> Plan:
        return replace(self, lookup=lookup, key={lookup: key})

    def with_value(self, value: dict[str, Any]) -> Plan:
        return replace(self, value=dict(value))

    def with_range(self, **bounds: Any) -> Plan:
        return replace(self, range=bounds)

    def with_limit(self, limit: int | None) -> Plan:
        return replace(self, limit=limit)

    def with_cursor(self, cursor: str | None) -> Plan:
        return replace(self, cursor=cursor)

    def with_after(self, key: str | None) -> Plan:
        return replace(self, after=key)

    @property
    def lookup_key(self) -> Any:
        if self.lookup is None:
            raise PlanError(f"{self.op} needs a lookup")
        if self.lookup not in self.key:
            raise PlanError(f"{self.op} needs a key for {self.lookup!r}")
        return self.key[self.lookup]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        try:
            got = json.loads(text)
        except ValueError as e:
            raise PlanError(f"no JSON: {e}") from e
        if not isinstance(got, dict) or not isinstance(got.get("op"), str) or not isinstance(got.get("table"), str):
            raise PlanError("a plan is an object with op and table")
        known = set(cls.__dataclass_fields__)
        extra = set(got) - known
        if extra:
            raise PlanError(f"unknown member {sorted(extra)[0]!r}")
        for name in ("key", "value", "range"):
            got[name] = got.get(name) or {}
            if not isinstance(got[name], dict):
                raise PlanError(f"{name} is an object")
        return cls(**got)
