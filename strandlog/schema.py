"""Tables, fields and lookups, and their Spark types.

A table has typed fields in declared order, all required, and an implicit unique lookup
on ``id``. Kinds are id, text, int, float and bool; id and text differ as kinds though both are
strings, so the kind travels in the field's metadata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dc_field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DuplicateName, MissingField, ReservedName, SchemaError, TypeMismatch, UnknownField, UnknownTable
from .functions.hashing import fnv1a64

KINDS: dict[str, T.DataType] = {"id": T.StringType(), "text": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


class Id(str):
    """A string value of kind id; plain strings count as id or text as the field asks."""


class Text(str):
    """A string value of kind text, which no id field takes."""


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, Id):
        return "id"
    if isinstance(value, str):
        return "text"
    raise TypeMismatch(f"no kind for a {type(value).__name__}")


def fits(kind: str, value: Any) -> bool:
    """Exact kinds, except that a plain string serves as id or text."""
    if value is None:
        return False
    found = kind_of(value)
    if kind == "int" and found == "int":
        return INT_MIN <= value <= INT_MAX
    if found == kind:
        return True
    return kind == "id" and isinstance(value, str) and not isinstance(value, Text)


def check_name(name: str) -> str:
    if not name or name.startswith("_"):
        raise ReservedName(f"field name {name!r} is empty or reserved")
    return name


@dataclass(frozen=True)
class Field:
    name: str
    kind: str

    def __post_init__(self):
        check_name(self.name)
        if self.kind not in KINDS:
            raise SchemaError(f"unknown type {self.kind!r} (expected {', '.join(KINDS)})")


@dataclass(frozen=True)
class Lookup:
    field: str
    unique: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    lookups: tuple[Lookup, ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        for n in names:
            if names.count(n) > 1:
                raise DuplicateName(f"duplicate field {n!r} in table {self.name!r}")
        keys = [x.field for x in self.lookups]
        for k in keys:
            if keys.count(k) > 1:
                raise DuplicateName(f"duplicate lookup on {k!r} in table {self.name!r}")
            if k not in names:
                raise UnknownField(f"lookup {k!r} refers to a missing field of {self.name!r}")
        if "id" not in names:
            raise MissingField(f"table {self.name!r} has no field 'id'")
        if self.kind("id") != "id":
            raise TypeMismatch(f"field 'id' of {self.name!r} must be of kind id")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def kind(self, field: str) -> str:
        for f in self.fields:
            if f.name == field:
                return f.kind
        raise UnknownField(f"{self.name!r} has no field {field!r}")

    @property
    def all_lookups(self) -> list[Lookup]:
        """The implicit one on id first, the declared ones by name."""
        return [Lookup("id", True), *sorted((x for x in self.lookups if x.field != "id"), key=lambda x: x.field)]

    def lookup(self, field: str) -> Lookup:
        for x in self.all_lookups:
            if x.field == field:
                return x
        raise UnknownField(f"{field!r} is no declared lookup of {self.name!r}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KINDS[f.kind], False, {"kind": f.kind}) for f in self.fields])

    def signature(self, lookups: list[Lookup] | None = None) -> str:
        found = [self.name, *(f"{f.name}:{f.kind}" for f in self.fields)]
        found += [f"lookup:{x.field}:{'unique' if x.unique else 'many'}" for x in (lookups or self.all_lookups)]
        return "|".join(found)

    def layout(self) -> str:
        """What stored rows depend on: fields in order, and which lookups are unique."""
        unique = sorted(x.field for x in self.lookups if x.unique and x.field != "id")
        return ", ".join([f"{f.name}: {f.kind}" for f in self.fields] + [f"{u} unique" for u in unique])

    def check_values(self, values: dict[str, Any]) -> dict[str, Any]:
        """Some fields' values, if each is of its field's kind."""
        for name, value in values.items():
            kind = self.kind(name)
            if not fits(kind, value):
                raise TypeMismatch(f"{self.name}.{name} takes {kind}, not {value!r}")
        return values

    def check(self, record: dict[str, Any]) -> dict[str, Any]:
        """The record, if every declared field is there with its kind and nothing else is."""
        for name in ("id", *self.names):
            if name not in record:
                raise MissingField(f"{self.name!r} needs field {name!r}")
        return self.check_values(record)

    def check_frame(self, df: DataFrame) -> DataFrame:
        """``df`` with the declared columns, failing on others, on types and at run time on nulls."""
        extra = [c for c in df.columns if c not in self.names]
        if extra:
            raise UnknownField(f"{self.name!r} has no field {extra[0]!r}")
        cols = []
        for f in self.fields:
            if f.name not in df.columns:
                raise MissingField(f"{self.name!r} needs field {f.name!r}")
            found = df.schema[f.name].dataType
            widened = f.kind == "int" and isinstance(found, (T.IntegerType, T.ShortType, T.ByteType))
            if found != KINDS[f.kind] and not widened:
                raise TypeMismatch(f"{self.name}.{f.name} takes {f.kind}, not {found.simpleString()}")
            c = F.col(f.name).cast(KINDS[f.kind])
            cols.append(F.when(c.isNull(), F.raise_error(F.lit(f"{self.name}.{f.name} is null"))).otherwise(c).alias(f.name))
        return df.select(*cols)


@dataclass(frozen=True)
class DatabaseSchema:
    tables: dict[str, Table] = dc_field(default_factory=dict)

    @classmethod
    def of(cls, *tables: Table) -> DatabaseSchema:
        out: dict[str, Table] = {}
        for t in tables:
            if t.name in out:
                raise DuplicateName(f"duplicate table {t.name!r}")
            out[t.name] = t
        return cls(dict(sorted(out.items())))

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise UnknownTable(f"no table {name!r}")
        return self.tables[name]

    def hash(self) -> str:
        """64-bit FNV-1a over the tables' signatures, by table name."""
        return f"{fnv1a64(''.join(self.tables[n].signature() + chr(10) for n in sorted(self.tables)).encode()):016x}"


def table(name: str, *fields: str, unique: tuple[str, ...] = (), many: tuple[str, ...] = ()) -> Table:
    """A table from ``"field: kind"`` strings."""
    split = [re.split(r"\s*:\s*|\s+", f.strip().rstrip(";"), maxsplit=1) for f in fields]
    return Table(name, tuple(Field(a, b) for a, b in split), tuple(Lookup(u, True) for u in unique) + tuple(Lookup(m) for m in many))
