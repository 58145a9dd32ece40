"""Schema text: ``schema! { table { field kind; lookup field unique; } }``.

Semicolons are optional, ``//`` starts a comment, and errors carry line and column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import SchemaError
from .functions.hashing import fnv1a64
from .schema import KINDS, DatabaseSchema, Field, Lookup, Table

_TOKENS = re.compile(r"(?P<skip>[ \t\r]+|//[^\n]*)|(?P<line>\n)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[!{};])")
_SNAKE = re.compile(r"[a-z_][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class Token:
    text: str
    line: int
    column: int

    @property
    def word(self) -> bool:
        return self.text[0] not in "!{};"


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise SchemaError(f"unexpected character {text[at]!r}", line, at - start + 1)
        if m.lastgroup == "line":
            line, start = line + 1, m.end()
        elif m.lastgroup != "skip":
            out.append(Token(m[0], line, at - start + 1))
        at = m.end()
    return out


@dataclass
class TableText:
    """A table as written; lookups in the order of declaration."""

    name: str
    fields: list[tuple[str, str]]
    lookups: list[tuple[str, bool]]


class _Reader:
    def __init__(self, found: list[Token]):
        self.found, self.at = found, 0

    def peek(self) -> str | None:
        return self.found[self.at].text if self.at < len(self.found) else None

    def fail(self, message: str, back: int = 0):
        if self.at - back < len(self.found):
            t = self.found[max(0, self.at - back)]
            raise SchemaError(message, t.line, t.column)
        raise SchemaError(f"{message} at end of input")

    def take(self, mark: str) -> None:
        if self.peek() != mark:
            self.fail(f"expected {mark!r}")
        self.at += 1

    def word(self) -> str:
        if self.at >= len(self.found) or not self.found[self.at].word:
            self.fail("expected a name")
        self.at += 1
        return self.found[self.at - 1].text


def parse(text: str) -> list[TableText]:
    """The tables of a schema text, checked."""
    r = _Reader(tokens(text))
    wrapped = r.peek() == "schema"
    if wrapped:
        r.at += 1
        r.take("!")
        r.take("{")
    out = []
    while r.peek() != "}":
        if r.peek() is None:
            raise SchemaError("the schema text breaks off")
        t = TableText(r.word(), [], [])
        r.take("{")
        while r.peek() not in ("}", None):
            name = r.word()
            if name == "lookup":
                target = r.word()
                unique = r.peek() == "unique"
                r.at += unique
                t.lookups.append((target, unique))
            else:
                kind = r.word()
                if kind not in KINDS:
                    r.fail(f"unknown type {kind!r} (expected {', '.join(KINDS)})", back=1)
                t.fields.append((name, kind))
            if r.peek() == ";":
                r.at += 1
        r.take("}")
        out.append(t)
    if wrapped:
        r.take("}")
    check(out)
    return out


def check(tables: list[TableText]) -> None:
    snake = lambda n: bool(_SNAKE.match(n)) and "__" not in n
    seen: set[str] = set()
    for t in tables:
        if not snake(t.name):
            raise SchemaError(f"{t.name!r} cannot name a table")
        if t.name in seen:
            raise SchemaError(f"a second table is called {t.name!r}")
        seen.add(t.name)
        names: set[str] = set()
        for n, _ in t.fields:
            if n.startswith("_"):
                raise SchemaError(f"{n!r} of {t.name!r}: names that begin with an underscore are reserved")
            if not snake(n):
                raise SchemaError(f"{n!r} cannot name a field of {t.name!r}")
            if n in names:
                raise SchemaError(f"{t.name!r} declares {n!r} twice")
            names.add(n)
        if "id" not in names:
            raise SchemaError(f"every table has an id, {t.name!r} has none")
        keys: set[str] = set()
        for k, _ in t.lookups:
            if k not in names:
                raise SchemaError(f"{t.name!r} has no field {k!r} to look up")
            if k in keys:
                raise SchemaError(f"{t.name!r} declares its lookup on {k!r} twice")
            keys.add(k)


def declared_hash(tables: list[TableText]) -> str:
    """The hash over tables and lookups in the order of declaration."""
    out = ""
    for t in tables:
        own = Table(t.name, tuple(Field(n, k) for n, k in t.fields))
        out += own.signature([Lookup("id", True), *(Lookup(k, u) for k, u in t.lookups)]) + "\n"
    return f"{fnv1a64(out.encode()):016x}"


def compile_schema(text: str) -> DatabaseSchema:
    """A database schema from text."""
    return DatabaseSchema.of(*(Table(t.name, tuple(Field(n, k) for n, k in t.fields), tuple(Lookup(k, u) for k, u in t.lookups)) for t in parse(text)))
