"""One exception hierarchy: schema, format, plan and storage errors."""

from __future__ import annotations


class StrandlogError(Exception):
    """Base of all errors raised here."""


class SchemaError(StrandlogError):
    """A schema or a record that breaks its schema."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: {message}" if line else message)
        self.line, self.column = line, column


class UnknownTable(SchemaError):
    pass


class UnknownField(SchemaError):
    pass


class MissingField(SchemaError):
    pass


class TypeMismatch(SchemaError):
    pass


class DuplicateName(SchemaError):
    pass


class ReservedName(SchemaError):
    pass


class FormatError(StrandlogError):
    """Bytes that break the segment, log or pack format."""


class PlanError(StrandlogError):
    """A request that can't be carried out as stated."""


class NotFound(PlanError):
    """The row a patch or remove needs does not exist."""


class InvalidInput(StrandlogError):
    """A batch that contradicts itself, or names what was not declared."""


class AlreadyExists(StrandlogError):
    """An id or a unique key is taken."""


class InvalidData(StrandlogError):
    """Stored rows contradict the schema's constraints."""


class Locked(StrandlogError):
    """Another writer committed first."""
