"""What can go wrong, one exception a kind."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this engine."""


class CorruptError(EngineError):
    """A store's files do not hold what its metadata promises."""


class BusyError(EngineError):
    """Another writer holds the store's lock."""


class UnsupportedError(EngineError):
    """The store's record type, or its version, has no such operation."""


class InvalidRecordError(EngineError, ValueError):
    """A record that cannot be stored, or a request that cannot be met."""


class OutOfOrderError(InvalidRecordError):
    """A stamp that does not follow the one before it."""


class PriceRangeError(InvalidRecordError):
    """A price that the fixed-point form cannot hold."""


class KeyNotFoundError(EngineError, KeyError):
    """No record was ever stored under the key."""

    def __str__(self) -> str:
        return Exception.__str__(self)


class NoMatchError(EngineError, LookupError):
    """The query matched nothing."""


class SchemaError(EngineError, ValueError):
    """A record type that is not a valid schema, or a column that it doesn't have."""


class QueryError(EngineError, ValueError):
    """A query that cannot be built."""


class ParseError(QueryError):
    """Query text that cannot be read; ``pos`` is where."""

    def __init__(self, pos: int, message: str):
        super().__init__(f"query: at {pos}: {message}")
        self.pos, self.message = pos, message


class RAMUnknownError(EngineError):
    """A flush budget was asked for as a share of memory whose size can't be read."""
