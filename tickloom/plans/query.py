"""Queries as plain values: one key, a window, conditions, a projection, a direction and a limit."""

from __future__ import annotations

import enum
import math
import re
from dataclasses import dataclass, replace
from decimal import Decimal

from tickloom.errors import QueryError
from tickloom.functions.codec import MOST, PRICE_SCALE, scale_price
from tickloom.schema import BAR


class Field(enum.Enum):
    """The fields that a query may name, in declaration order."""

    DATETIME, OPEN, HIGH, LOW, CLOSE = "datetime", "open", "high", "low", "close"
    TICK_VOLUME, SPREAD, VOLUME = "tick_volume", "spread", "volume"

    @property
    def is_price(self) -> bool:
        return BAR.field(self.value).price


def field_of(name: str) -> Field | None:
    """The field of a name or alias, in any case."""
    return next((Field(c.name) for c in BAR.columns if c.answers_to(name)), None)


class Op(enum.Enum):
    EQ, NE, LT, LTE, GT, GTE = "==", "!=", "<", "<=", ">", ">="


def op_of(text: str) -> Op | None:
    return {"=": Op.EQ, "<>": Op.NE}.get(text) or next((o for o in Op if o.value == text), None)


@dataclass(frozen=True)
class Cond:
    """A comparison of a field's stored integer with ``stored``."""

    field: Field
    op: Op
    stored: int

    @classmethod
    def of(cls, field: Field, op: Op, value: float | Decimal) -> Cond:
        """Prices are rounded to stored units; other numbers lose their fraction."""
        if not isinstance(field, Field):
            raise QueryError(f"unknown field {field!r}")
        if not isinstance(op, Op):
            raise QueryError(f"unknown comparison {op!r}")
        if math.isnan(value) or value in (math.inf, -math.inf):
            raise QueryError(f"{field.value}: {value} is not finite")
        if value < 0:
            raise QueryError(f"{field.value}: {value} is negative")
        if field.is_price:
            if value * PRICE_SCALE > MOST:
                raise QueryError(f"{field.value}: {value} is out of range")
            return cls(field, op, scale_price(value if isinstance(value, Decimal) else float(value)))
        if value >= 1 << 53:
            raise QueryError(f"{field.value}: {value} is too large to be exact")
        return cls(field, op, int(value))

    def text(self) -> str:
        number = str(self.stored)
        if self.field.is_price:
            number = format((Decimal(self.stored) / PRICE_SCALE).normalize(), "f")
        return f"{self.field.value} {self.op.value} {number}"


_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_/.-]*")


@dataclass(frozen=True)
class Query:
    """``start`` and ``end`` are inclusive stamps, 0 leaves that side open; ``limit`` 0 takes all; no ``fields`` means all."""

    key: str
    fields: tuple[Field, ...] = ()
    start: int = 0
    end: int = 0
    conds: tuple[Cond, ...] = ()
    newest_first_: bool = False
    limit: int = 0

    def between(self, start: int, end: int) -> Query:
        if start < 0 or end < 0:
            raise QueryError("a window's stamps can't be negative")
        return replace(self, start=start, end=end)

    def newest_first(self) -> Query:
        return replace(self, newest_first_=True)

    def oldest_first(self) -> Query:
        return replace(self, newest_first_=False)

    def take(self, n: int) -> Query:
        return replace(self, limit=max(0, n))

    def where(self, field: Field | str, op: Op | str, value: float) -> Query:
        f = field_of(field) if isinstance(field, str) else field
        o = op_of(op) if isinstance(op, str) else op
        return replace(self, conds=(*self.conds, Cond.of(f if f else field, o if o else op, value)))

    def select(self, *fields: Field | str) -> Query:
        """The projection is a set: order and repeats are not kept; all fields are as none."""
        found = set()
        for f in fields:
            one = field_of(f) if isinstance(f, str) else f
            if not isinstance(one, Field):
                raise QueryError(f"unknown field {f!r}")
            found.add(one)
        return replace(self, fields=() if len(found) == len(Field) else tuple(f for f in Field if f in found))

    def window(self) -> tuple[int, int | None]:
        """First and last stamp that the window and the range conditions on datetime admit; None: open."""
        low, high = self.start, self.end or None
        for c in self.conds:
            if c.field is Field.DATETIME and c.op in (Op.GT, Op.GTE):
                low = max(low, c.stored + (c.op is Op.GT))
            elif c.field is Field.DATETIME and c.op in (Op.LT, Op.LTE):
                last = c.stored - (c.op is Op.LT)
                high = last if high is None else min(high, last)
        return low, high

    def text(self) -> str:
        """The query as text that parses to the same query."""
        key = self.key if _PLAIN_KEY.fullmatch(self.key) else '"' + self.key.replace("\\", "\\\\").replace('"', '\\"') + '"'
        parts = [f"SELECT {', '.join(f.value for f in self.fields) or '*'} FROM {key}"]
        conds = [c.text() for c in self.conds]
        if self.end and self.start <= self.end:
            parts.append(f"RANGE {self.start} TO {self.end}")
        elif self.start or self.end:
            # RANGE can't say an open end, nor an empty window; conditions can
            conds = [f"datetime >= {self.start}"] * bool(self.start) + [f"datetime <= {self.end}"] * bool(self.end) + conds
        if conds:
            parts.append("WHERE " + " AND ".join(conds))
        if self.newest_first_:
            parts.append("ORDER BY datetime DESC")
        if self.limit:
            parts.append(f"LIMIT {self.limit}")
        return " ".join(parts)

    __str__ = text
