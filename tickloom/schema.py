"""Record schemas: columns, their kinds and roles, and how they look to Spark."""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import json
import math
import typing
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.errors import SchemaError


class Kind(enum.Enum):
    """What a column holds; the value is its name in ``str(schema)``."""

    INT64, INT32, INT16, INT8 = "int64", "int32", "int16", "int8"
    UINT64, UINT32, UINT16, UINT8 = "uint64", "uint32", "uint16", "uint8"
    FLOAT64, FLOAT32, BOOL, BYTES = "float64", "float32", "bool", "bytes"

    @property
    def is_integer(self) -> bool:
        return "int" in self.value

    @property
    def bounds(self) -> tuple[int, int] | None:
        """Least and greatest value of an integer kind, in a signed long at most."""
        if not self.is_integer:
            return None
        bits = int(self.value.rpartition("t")[2])
        if self.value[0] == "u":
            return 0, min((1 << bits) - 1, (1 << 63) - 1)
        return -(1 << bits - 1), (1 << bits - 1) - 1


#: Spark has no unsigned types, so an unsigned column takes the next wider signed one.
SPARK_TYPES = {
    Kind.INT64: T.LongType(), Kind.INT32: T.IntegerType(), Kind.INT16: T.ShortType(), Kind.INT8: T.ByteType(),
    Kind.UINT64: T.LongType(), Kind.UINT32: T.LongType(), Kind.UINT16: T.IntegerType(), Kind.UINT8: T.ShortType(),
    Kind.FLOAT64: T.DoubleType(), Kind.FLOAT32: T.FloatType(), Kind.BOOL: T.BooleanType(), Kind.BYTES: T.BinaryType(),
}
WIDTHS = {"64": 8, "32": 4, "16": 2, "t8": 1, "bool": 1}

_KINDS = {
    int: Kind.INT64, float: Kind.FLOAT64, bool: Kind.BOOL, np.bool_: Kind.BOOL,
    np.int64: Kind.INT64, np.int32: Kind.INT32, np.int16: Kind.INT16, np.int8: Kind.INT8,
    np.uint64: Kind.UINT64, np.uint32: Kind.UINT32, np.uint16: Kind.UINT16, np.uint8: Kind.UINT8,
    np.float64: Kind.FLOAT64, np.float32: Kind.FLOAT32,
}
#: Types that a fixed-width record can't hold, and what to use.
_REFUSED = {
    str: "text has no fixed width; use FixedBytes[n] or keep it in the key",
    bytes: "bytes need a width; use FixedBytes[n]",
    bytearray: "bytes need a width; use FixedBytes[n]",
    list: "a list has no fixed width; use one column an element",
    tuple: "a tuple has no single kind; use one column an element",
    set: "a set has no fixed width",
    dict: "a map has no fixed width; use one column a key",
    dt.datetime: "use an integer of the schema's time unit",
    dt.date: "use an integer of the schema's time unit",
    dt.timedelta: "use an integer of the schema's time unit",
    complex: "use two float columns",
}


class FixedBytes:
    """``FixedBytes[n]``: the type of a column of n bytes."""

    def __class_getitem__(cls, width: int) -> type:
        if not isinstance(width, int) or width < 1:
            raise SchemaError(f"a byte column needs a positive width, not {width!r}")
        return type(f"FixedBytes[{width}]", (cls,), {"width": width})


def kind_of(annotation: type) -> tuple[Kind, int]:
    """The kind and width in bytes of a field's type; SchemaError names what to use instead."""
    if isinstance(annotation, type) and issubclass(annotation, FixedBytes) and annotation is not FixedBytes:
        return Kind.BYTES, annotation.width
    base = typing.get_origin(annotation) or annotation
    if base in _KINDS:
        kind = _KINDS[base]
        return kind, next(w for end, w in WIDTHS.items() if kind.value.endswith(end))
    if base in _REFUSED:
        raise SchemaError(f"{getattr(base, '__name__', base)} can't be a column: {_REFUSED[base]}")
    if dataclasses.is_dataclass(base):
        raise SchemaError(f"{base.__name__} can't be a column: flatten the nested record")
    raise SchemaError(f"{annotation!r} can't be a column: use an integer, float, bool or FixedBytes[n]")


class TimeUnit(enum.Enum):
    MS, US, NS = "ms", "us", "ns"
    UNKNOWN = "unknown"

    def ticks(self, duration: dt.timedelta | float) -> int:
        """How many stamps a duration (or seconds) spans, or -1 if the unit isn't known."""
        each = {"ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}.get(self.value)
        if each is None:
            return -1
        if isinstance(duration, dt.timedelta):
            micros = (duration.days * 86_400 + duration.seconds) * 1_000_000 + duration.microseconds
            return micros * each // 1_000_000
        return int(duration * each)


_UNITS = {
    "ms": TimeUnit.MS, "millis": TimeUnit.MS, "milliseconds": TimeUnit.MS,
    "us": TimeUnit.US, "micros": TimeUnit.US, "microseconds": TimeUnit.US,
    "ns": TimeUnit.NS, "nanos": TimeUnit.NS, "nanoseconds": TimeUnit.NS,
}


def parse_unit(text: str) -> TimeUnit:
    return _UNITS.get(text.lower(), TimeUnit.UNKNOWN)


_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.")
_OPTIONS = ("time", "price", "primary", "index")


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    width: int
    aliases: tuple[str, ...] = ()
    time: bool = False
    price: bool = False
    signed: bool = False
    primary: bool = False
    indexed: bool = False

    @property
    def stored(self) -> str:
        """The column that comparisons use: a price's is its scaled long."""
        return f"{self.name}_fp" if self.price else self.name

    def answers_to(self, name: str) -> bool:
        return name.lower() in (n.lower() for n in (self.name, *self.aliases))

    def value(self, record):
        """The column's value in a record: a mapping, a row, or an object with attributes."""
        try:
            return record[self.name]
        except (TypeError, KeyError, ValueError):
            return getattr(record, self.name)

    def load(self, record) -> int | float:
        """The value as a number; a bool counts 0 or 1.  Bytes are no number and load as 0."""
        if self.kind is Kind.BYTES:
            return 0
        found = self.value(record)
        return float(found) if self.kind in (Kind.FLOAT64, Kind.FLOAT32) else int(found)

    def compare(self, a, b) -> int:
        """-1, 0 or 1 as record ``a`` comes before, with or after ``b``; bytes by their order, NaN last."""
        x, y = (self.value(r) if self.kind is Kind.BYTES else self.load(r) for r in (a, b))
        if self.kind is Kind.BYTES:
            x, y = bytes(x), bytes(y)
        else:
            x, y = (math.isnan(x), x), (math.isnan(y), y)
            if x[0] or y[0]:
                x, y = x[0], y[0]
        return (x > y) - (x < y)

    def equal(self, a, b) -> bool:
        return self.compare(a, b) == 0

    def compared(self, a: SparkColumn, b: SparkColumn) -> SparkColumn:
        """The same as a column of -1, 0 and 1, of two columns of this one's type; Spark's order has NaN last too."""
        return F.when(a > b, 1).when(a < b, -1).when(a.eqNullSafe(b), 0)


@dataclass(frozen=True)
class RecordSchema:
    """A record type: ordered columns with exactly one time column.

    Prices are signed where a column says so (ticks), else not below zero (bars).
    """

    name: str
    columns: tuple[Column, ...]
    unit: TimeUnit = TimeUnit.MS

    def __post_init__(self) -> None:
        times = [c for c in self.columns if c.time]
        if len(times) != 1:
            raise SchemaError(f"{self.name}: exactly one time column is needed, not {len(times)}")
        if not times[0].kind.is_integer:
            raise SchemaError(f"{self.name}: time column {times[0].name} must be an integer, not {times[0].kind.value}")
        taken: set[str] = set()
        for c in self.columns:
            for name in (c.name, *c.aliases):
                if not name:
                    raise SchemaError(f"{self.name}: a column needs a name")
                if set(name) - _NAME_CHARS:
                    raise SchemaError(f"{self.name}: {name!r} may hold letters, digits, _ and . only")
                # Spark compares names without case, so two that differ in case only would clash
                if name.lower() in taken:
                    raise SchemaError(f"{self.name}: {name!r} is used twice")
                taken.add(name.lower())
            if c.price and c.kind is not Kind.FLOAT64:
                raise SchemaError(f"{self.name}: price column {c.name} must be float64, not {c.kind.value}")
            if c.indexed and c.time:
                raise SchemaError(f"{self.name}: the time column orders the records and takes no index")

    @property
    def time(self) -> Column:
        return next(c for c in self.columns if c.time)

    @property
    def time_index(self) -> int:
        return self.columns.index(self.time)

    @property
    def record_size(self) -> int:
        return sum(c.width for c in self.columns)

    def ties(self) -> tuple[str, ...]:
        """The stored columns by which records with one stamp stand, the last declared first: counts and sizes before prices."""
        return tuple(c.stored for c in reversed(self.columns) if not c.time)

    @property
    def stats_columns(self) -> tuple[Column, ...]:
        """Columns whose minima and maxima files carry: all but the time and byte columns."""
        return tuple(c for c in self.columns if not c.time and c.kind is not Kind.BYTES)

    def __len__(self) -> int:
        return len(self.columns)

    def __str__(self) -> str:
        return f"{self.name}({', '.join(f'{c.name}:{c.kind.value}' + '/price' * c.price for c in self.columns)})"

    def field(self, name: str) -> Column:
        for c in self.columns:
            if c.answers_to(name):
                return c
        raise SchemaError(f"{self.name} has no column {name!r}; it has {', '.join(c.name for c in self.columns)}")

    def fields(self, *names: str) -> tuple[Column, ...]:
        return tuple(self.field(n) for n in names)

    def struct(self) -> T.StructType:
        """The columns as a user sees them."""
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind]) for c in self.columns])

    def stored_struct(self) -> T.StructType:
        """The columns as files hold them: prices as scaled longs."""
        return T.StructType([T.StructField(c.stored, T.LongType() if c.price else SPARK_TYPES[c.kind]) for c in self.columns])

    def to_json(self) -> str:
        rows = [dataclasses.asdict(c) | {"kind": c.kind.value} for c in self.columns]
        return json.dumps({"name": self.name, "unit": self.unit.value, "columns": rows}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RecordSchema:
        d = json.loads(text)
        rows = [Column(**(c | {"kind": Kind(c["kind"]), "aliases": tuple(c["aliases"])})) for c in d["columns"]]
        return cls(d["name"], tuple(rows), TimeUnit(d["unit"]))

    @classmethod
    def of(cls, record: type) -> RecordSchema:
        """The schema of a dataclass whose fields carry a ``column`` tag in their metadata.

        A tag is ``name,option,...`` with options time, unit=ms|us|ns, price, signed, primary, index
        and alias=a|b; a first part that is an option leaves the field's own name.  Fields without
        a tag, and those that begin with an underscore, are no columns.
        """
        if record in _made:
            found = _made[record]
            if isinstance(found, SchemaError):
                raise found
            return found
        try:
            _made[record] = cls._build(record)
        except SchemaError as error:
            _made[record] = error
            raise
        return _made[record]

    @classmethod
    def _build(cls, record: type) -> RecordSchema:
        if not (isinstance(record, type) and dataclasses.is_dataclass(record)):
            raise SchemaError(f"{record!r} must be a dataclass")
        hints, columns, unit = typing.get_type_hints(record), [], TimeUnit.MS
        for f in dataclasses.fields(record):
            if f.name.startswith("_") or "column" not in f.metadata:
                continue
            kind, width = kind_of(hints[f.name])
            parts = f.metadata["column"].split(",")
            options: dict = {}
            name = f.name
            for k, part in enumerate(parts):
                key, eq, value = part.partition("=")
                if key in ("time", "price", "primary", "signed") and not eq:
                    options[key] = True
                elif key == "index" and not eq:
                    options["indexed"] = True
                elif key == "unit" and eq:
                    unit = parse_unit(value)
                elif key == "alias" and eq:
                    options["aliases"] = tuple(value.split("|"))
                    if "" in options["aliases"]:
                        raise SchemaError(f"{f.name}: an alias is empty")
                elif k == 0 and not eq:
                    name = part or f.name
                elif not part:
                    raise SchemaError(f"{f.name}: an option is empty")
                else:
                    raise SchemaError(f"{f.name}: no option {part!r}")
            columns.append(Column(name, kind, width, **options))
        return cls(record.__name__, tuple(columns), unit)


_made: dict[type, RecordSchema | SchemaError] = {}


def _price(name: str, signed: bool = False) -> Column:
    return Column(name, Kind.FLOAT64, 8, price=True, signed=signed, indexed=True)


#: A price bar; datetime in milliseconds.
BAR = RecordSchema(
    "Bar",
    (
        Column("datetime", Kind.INT64, 8, ("time", "ts"), time=True, primary=True),
        *map(_price, ("open", "high", "low", "close")),
        Column("tick_volume", Kind.UINT64, 8, ("tickvolume",)),
        Column("spread", Kind.INT32, 4),
        Column("volume", Kind.UINT64, 8),
    ),
)
#: A quote; datetime in microseconds, prices of either sign.
TICK = RecordSchema(
    "Tick",
    (
        Column("datetime", Kind.INT64, 8, ("time", "ts"), time=True, primary=True),
        *(_price(n, True) for n in ("bid", "ask", "last")),
        Column("volume", Kind.UINT64, 8),
        Column("flags", Kind.UINT64, 8),
        Column("volume_ext", Kind.UINT64, 8),
    ),
    TimeUnit.US,
)

#: Which fields of a tick are valid.
FLAG_RAW, FLAG_BID, FLAG_ASK, FLAG_LAST, FLAG_VOLUME, FLAG_BUY, FLAG_SELL = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x40
