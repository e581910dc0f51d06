"""Fixed-point prices, stamps and flags, as columns and as plain numbers."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.errors import InvalidRecordError, PriceRangeError
from tickloom.schema import RecordSchema, TimeUnit

#: Fixed value: stored prices are multiples of 1e-8.
PRICE_SCALE = 100_000_000
#: Spark's longs are signed, so this bounds prices of both kinds.
MOST = (1 << 63) - 1


def scale_price(value: float | Decimal, signed: bool = False) -> int:
    """A price as its stored integer, halves away from zero; a decimal is scaled exactly."""
    if not math.isfinite(value):
        raise InvalidRecordError(f"price {value} is not finite")
    if value < 0 and not signed:
        raise InvalidRecordError(f"price {value} is negative")
    if isinstance(value, Decimal):
        scaled = int((value * PRICE_SCALE).to_integral_value(ROUND_HALF_UP))
    else:
        scaled = int(Decimal(value * PRICE_SCALE).to_integral_value(ROUND_HALF_UP)) if abs(value) < 1e12 else int(value) * PRICE_SCALE
    if abs(scaled) > MOST:
        raise PriceRangeError(f"price {value} is out of range")
    return scaled


def unscale_price(stored: int) -> float:
    return stored / PRICE_SCALE


def scaled(col: Column) -> Column:
    """A price column as stored longs; null where it has none."""
    return F.round(col * F.lit(float(PRICE_SCALE))).try_cast("long")


def unscaled(col: Column) -> Column:
    return col.cast("double") / F.lit(float(PRICE_SCALE))


def truncated(col: Column) -> Column:
    """A price column scaled without rounding: multiplied again and cut, as some stores compare it."""
    return (col * F.lit(float(PRICE_SCALE))).cast("long")


def unsigned32(col: Column) -> Column:
    """A 32-bit column's bits as an unsigned number."""
    return col.cast("long").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))


def has_flags(col: Column, mask: int) -> Column:
    return col.bitwiseAND(F.lit(mask).cast("long")) != 0


def display_time(col: Column, unit: TimeUnit) -> Column:
    """A stamp as a timestamp, in UTC sessions."""
    if unit is TimeUnit.MS:
        return F.timestamp_millis(col)
    if unit is TimeUnit.US:
        return F.timestamp_micros(col)
    # whole division: nanoseconds don't fit a double
    return F.timestamp_micros(F.call_function("div", col, F.lit(1000)))


def encode(df: DataFrame, schema: RecordSchema) -> DataFrame:
    """User columns to stored ones; other columns pass."""
    out = df
    for c in schema.columns:
        if c.price:
            out = out.withColumn(c.stored, scaled(F.col(c.name))).drop(c.name)
    return out


def decode(df: DataFrame, schema: RecordSchema, *, passing: list[str] = []) -> DataFrame:
    """Stored columns to user ones, with the key, the stored prices and the columns in ``passing``."""
    users = [unscaled(F.col(c.stored)).alias(c.name) if c.price else F.col(c.name) for c in schema.columns]
    return df.select("key", *users, *[c.stored for c in schema.columns if c.price], *passing)


def faults(schema: RecordSchema) -> list[tuple[str, type, Column]]:
    """(what is wrong, the exception it is, the condition) for every rule that a record must keep."""
    out: list[tuple[str, type, Column]] = []
    for c in schema.columns:
        col = F.col(c.name)
        out.append((f"{c.name} is null", InvalidRecordError, col.isNull()))
        if c.time:
            out.append((f"{c.name} is negative", InvalidRecordError, col < 0))
        elif c.price:
            out.append((f"{c.name} is not finite", InvalidRecordError, F.isnan(col) | (F.abs(col) == float("inf"))))
            if not c.signed:
                out.append((f"{c.name} is negative", InvalidRecordError, col < 0))
            out.append((f"{c.name} is out of range", PriceRangeError, ~F.isnan(col) & (F.abs(col) * float(PRICE_SCALE) >= float(1 << 63))))
        elif bounds := c.kind.bounds:
            out.append((f"{c.name} is out of range", InvalidRecordError, ~col.cast(T.DecimalType(38, 0)).between(*[F.lit(b).cast(T.DecimalType(38, 0)) for b in bounds])))
        elif c.kind.value == "bytes":
            out.append((f"{c.name} is not {c.width} bytes", InvalidRecordError, F.octet_length(col) != c.width))
    return out
