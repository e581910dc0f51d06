"""Queries to DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.errors import InvalidRecordError, KeyNotFoundError
from tickloom.functions.codec import truncated, unsigned32
from tickloom.plans.query import Cond, Field, Op, Query
from tickloom.schema import BAR


@dataclass(frozen=True)
class Retention:
    """What a query may see of a key: at most ``max_bars`` newest records of its window, none older
    than ``max_age`` milliseconds before the key's newest.  0 means all."""

    max_bars: int = 0
    max_age: int = 0

    def __post_init__(self) -> None:
        if self.max_bars < 0 or self.max_age < 0:
            raise InvalidRecordError("retention can't be negative")


_COMPARE = {Op.EQ: "__eq__", Op.NE: "__ne__", Op.LT: "__lt__", Op.LTE: "__le__", Op.GT: "__gt__", Op.GTE: "__ge__"}


def condition(cond: Cond, *, price_compare: str = "round") -> Column:
    """A condition as a column: integers against integers, so that prices compare exactly.

    ``price_compare="truncate"`` compares prices multiplied again and cut, which loses some
    two-decimal prices by a unit.  A spread compares by its bits, as an unsigned number.
    """
    if cond.field.is_price:
        col = F.col(BAR.field(cond.field.value).stored) if price_compare == "round" else truncated(F.col(cond.field.value))
    elif cond.field is Field.SPREAD:
        col = unsigned32(F.col("spread"))
    else:
        col = F.col(cond.field.value)
    return getattr(col, _COMPARE[cond.op])(F.lit(cond.stored).cast("long"))


def every(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def in_window(start: int, end: int | None, time: str = "datetime") -> Column:
    """An inclusive window; a start of 0 and an end of None are open."""
    return every([F.col(time) >= start] * bool(start) + [F.col(time) <= end] * (end is not None))


def of_key(records: DataFrame, key: str) -> DataFrame:
    return records.where(F.col("key") == key)


def require_key(records: DataFrame, key: str) -> None:
    """KeyNotFoundError unless a record was ever stored under the key."""
    if of_key(records, key).limit(1).isEmpty():
        raise KeyNotFoundError(f"no key {key!r}")


def age_cut(records: DataFrame, key: str, max_age: int, time: str = "datetime") -> int:
    """The oldest stamp that ``max_age`` leaves, or 0.  A job of its own over one column, so that the
    cut is a literal and reaches the files."""
    last = of_key(records, key).agg(F.max(time)).first()[0]
    return 0 if last is None or last <= max_age else last - max_age


#: Records of a key from which on a limit probes the end that it wants before it reads the rest.
PROBE_ROWS = 1_000_000
#: How much longer each probe is than all before it.
WIDER = 8


def near_end(rows: DataFrame, limit: int, newest: bool, span: tuple[int, int], n: int, bucket: int) -> DataFrame:
    """``rows`` cut to a stretch at one end of the time ``span`` that holds ``limit`` of them, or all.

    Stretches grow from what would do if every record counted.  Each is counted once, no further
    than the limit, and files outside it aren't read.
    """
    low, high = span
    width, found, done = max(1, (high - low + 1) * 2 * limit // n), 0, 0
    while width <= high - low:
        near, far = (high - width + 1, high - done) if newest else (low + done, low + width - 1)
        found += rows.where(in_buckets(near, far, bucket) & in_window(near, far)).limit(limit - found).count()
        if found >= limit:
            return rows.where(in_buckets(near, high, bucket) & in_window(near, high) if newest else in_buckets(low, far, bucket) & in_window(low, far))
        width, done = width * WIDER, width
    return rows


def in_buckets(low: int, high: int | None, bucket: int) -> Column:
    """The time buckets of a window; they follow from the stamps, and saying so prunes folders before files are opened."""
    return in_window(low // bucket, None if high is None else high // bucket, "time_bucket") if bucket else F.lit(True)


def by_time(rows: DataFrame, newest: bool, ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` by their stamps; records with one stamp by the columns ``ties``, in either direction."""
    return rows.orderBy(F.desc("datetime") if newest else F.asc("datetime"), *ties)


def plan(query: Query, bars: DataFrame, retention: Retention = Retention(), *, price_compare: str = "round", bucket: int = 0, facts: Callable[[str], tuple[int, int, int]] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The query's records in stored form, limited but in no order that a reader may rely on.

    Order of work: key, window and range conditions on datetime, age, newest ``max_bars``; then the
    other conditions, then the limit.  Catalyst pushes what it may to the files; a filter never
    passes below the inner limit.  ``bucket`` is the width of the store's time buckets, if it has
    them.  With ``facts`` limits over large keys stop at the end they want.  Where stamps repeat,
    ``ties`` are the columns that decide which of them a limit takes.
    """
    rows = of_key(bars, query.key)
    low, high = query.window()
    known = facts(query.key) if facts and (retention.max_age or retention.max_bars or query.limit) else None
    known = known if known and known[0] else None
    if retention.max_age:
        low = max(low, max(0, known[2] - retention.max_age) if known else age_cut(bars, query.key, retention.max_age))
    rows = rows.where(in_buckets(low, high, bucket) & in_window(low, high))

    def limited(rows: DataFrame, limit: int, newest: bool) -> DataFrame:
        if known and known[0] > max(PROBE_ROWS, 4 * limit):
            rows = near_end(rows, limit, newest, (max(low, known[1]), known[2] if high is None else min(high, known[2])), known[0], bucket)
        return by_time(rows, newest, ties).limit(limit)

    if retention.max_bars:
        rows = limited(rows, retention.max_bars, True)
    ranges = (Op.GT, Op.GTE, Op.LT, Op.LTE)
    left = [c for c in query.conds if not (c.field is Field.DATETIME and c.op in ranges)]
    rows = rows.where(every([condition(c, price_compare=price_compare) for c in left]))
    if query.limit and retention.max_bars:
        return by_time(rows, query.newest_first_, ties).limit(query.limit)
    return limited(rows, query.limit, query.newest_first_) if query.limit else rows


def project(rows: DataFrame, query: Query, *, zero_fill: bool = False) -> DataFrame:
    """The selected fields in declaration order; with ``zero_fill`` the others as typed zeros."""
    wanted = query.fields or tuple(Field)
    struct = BAR.struct()
    return rows.select(*[F.col(f.value) if f in wanted else F.lit(0).cast(struct[f.value].dataType).alias(f.value) for f in Field if zero_fill or f in wanted])
