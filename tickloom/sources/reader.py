"""Direct reads of a key's records, and what is known of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tickloom.functions.codec import scale_price
from tickloom.plans.planner import in_window, of_key, require_key
from tickloom.schema import RecordSchema


Bounds = Iterable[tuple[str, float | None, float | None]]


class Reader:
    """Reads over records: a DataFrame of key and a schema's columns.

    A limit takes the newest records of the window, unlike a query's, which takes the oldest
    matches unless told otherwise.  A bound of 0 leaves that side of the window open.  Records with
    one stamp, where there can be such, stand in the order of the columns ``ties``.
    """

    ties: tuple[str, ...] = ()

    def __init__(self, records: DataFrame, schema: RecordSchema, *, check_key: bool = True):
        self.records, self.schema, self.check_key = records, schema, check_key
        self.time = schema.time.name
        self.names = [c.name for c in schema.columns]

    def _key(self, key: str) -> DataFrame:
        if self.check_key:
            require_key(self.records, key)
        return of_key(self.records, key)

    def window(self, key: str, start: int = 0, end: int = 0) -> DataFrame:
        """The window's records with their stored columns, in no order."""
        return self._key(key).where(in_window(start, end or None, self.time))

    def _ordered(self, rows: DataFrame, newest: bool = False) -> DataFrame:
        return rows.orderBy(F.desc(self.time) if newest else F.asc(self.time), *self.ties)

    def _newest(self, rows: DataFrame, limit: int) -> DataFrame:
        return self._ordered(rows, True).limit(limit) if limit > 0 else rows

    def range(self, key: str, start: int = 0, end: int = 0, limit: int = 0) -> DataFrame:
        """The window's newest ``limit`` records (all if 0 or less), oldest first."""
        return self._ordered(self._newest(self.window(key, start, end), limit)).select(self.names)

    def all(self, key: str, start: int = 0, end: int = 0, limit: int = 0) -> Iterator[Row]:
        return self.range(key, start, end, limit).toLocalIterator()

    def latest(self, key: str, n: int = 0) -> DataFrame:
        """The newest ``n`` records, oldest first; all if n is 0 or less."""
        return self.range(key, limit=n)

    def cursor_frame(self, key: str, start: int = 0, end: int = 0, limit: int = 0) -> DataFrame:
        """Oldest first without a limit, newest first with one."""
        rows = self._newest(self.window(key, start, end), limit)
        return self._ordered(rows, limit > 0).select(self.names)

    def cursor(self, key: str, start: int = 0, end: int = 0, limit: int = 0) -> Iterator[Row]:
        return self.cursor_frame(key, start, end, limit).toLocalIterator()

    def cursor_desc(self, key: str, start: int = 0, end: int = 0, limit: int = 0) -> Iterator[Row]:
        """Newest first; a limit caps the rows."""
        rows = self._newest(self.window(key, start, end), limit)
        return self._ordered(rows, True).select(self.names).toLocalIterator()

    def bounded(self, key: str, bounds: Bounds, start: int = 0, end: int = 0, limit: int = 0) -> DataFrame:
        """The window's newest ``limit`` records within ``bounds``, in no order.

        ``bounds`` are (column, least, most), both inclusive, None for an open side; prices are as
        users see them.  They reach the files, so row groups that hold nothing of them are skipped.
        """
        rows = self.window(key, start, end)
        for name, least, most in bounds:
            column = self.schema.field(name)
            as_stored = (lambda v: scale_price(v, True)) if column.price else (lambda v: v)
            if least is not None:
                rows = rows.where(F.col(column.stored) >= F.lit(as_stored(least)))
            if most is not None:
                rows = rows.where(F.col(column.stored) <= F.lit(as_stored(most)))
        return self._newest(rows, limit)

    def all_bounds(self, key: str, bounds: Bounds, start: int = 0, end: int = 0, limit: int = 0) -> Iterator[Row]:
        """``all`` within bounds, oldest first."""
        return self._ordered(self.bounded(key, bounds, start, end, limit)).select(self.names).toLocalIterator()

    def cursor_filtered(self, key: str, bounds: Bounds, start: int = 0, end: int = 0, limit: int = 0) -> Iterator[Row]:
        """``cursor`` within bounds: oldest first without a limit, newest first with one."""
        return self._ordered(self.bounded(key, bounds, start, end, limit), limit > 0).select(self.names).toLocalIterator()

    def cursor_desc_filtered(self, key: str, bounds: Bounds, start: int = 0, end: int = 0, limit: int = 0) -> Iterator[Row]:
        """``cursor_desc`` within bounds."""
        return self._ordered(self.bounded(key, bounds, start, end, limit), True).select(self.names).toLocalIterator()

    def range_into(self, into: list[Row], key: str, start: int = 0, end: int = 0, limit: int = 0) -> list[Row]:
        """``range`` into a list that the caller keeps: what it held is gone."""
        into[:] = self.range(key, start, end, limit).collect()
        return into

    def scan(self, key: str, visit: Callable[[Row], bool], start: int = 0, end: int = 0, limit: int = 0) -> None:
        """Call ``visit`` on each record, oldest first, until it returns False."""
        for row in self.all(key, start, end, limit):
            if visit(row) is False:
                return

    def at(self, key: str, stamp: int) -> DataFrame:
        """The record of one stamp, if there is one; all of them where stamps repeat."""
        return self._key(key).where(F.col(self.time) == stamp).select(self.names)

    def keys(self, prefix: str = "") -> DataFrame:
        """Distinct keys that begin with ``prefix``, sorted by bytes."""
        rows = self.records.where(F.col("key").startswith(prefix)) if prefix else self.records
        return rows.select("key").distinct().orderBy("key")

    def bounds(self, key: str) -> DataFrame:
        """first and last stamp."""
        return self._key(key).agg(F.min(self.time).alias("first"), F.max(self.time).alias("last"))

    def count(self, key: str) -> DataFrame:
        """n, the number of records."""
        return self._key(key).agg(F.count(F.lit(1)).alias("n"))

    def retention_floor(self, key: str, keep: int, start: int = 0, end: int = 0) -> DataFrame:
        """floor: the stamp of the keep-th newest record of the window, or its start if it has no more than ``keep``."""
        newest = self.window(key, start, end).select(self.time).orderBy(F.desc(self.time)).limit(max(keep, 0))
        kept = newest.agg(F.count(F.lit(1)).alias("c"), F.min(self.time).alias("m"))
        return kept.select(F.when((F.col("c") == keep) & (F.lit(keep) > 0), F.col("m")).otherwise(F.lit(start)).cast("long").alias("floor"))
