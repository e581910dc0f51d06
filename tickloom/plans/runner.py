"""Running queries: streams ascend always, ``collect`` honours the direction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row

from tickloom.errors import NoMatchError
from tickloom.plans.parser import parse
from tickloom.plans.planner import Retention, by_time, plan, project, require_key
from tickloom.plans.query import Query


class Runner:
    """Answers queries over bars: a DataFrame of key, the bar columns and their stored prices, or what
    gives that of a key and raises KeyNotFoundError itself.  ``facts`` gives a key's number of records
    and its first and last stamp where that is cheap; limits then look at large keys from the end they want.
    ``ties`` are the columns that order records with one stamp, where there can be such."""

    def __init__(self, bars: DataFrame | Callable[[str], DataFrame], retention: Retention = Retention(), *, price_compare: str = "round", check_key: bool = True, bucket: int = 0, facts: Callable[[str], tuple[int, int, int]] | None = None, ties: Sequence[str] = ()):
        self.ties = tuple(ties)
        self.bars, self.retention, self.price_compare, self.check_key, self.bucket, self.facts = bars, retention, price_compare, check_key, bucket, facts

    def _rows(self, query: Query | str) -> tuple[Query, DataFrame]:
        query = parse(query) if isinstance(query, str) else query
        bars = self.bars
        if callable(bars):
            bars = bars(query.key)
        elif self.check_key:
            require_key(bars, query.key)
        return query, plan(query, bars, self.retention, price_compare=self.price_compare, bucket=self.bucket, facts=self.facts, ties=self.ties)

    def frame(self, query: Query | str, *, zero_fill: bool = False) -> DataFrame:
        """The matches, oldest first, whichever end the limit took them from."""
        query, rows = self._rows(query)
        return project(by_time(rows, False, self.ties), query, zero_fill=zero_fill)

    def collected(self, query: Query | str, *, zero_fill: bool = False) -> DataFrame:
        """The matches in the query's own direction."""
        query, rows = self._rows(query)
        return project(by_time(rows, query.newest_first_, self.ties), query, zero_fill=zero_fill)

    def stream(self, query: Query | str) -> Iterator[Row]:
        """The matches one by one, oldest first; errors are raised before the first."""
        return self.frame(query).toLocalIterator()

    run = stream

    def collect(self, query: Query | str) -> list[Row]:
        return self.collected(query).collect()

    def first_frame(self, query: Query | str) -> DataFrame:
        """The first row of the stream: without a limit the oldest match, also for newest-first queries."""
        query, rows = self._rows(query)
        return project(by_time(rows, False, self.ties).limit(1), query)

    def first(self, query: Query | str) -> Row:
        rows = self.first_frame(query).collect()
        if not rows:
            raise NoMatchError("the query matches no record")
        return rows[0]
