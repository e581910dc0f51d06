"""Appending records to a store, in increasing time order for each key: strictly, unless stamps may repeat."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import astuple, is_dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.errors import BusyError, CorruptError, InvalidRecordError, OutOfOrderError
from tickloom.functions.codec import encode, faults, scale_price
from tickloom.operators.policy import FlushPolicy
from tickloom.schema import Kind, RecordSchema, TimeUnit
from tickloom.sources.files import Files
from tickloom.sources.footers import file_facts, footer_session

META = "_meta.json"
LOCK = "_writer.lock"
MOST_KEY_BYTES = 255
#: Keys of a batch up to which their folders are named one by one; beyond, all folders are listed by Spark.
NAMED_KEYS = 256


def check_key(key: str) -> None:
    if not key or len(key.encode()) > MOST_KEY_BYTES:
        raise InvalidRecordError(f"a key has 1 to {MOST_KEY_BYTES} bytes")


def store_schema(schema: RecordSchema, bucketed: bool) -> T.StructType:
    fields = [*schema.stored_struct().fields, T.StructField("key", T.StringType())]
    return T.StructType(fields + [T.StructField("time_bucket", T.LongType())] * bucketed)


class StoreWriter:
    """The one writer of a store: a folder of Parquet files by key, and by time bucket if asked for.

    A batch is checked whole before any of it is seen, and comes by one commit.  Each
    flush is a new group of files; files never change.  With a ``policy`` rows wait in memory until
    ``sync``, ``sync_if_due``, ``seal`` or ``close``.  With ``lock`` a second writer that asks for
    the lock too is refused with BusyError until this one is closed.  With ``repeats``, for all of
    the store's life, records of a key may share a stamp, and all of them are kept.
    """

    def __init__(self, spark: SparkSession, path: str, schema: RecordSchema, *, bucket: dt.timedelta | None = None, segment_records: int = 0, policy: FlushPolicy | None = None, lock: bool = False, repeats: bool = False):
        self.spark, self.path, self.schema, self.repeats = spark, path.rstrip("/"), schema, repeats
        self.files, self.policy, self.segment_records = Files(spark, self.path), policy, segment_records
        self.width = 0
        if bucket is not None:
            self.width = schema.unit.ticks(bucket)
            if schema.unit is TimeUnit.UNKNOWN or self.width < 1:
                raise InvalidRecordError(f"a bucket of {bucket} holds no stamp of unit {schema.unit.value}")
        self.files.make()
        meta = json.dumps({"schema": json.loads(schema.to_json()), "bucket": self.width} | ({"repeats": True} if repeats else {}), sort_keys=True)
        if not self.files.exists(META):
            self.files.write(META, meta)
        elif self.files.read(META) != meta:
            raise CorruptError(f"{self.path} holds other records or buckets than {schema}, or differs in whether stamps may repeat")
        self._locked = lock
        if lock and not self.files.create(LOCK):
            raise BusyError(f"{self.path} has a writer; if that one is gone, delete {LOCK}")
        self._last: dict[str, int] = {}
        self._touched: set[str] = set()
        self._kept: list[str] = []
        self._waiting: dict[str, list[tuple]] = {}
        self._closed = False

    # reading back

    def stored(self) -> DataFrame:
        """All committed records in stored form."""
        shape = store_schema(self.schema, bool(self.width))
        if not self.files.exists("data"):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")

    def last(self, key: str) -> int | None:
        """The newest stamp of a key, waiting rows included.

        Only the key's own folder is looked at, of a bucketed store only its newest bucket, and
        there the footers of its files answer.
        """
        if key not in self._last:
            folder = f"data/key={self.files.escaped(key)}"
            if not self.files.exists(folder):
                return None
            if self.width:
                buckets = [b for b in self.files.folders(folder) if b.startswith("time_bucket=")]
                if not buckets:
                    return None
                folder = f"{folder}/{max(buckets, key=lambda b: int(b.partition('=')[2]))}"
            found = footer_session(self.spark).read.schema(self.schema.stored_struct()).parquet(f"{self.path}/{folder}").agg(F.max(self.schema.time.stored)).first()[0]
            if found is None:
                return None
            self._last[key] = found
        return self._last[key]

    def keys(self) -> list[str]:
        """Keys that this writer has appended to, sorted; what it only read is not among them."""
        return sorted(self._touched)

    # appending

    def append(self, key: str, record) -> None:
        self.append_batch(key, [record])

    def append_batch(self, key: str, records: Sequence) -> None:
        """Append records, given in time order.  If one of them can't be stored, none is."""
        self._open()
        check_key(key)
        rows = [self._row(r, i) for i, r in enumerate(records)]
        if not rows:
            return
        last, at = self.last(key), self.schema.time_index
        for i, row in enumerate(rows):
            if last is not None and (row[at] < last or row[at] == last and not self.repeats):
                raise OutOfOrderError(f"record {i}: stamp {row[at]} does not follow {last}")
            last = row[at]
        if self.policy is None:
            self._write(self._frame({key: rows}))
        else:
            self._waiting.setdefault(key, []).extend(rows)
            self.policy.append(len(rows) * self.schema.record_size)
        self._last[key] = last
        self._touched.add(key)

    def _row(self, record, index: int) -> tuple:
        """A record as a tuple of checked values."""
        names = [c.name for c in self.schema.columns]
        if isinstance(record, dict):
            values = tuple(record.get(n) for n in names)
        elif is_dataclass(record):
            values = astuple(record)
        else:
            values = tuple(record)
        if len(values) != len(names):
            raise InvalidRecordError(f"record {index}: {len(values)} values for {len(names)} columns")
        for c, v in zip(self.schema.columns, values, strict=True):
            if v is None:
                raise InvalidRecordError(f"record {index}: {c.name} is missing")
            if c.price:
                try:
                    scale_price(v, c.signed)
                except InvalidRecordError as error:
                    raise type(error)(f"record {index}: {c.name}: {error}") from error
            elif c.time and v < 0:
                raise InvalidRecordError(f"record {index}: {c.name} {v} is negative")
            elif c.kind is Kind.BYTES and len(v) != c.width:
                raise InvalidRecordError(f"record {index}: {c.name} is not {c.width} bytes")
            elif (bounds := c.kind.bounds) and not bounds[0] <= v <= bounds[1]:
                raise InvalidRecordError(f"record {index}: {c.name} {v} is out of range")
        return tuple(float(v) if c.price else v for c, v in zip(self.schema.columns, values, strict=True))

    def append_frame(self, records: DataFrame, *, late: str = "error") -> None:
        """Append a DataFrame of key and the schema's columns, of any size and many keys.

        Rows have no order of their own, so a key's stamps have to be distinct and after its stored
        ones.  ``late="drop"`` leaves out rows that aren't after, and repeats within the batch.  Where
        stamps may repeat, a batch may hold them more than once and begin at the last stored one, and
        ``late="drop"`` leaves out only what isn't after the stored ones.

        A batch is written in its final layout to a folder beside the data, in one shuffle, and its files
        are moved when all checks have passed, so what was checked is what is stored.  Repeats are found
        in the shuffle's own order, each key's first and last stamp in the footers of the new files.  Of
        the store only the batch's keys are looked at, and of those only row groups with stamps that the
        batch's first stamp does not follow: in order, none.
        """
        self._open()
        self._flush()
        rows = records.select("key", *[c.name for c in self.schema.columns])
        if late == "drop":
            rows = self._without_late(rows)
        staged = f"_staged/{uuid.uuid4().hex}"
        try:
            found = self._stage(rows, staged, drop=late == "drop")
            if not found["n"]:
                return
            for i, (what, error, _) in enumerate(faults(self.schema)):
                if found[f"f{i}"]:
                    raise error(f"{found[f'f{i}']} records: {what}")
            if found["bad_keys"]:
                raise InvalidRecordError(f"{found['bad_keys']} records: a key has 1 to {MOST_KEY_BYTES} bytes")
            behind, ends = self._behind(staged)
            if (found["repeats"] and not self.repeats) or behind:
                raise OutOfOrderError(f"{found['repeats']} records repeat a stamp of their key; {behind} keys begin at or before a stored stamp")
            self.files.move_files(staged, "data")
            if len(ends) > NAMED_KEYS:
                self._last.clear()
            else:
                self._last |= ends
            # ``keys`` has to return them all, so the driver holds a name a key
            self._touched |= ends.keys()
        finally:
            for folder in (staged, *self._kept):
                self.files.delete(folder)
            self._kept = []

    def _without_late(self, rows: DataFrame) -> DataFrame:
        """``rows`` after each key's stored stamps.  The batch is kept in the store's folder, as it is read twice."""
        kept = f"_staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{kept}")
        self._kept.append(kept)
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{kept}")
        time = self.schema.time.name
        firsts = rows.groupBy("key").agg(F.min(time).alias("first"))
        few = firsts.limit(NAMED_KEYS + 1).collect()
        named = len(few) <= NAMED_KEYS
        first = min((r["first"] for r in few if r["first"] is not None), default=0) if named else rows.agg(F.min(time)).first()[0]
        before = self._stored_lasts([r["key"] for r in few if r["key"] is not None] if named else None, first or 0)
        if named:
            lasts = before.collect()
            if not lasts:
                return rows
            before = self.spark.createDataFrame(lasts, before.schema)
        late = before.withColumnRenamed("last", "stored_last")
        return rows.join(late, "key", "left").where(F.col("stored_last").isNull() | (F.col(time) > F.col("stored_last"))).drop("stored_last")

    def _stage(self, rows: DataFrame, staged: str, *, drop: bool) -> dict[str, int]:
        """Write ``rows`` in their final layout to ``staged``; how many there are, and what is wrong with how many.

        With ``drop`` of the records with one stamp one is written, unless stamps may repeat.
        """
        rules = faults(self.schema)
        bad_key = F.col("key").isNull() | ~F.octet_length("key").between(1, MOST_KEY_BYTES)
        # a number a record says which rule it breaks; it travels with the record and is counted behind the shuffle
        fault = F.when(bad_key, len(rules))
        for i, (_, _, bad) in enumerate(rules):
            fault = fault.when(bad, i)
        out, parts = self._laid_out(rows.withColumn("_fault", F.coalesce(fault, F.lit(-1))), ["_fault"])
        # equal keys and stamps are neighbours in one range already
        twin = F.row_number().over(Window.partitionBy(*parts, self.schema.time.stored).orderBy(self.schema.time.stored)) > 1
        out = out.withColumn("_twin", F.lit(False) if self.repeats else twin)
        out = out.where("NOT _twin") if drop else out
        seen = Observation()
        counts = [F.count(F.when(F.col("_fault") == i, 1)).alias(f"f{i}") for i in range(len(rules) + 1)]
        out = out.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_twin"), 1)).alias("repeats"), *counts)
        self._save(out.drop("_fault", "_twin"), parts, staged)
        found = seen.get
        return found | {"bad_keys": found[f"f{len(rules)}"]}

    def _behind(self, staged: str) -> tuple[int, dict[str, int]]:
        """How many keys of a staged batch begin at or before a stored stamp (before, if stamps may repeat), and the last stamp of each."""
        time, shape = self.schema.time.stored, store_schema(self.schema, bool(self.width))
        files = footer_session(self.spark).read.schema(shape).parquet(f"{self.path}/{staged}")
        per_key = files.groupBy("key").agg(F.min(time).alias("first"), F.max(time).alias("end")).collect()
        first = min(r["first"] for r in per_key)
        if len(per_key) <= NAMED_KEYS:
            held = [r["key"] for r in per_key if self.files.exists(f"data/key={self.files.escaped(r['key'])}")]
            lasts = {r["key"]: r["last"] for r in self._stored_lasts(held, first).collect()} if held else {}
            behind = sum(r["first"] < lasts.get(r["key"], -1) + (not self.repeats) for r in per_key)
        else:
            firsts = self.spark.createDataFrame([(r["key"], r["first"]) for r in per_key], "key string, first long")
            behind = self._stored_lasts(None, first).join(firsts, "key").where("first < last" if self.repeats else "first <= last").count()
        return behind, {r["key"]: r["end"] for r in per_key}

    def _stored_lasts(self, keys: list[str] | None, first: int) -> DataFrame:
        """(key, last): of these keys, or of all, those with stored stamps of ``first`` or later."""
        time, shape = self.schema.time.stored, store_schema(self.schema, bool(self.width))
        rows = self.stored() if keys is None else None
        if keys is not None:
            folders = [f"data/key={self.files.escaped(k)}" for k in keys]
            paths = [f"{self.path}/{f}" for f in folders if self.files.exists(f)]
            if not paths:
                return self.spark.createDataFrame([], "key string, last long")
            rows = self.spark.read.schema(shape).option("basePath", f"{self.path}/data").parquet(*paths)
        rows = rows.where(F.col(time) >= first)
        if self.width:
            rows = rows.where(F.col("time_bucket") >= first // self.width)
        return rows.groupBy("key").agg(F.max(time).alias("last"))

    def _frame(self, rows: dict[str, Iterable[tuple]]) -> DataFrame:
        shape = T.StructType([T.StructField("key", T.StringType()), *self.schema.struct().fields])
        return self.spark.createDataFrame([(k, *r) for k, own in rows.items() for r in own], shape)

    def _laid_out(self, rows: DataFrame, passing: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
        """Records in stored form, in ranges of key and time, and the columns that name their folders."""
        time, parts = self.schema.time.stored, ["key"]
        out = encode(rows, self.schema).select(*[c.stored for c in self.schema.columns], "key", *passing)
        if self.width:
            # whole division: a quotient of doubles would put stamps beyond 2**53 in the next bucket
            out = out.withColumn("time_bucket", F.expr(f"`{time}` div {self.width}L"))
            parts.append("time_bucket")
        # a hot key spans several tasks, and files are in time order
        return out.repartitionByRange(*parts, time), parts

    def _save(self, out: DataFrame, parts: list[str], folder: str) -> None:
        ties = [F.col(c) for c in self.schema.ties()] if self.repeats else []
        writer = out.sortWithinPartitions(*parts, self.schema.time.stored, *ties).write.mode("append").partitionBy(*parts)
        if self.segment_records:
            writer = writer.option("maxRecordsPerFile", self.segment_records)
        writer.parquet(f"{self.path}/{folder}")

    def _write(self, rows: DataFrame) -> None:
        self._save(*self._laid_out(rows), "data")

    # flushing and closing

    def sync(self) -> None:
        """Write what waits, as one commit; after it everything appended is durable."""
        self._open()
        self._flush()

    def _flush(self) -> None:
        rows = {k: v for k, v in self._waiting.items() if v}
        if rows:
            self._write(self._frame(rows))
            self._waiting = {}
        if self.policy is not None:
            self.policy.flushed()

    def sync_if_due(self) -> bool:
        """Sync if the policy says so; without a policy never.  Whether it did."""
        if self.policy is None or not self.policy.due():
            return False
        self.sync()
        return True

    def seal(self, key: str) -> None:
        """End a key's file group: its waiting rows are written, and what follows goes to new files."""
        self._open()
        rows = self._waiting.pop(key, None)
        if rows:
            self._write(self._frame({key: rows}))
            self.policy.flushed(len(rows) * self.schema.record_size)

    def close(self) -> None:
        """Write what waits and take no more.  Closing again does nothing."""
        if not self._closed:
            self._flush()
            self._closed = True
            if self._locked:
                self.files.delete(LOCK)

    def _open(self) -> None:
        if self._closed:
            raise InvalidRecordError("the writer is closed")

    # dropping old files

    def _segments(self) -> Iterator[tuple]:
        """A tuple a file, as the columns of ``segments``; one key's files are held at a time."""
        time = self.schema.time.stored
        for folder in self.files.folders("data"):
            if not folder.startswith("key="):
                continue
            found = sorted((f for f in file_facts(self.spark, self.files.under(f"data/{folder}"), time) if f[1]), key=lambda f: f[2:])
            newest = max((last for *_, last in found), default=None)
            for seq, (path, n, first, last) in enumerate(found):
                yield self.files.unescaped(folder[4:]), seq, first, last, n, path, last == newest

    def segments(self) -> DataFrame:
        """A row a file, from the footers: key, seq (by time within the key), min_ts, max_ts, n, file, active."""
        return self.spark.createDataFrame(list(self._segments()), "key string, seq long, min_ts long, max_ts long, n long, file string, active boolean")

    def prune(self, predicate: Callable[[str, int, int, int, bool], bool]) -> int:
        """Delete whole files that ``predicate(key, seq, min_ts, max_ts, sealed)`` picks; never a key's newest.

        Only footers are read.  Returns how many files went.  A reader that knew of them goes on
        without them.
        """
        gone = 0
        for key, seq, first, last, _, path, active in self._segments():
            if not active and predicate(key, seq, first, last, True):
                self.files.delete_file(path)
                gone += 1
        return gone
