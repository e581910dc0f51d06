"""A store in one call: a writer, a reader, and queries for stores of bars."""

from __future__ import annotations

import datetime as dt
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.errors import CorruptError, InvalidRecordError, KeyNotFoundError, UnsupportedError
from tickloom.functions.codec import decode
from tickloom.operators.policy import FlushPolicy
from tickloom.operators.writer import META, StoreWriter, store_schema
from tickloom.plans.planner import Retention
from tickloom.plans.runner import Runner
from tickloom.schema import BAR, RecordSchema
from tickloom.sources.files import Files
from tickloom.sources.footers import file_facts, footer_facts
from tickloom.sources.reader import Reader


class StoreReader(Reader):
    """Reads a store; what was read once stays as it was until ``refresh``.

    A key's records come from its own folder, so opening a store of many keys lists none of them,
    and a missing key is known without a job.
    """

    def __init__(self, spark: SparkSession, path: str, schema: RecordSchema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.files, self.width, self.check_key, self.ties = Files(spark, self.path), 0, True, ()
        self.time, self.names = schema.time.name, [c.name for c in schema.columns]
        if not self.files.is_dir():
            raise InvalidRecordError(f"{path} is not a folder")
        if self.files.exists(META):
            meta = json.loads(self.files.read(META))
            if RecordSchema.from_json(json.dumps(meta["schema"])) != schema:
                raise CorruptError(f"{path} holds {meta['schema']['name']} records, not {schema}")
            self.width = meta["bucket"]
            self.ties = schema.ties() if meta.get("repeats") else ()
        self.refresh()

    def refresh(self) -> None:
        """See what was committed since."""
        self._all: DataFrame | None = None
        self._known: dict[str, DataFrame] = {}
        self._facts: dict[str, tuple[int, int, int]] = {}

    def _load(self, folder: str) -> DataFrame:
        # files only ever go by pruning: a reader that listed one before goes on without it
        files = self.spark.read.schema(store_schema(self.schema, bool(self.width))).option("basePath", f"{self.path}/data").option("ignoreMissingFiles", "true")
        rows = files.parquet(f"{self.path}/{folder}")
        return decode(rows, self.schema, passing=["time_bucket"] if self.width else [])

    @property
    def records(self) -> DataFrame:
        """Every key's records."""
        if self._all is None:
            empty = self.spark.createDataFrame([], store_schema(self.schema, bool(self.width)))
            self._all = self._load("data") if self.files.exists("data") else decode(empty, self.schema, passing=["time_bucket"] if self.width else [])
        return self._all

    def _folder(self, key: str) -> str:
        folder = f"data/key={self.files.escaped(key)}"
        if not self.files.exists(folder):
            raise KeyNotFoundError(f"no key {key!r}")
        return folder

    def of(self, key: str) -> DataFrame:
        """A key's records."""
        if key not in self._known:
            self._known[key] = self._load(self._folder(key)).where(F.col("key") == key)
        return self._known[key]

    _key = of

    def _footers(self, key: str) -> DataFrame:
        return footer_facts(self.spark, self.schema.stored_struct(), f"{self.path}/{self._folder(key)}", self.schema.time.stored)

    def facts(self, key: str) -> tuple[int, int, int]:
        """A key's records, and its first and last stamp, from the footers of its files; kept until ``refresh``."""
        if key not in self._facts:
            row = self._footers(key).first()
            self._facts[key] = (row["n"], row["first"], row["last"])
        return self._facts[key]

    def count(self, key: str) -> DataFrame:
        return self._footers(key).select("n")

    def bounds(self, key: str) -> DataFrame:
        return self._footers(key).select("first", "last")

    def keys(self, prefix: str = "") -> DataFrame:
        """Keys by the folders alone."""
        return self.spark.createDataFrame(pa.table({"key": pa.array(self.list_keys(prefix), pa.string())}))

    def window(self, key: str, start: int = 0, end: int = 0) -> DataFrame:
        rows = super().window(key, start, end)
        if self.width:
            # the bucket follows from the stamp; saying so prunes folders before files are opened
            rows = rows.where(F.col("time_bucket") >= start // self.width)
            rows = rows.where(F.col("time_bucket") <= end // self.width) if end else rows
        return rows

    def segments(self, key: str) -> int:
        """How many files hold the key's records."""
        return len(self.of(key).inputFiles())

    def segment_facts(self, key: str) -> list[tuple[str, int, int, int]]:
        """(file, n, first, last) of a key's files by time, from their footers."""
        return sorted(file_facts(self.spark, self.files.under(self._folder(key)), self.schema.time.stored), key=lambda f: f[2:])

    def verify(self, key: str | None = None) -> int:
        """Read every record of a key, or of all, and count them; CorruptError if a file can't be read,
        or a key holds a stamp twice (where it may not), a negative one or none, or a price that its schema forbids."""
        rows = self.records if key is None else self.of(key)
        time = F.col(self.time)
        bad = time.isNull() | (time < 0)
        for c in self.schema.columns:
            bad = bad | F.col(c.stored).isNull()
            if c.price and not c.signed:
                bad = bad | (F.col(c.stored) < 0)
        per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("stamps"), F.count(F.when(bad, 1)).alias("bad"))
        try:
            n, stamps, faulty = per_key.agg(F.sum("n"), F.sum("stamps"), F.sum("bad")).first()
        except Exception as error:
            raise CorruptError(f"{self.path}: a file can't be read: {str(error).splitlines()[0]}") from error
        if faulty or (n != stamps and not self.ties):
            raise CorruptError(f"{self.path}: {faulty} records are invalid, {n - stamps} repeat a stamp")
        return n or 0

    def list_keys(self, prefix: str = "") -> list[str]:
        """Keys from the folders alone, without reading a file."""
        found = [self.files.unescaped(n[4:]) for n in self.files.folders("data") if n.startswith("key=")]
        return sorted((k for k in found if k.startswith(prefix)), key=str.encode)


class Store:
    """``Store.open(spark, path)`` for both sides; use as a context manager or ``close`` it."""

    def __init__(self, writer: StoreWriter, reader: StoreReader, retention: Retention):
        self.writer, self.reader, self.retention = writer, reader, retention

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: RecordSchema = BAR, *, retention: Retention = Retention(), bucket: dt.timedelta | None = None, segment_records: int = 0, policy: FlushPolicy | None = None, repeats: bool = False) -> Store:
        if not path:
            raise InvalidRecordError("a store needs a folder")
        writer = StoreWriter(spark, path, schema, bucket=bucket, segment_records=segment_records, policy=policy, repeats=repeats)
        return cls(writer, StoreReader(spark, path, schema), retention)

    def query(self) -> Runner:
        """A query runner over the reader; only bars can be queried."""
        if self.reader.schema.name != BAR.name:
            raise UnsupportedError(f"queries need bars; this store holds {self.reader.schema.name}")
        return Runner(self.reader.of, self.retention, bucket=self.reader.width, facts=self.reader.facts, ties=self.reader.ties)

    def refresh(self) -> None:
        self.reader.refresh()

    def close(self) -> None:
        self.writer.close()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
