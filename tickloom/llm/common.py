"""Helpers that the operators share: table access, scratch tables, unique names, global order."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Most rows that a side may have before it is joined by a shuffle and not by a broadcast.
BROADCAST_ROWS = 20_000
#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 4 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests in local mode) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: losing an executor later costs a read, not the work so far.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(delete_at_exit(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hit = next((m for m in _made if path.endswith(re.sub("^[A-Za-z0-9+.-]+:/*", "", m[1]).lstrip("/"))), None)
        if hit:
            _made.remove(hit)
            _delete(*hit)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its cluster clears the folder
            return


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches to Python bounded by bytes in its session, since texts have no usual length.

    Sets spark.sql.execution.arrow.maxBytesPerBatch to BATCH_BYTES if it is larger.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, str(1 << 30)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet (names are compared without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key_text(*cols: Column) -> Column:
    """The columns as one text for hashing; null differs from every value."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for c in cols])


def unit_hash(text: Column) -> Column:
    """A double in (0, 1) from 52 bits of the MD5 of ``text``."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def power_of_two(rows: int, each: int, most: int = 1 << 24) -> int:
    """How many buckets of about ``each`` rows hold ``rows``, as a power of two."""
    n = 1
    while n < most and n * each < rows:
        n *= 2
    return n


#: Buckets up to which their offsets go to every task; beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 16
#: Buckets whose running sums one task adds up.
SPAN = 1 << 12


def with_offsets(df: DataFrame, bucket: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """For each bucket, what all smaller buckets hold: one row a bucket, pre-aggregated.

    ``sums`` maps a result name to the column to add up.  Buckets are integers from 0.  Running sums
    are taken in spans of ``span`` buckets, and then over the spans: a task sees a span, or one row a span.
    """
    per = df.groupBy(bucket).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).withColumn("wo_span", F.floor(F.col(bucket) / span).cast("long"))
    before = Window.partitionBy("wo_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    spans = per.groupBy("wo_span").agg(*[F.sum(n).alias(f"wo_{n}") for n in sums])
    earlier = Window.orderBy("wo_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("wo_span", *[F.coalesce(F.sum(f"wo_{n}").over(earlier), F.lit(0)).alias(f"wo_{n}") for n in sums])
    inner = per.select(bucket, "wo_span", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
    return inner.join(spans, "wo_span").select(bucket, *[(F.col(n) + F.col(f"wo_{n}")).alias(n) for n in sums])


def sent(df: DataFrame, buckets: int) -> DataFrame:
    """The offsets of ``buckets`` buckets, marked for a broadcast if they are few enough."""
    return F.broadcast(df) if buckets <= BROADCAST_BUCKETS else df


def range_number(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, found in two steps of about their square root."""
    if not cuts:
        return F.lit(0)
    each = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + each] for i in range(0, len(cuts), each)]
    longs = lambda own: F.array(*[F.lit(c).cast("long") for c in own])
    # of a row whose last cut is below the value all are; the next row is looked through
    full = F.size(F.filter(longs([r[-1] for r in rows]), lambda c: c < value))
    last = F.get(F.array(*[longs(r) for r in rows]), full)
    return full * each + F.when(full < len(rows), F.size(F.filter(last, lambda c: c < value))).otherwise(len(rows[-1]) - each)


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, whose parent folder will be deleted when the driver ends."""
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def small_or_none(df: DataFrame, most: int = BROADCAST_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``most`` of them, else None."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def keyed_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the integer columns ``key``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
        edges = [0, *(np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(k[lo]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(k[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(df: DataFrame, blocks: Column, id_col: str) -> DataFrame:
    """``df`` with i, j, own: each row goes to every pair of blocks (i <= j) that has its own block."""
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = df.withColumn("own", F.pmod(F.xxhash64(id_col), blocks).cast("int")).withColumn("task", F.explode(meets))
    return dealt.withColumns({"i": F.col("task.i"), "j": F.col("task.j")}).drop("task")
