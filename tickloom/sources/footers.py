"""Answers from the footers of Parquet files: counts, minima and maxima without reading a row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_sessions: dict[int, tuple[SparkSession, SparkSession]] = {}


def footer_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose Parquet reads push aggregates down to the footers.

    The push-down needs the newer reader, which other reads of the user's session should not get.
    """
    held = _sessions.get(id(spark))
    if held is None or held[0] is not spark:
        own = spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
            value = spark.conf.get(key, None)
            if value is not None and own.conf.get(key, None) != value:
                own.conf.set(key, value)
        own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        _sessions[id(spark)] = held = (spark, own)
    return held[1]


def footer_facts(spark: SparkSession, shape: T.StructType, folder: str, time: str) -> DataFrame:
    """n, first and last of a folder's files."""
    rows = footer_session(spark).read.schema(shape).parquet(folder)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def file_facts(spark: SparkSession, paths: Iterable[str], time: str) -> Iterator[tuple[str, int, int, int]]:
    """(path, n, first, last) of files, read from their footers by a few threads of the driver.

    Spark has no grouping by file that it answers from footers, and scanning the stamps of a store
    reads far more.  Results come one by one, in the order of the paths.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def facts(path: str) -> tuple[str, int, int, int]:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            n, first, last = 0, None, None
            for block in reader.getFooter().getBlocks():
                n += block.getRowCount()
                stats = next(c for c in block.getColumns() if c.getPath().toDotString() == time).getStatistics()
                first = stats.getMin() if first is None else min(first, stats.getMin())
                last = stats.getMax() if last is None else max(last, stats.getMax())
        finally:
            reader.close()
        return path, n, first, last

    with ThreadPoolExecutor(16) as pool:
        yield from pool.map(facts, paths)
