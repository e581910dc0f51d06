"""Folders for stores that live as long as the driver."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both see it: under ``spark.checkpoint.dir``, or a temporary
    one where the session names none, as in tests.  It is deleted when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{named.rstrip('/') if named else tempfile.mkdtemp(prefix='tickloom-')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; its cluster clears the folder
            return
