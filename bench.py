"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then several times; the median counts.  Reads go to a store
that is written first from the events table, as a user of the engine would have it, and then to a
larger one of generated bars (``large_*``), where throughput shows beside the fixed cost of a job.
``rows_per_sec`` counts the records that a query ranges over, ``out_rows_per_sec`` those it returns.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPEATS = 5
#: Bars of the large store: half of them under one key, as the published figures have it, the rest under 50.
LARGE = 10_000_000


def generated(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    price = (F.lit(10_000) + F.pmod(F.xxhash64(i), F.lit(10_000))) / 100
    key = F.when(i % 2 == 0, F.lit("large/one")).otherwise(F.concat(F.lit("large/"), (F.floor(i / 2) % 50).cast("string")))
    return spark.range(n).select(key.alias("key"), (F.lit(1_600_000_000_000) + i * 1000).alias("datetime"), price.alias("open"), (price + 1).alias("high"), (price - 1).alias("low"), price.alias("close"), (i % 1000).alias("tick_volume"), (i % 7).cast("int").alias("spread"), (i % 100_000).alias("volume"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    large = int(os.environ.get("BENCH_LARGE", LARGE))
    sys.path.insert(0, str(Path(__file__).parent))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tickloom import catalogue
    from tickloom.operators.writer import StoreWriter
    from tickloom.plans.planner import Retention
    from tickloom.plans.runner import Runner
    from tickloom.schema import BAR
    from tickloom.store import StoreReader

    root = tempfile.mkdtemp(prefix="tickloom-bench-")
    bars = catalogue.bars(spark, sf_dir).select("key", *[c.name for c in BAR.columns])
    n_all = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    key, t0, t1 = catalogue.KEY, catalogue.T0, catalogue.T1

    def append() -> int:
        path = f"{root}/append"
        shutil.rmtree(path, ignore_errors=True)
        StoreWriter(spark, path, BAR).append_frame(bars)
        return n_all

    def fetched(df: DataFrame) -> int:
        return df.toArrow().num_rows

    def scanned(df: DataFrame) -> int:
        """Every row made on the executors, none brought here."""
        df.write.format("noop").mode("overwrite").save()
        return 0

    StoreWriter(spark, f"{root}/store", BAR).append_frame(bars)
    reader = StoreReader(spark, f"{root}/store", BAR)
    runner = Runner(reader.of, facts=reader.facts)
    kept = Runner(reader.of, Retention(max_bars=50), facts=reader.facts)
    n_key = reader.facts(key)[0]
    tasks = {
        "filter_limit_asc": (n_key, lambda: fetched(runner.frame(f'SELECT * FROM "{key}" WHERE close >= 20 LIMIT 10'))),
        "filter_limit_desc": (n_key, lambda: fetched(runner.collected(f'SELECT * FROM "{key}" WHERE close >= 20 ORDER BY datetime DESC LIMIT 10'))),
        "window": (n_key, lambda: fetched(reader.range(key, t0, t1))),
        "window_limit": (n_key, lambda: fetched(reader.range(key, t0, t1, 501))),
        "full_series": (n_key, lambda: fetched(reader.range(key))),
        "latest": (n_key, lambda: fetched(reader.latest(key, 500))),
        "point_lookup": (n_key, lambda: fetched(reader.at(key, catalogue.STAMP))),
        "ret_maxbars_filter": (n_key, lambda: fetched(kept.frame(f'SELECT * FROM "{key}" WHERE close < 20 LIMIT 8'))),
        "count": (n_key, lambda: fetched(reader.count(key))),
        "bounds": (n_key, lambda: fetched(reader.bounds(key))),
        "keys": (n_all, lambda: fetched(reader.keys())),
        "append_all": (n_all, append),
    }
    seconds, rates, out_rates = {}, {}, {}

    def timed(name: str, rows: int, task, repeats: int = REPEATS) -> None:
        took = []
        for k in range(repeats + 1):
            began = time.perf_counter()
            out = task()
            if k or not repeats:
                took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 4)
        rates[name], out_rates[name] = round(rows / statistics.median(took)), round(out / statistics.median(took))

    for name, (rows, task) in tasks.items():
        timed(name, rows, task)

    if large:
        one, start = "large/one", 1_600_000_000_000
        half = large // 2
        timed("large_append", large, lambda: StoreWriter(spark, f"{root}/large", BAR).append_frame(generated(spark, large)) or large, repeats=0)
        timed("large_append_next", large // 10, lambda: StoreWriter(spark, f"{root}/large", BAR).append_frame(generated(spark, large // 10).withColumn("datetime", F.col("datetime") + large * 1000)) or large // 10, repeats=0)
        store = StoreReader(spark, f"{root}/large", BAR)
        asks, mid = Runner(store.of, facts=store.facts), start + half * 1000
        tasks = {
            "large_filter_limit_asc": lambda: fetched(asks.frame(f'SELECT * FROM "{one}" WHERE close >= 103 LIMIT 10')),
            "large_filter_limit_desc": lambda: fetched(asks.collected(f'SELECT * FROM "{one}" WHERE close >= 103 ORDER BY datetime DESC LIMIT 10')),
            "large_window_501": lambda: fetched(store.range(one, mid, mid + 1_000_000)),
            "large_latest": lambda: fetched(store.latest(one, 500)),
            "large_point_lookup": lambda: fetched(store.at(one, mid)),
            "large_count": lambda: fetched(store.count(one)),
            "large_filter_scan": lambda: fetched(asks.frame(f'SELECT datetime, close FROM "{one}" WHERE close >= 199.9')),
            "large_series_scan": lambda: scanned(store.window(one).select(store.names)),
            "large_series_sorted": lambda: scanned(store.range(one)),
            "large_full_series": lambda: fetched(store.range(one)),
        }
        for name, task in tasks.items():
            timed(name, half + large // 20, task, repeats=2)
    shutil.rmtree(root, ignore_errors=True)
    spark.stop()
    small = sum(v for k, v in seconds.items() if not k.startswith("large_"))
    print(json.dumps({"metric": "total_seconds", "value": round(small, 4), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "out_rows_per_sec": out_rates, "rows": {"key": n_key, "all": n_all, "large": large}, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
