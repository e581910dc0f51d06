"""Queries, reads and stores on Spark, against expected answers and a plain filter."""

from __future__ import annotations

import datetime as dt
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from tickloom import catalogue
from tickloom.errors import BusyError, CorruptError, InvalidRecordError, KeyNotFoundError, NoMatchError, OutOfOrderError, ParseError, PriceRangeError, UnsupportedError
from tickloom.functions.codec import display_time, has_flags
from tickloom.operators import writer
from tickloom.operators.policy import FlushPolicy
from tickloom.operators.writer import StoreWriter
from tickloom.plans import planner
from tickloom.plans.planner import Retention
from tickloom.plans.query import Field, Op, Query
from tickloom.plans.runner import Runner
from tickloom.schema import BAR, FLAG_BID, FLAG_LAST, TICK, Kind, RecordSchema, TimeUnit
from tickloom.schema import Column as SchemaColumn
from tickloom.sources.adapters import with_stored
from tickloom.sources.reader import Reader
from tickloom.store import Store, StoreReader
from tickloom.streaming.ingest import ingest

SF_DIR = "/root/testdata/sf0.001"
T0 = 1_704_067_200_000
KEY = "binance/spot/BTCUSDT"


def bar(i: int, close: float | None = None, spread: int = 0) -> tuple:
    return (T0 + 60_000 * i, i + 1.0, i + 2.0, float(i), i + 0.5 if close is None else close, i, spread, 10 * i)


def frame(spark, rows, key=KEY):
    return with_stored(spark.createDataFrame([(key, *r) for r in rows], "key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR.struct())), BAR)


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, [bar(i) for i in range(200)]).cache()


def index(rows) -> list[int]:
    return [(r["datetime"] - T0) // 60_000 for r in rows]


def test_limits_and_directions(bars):
    r = Runner(bars)
    assert index(r.collect(f'SELECT * FROM "{KEY}" WHERE close < 20.5 LIMIT 5')) == [0, 1, 2, 3, 4]
    assert index(r.collect(f'SELECT * FROM "{KEY}" WHERE close >= 103 LIMIT 10')) == list(range(103, 113))
    assert index(r.collect(f'SELECT * FROM "{KEY}" WHERE close < 20.5 ORDER BY datetime DESC LIMIT 5')) == [19, 18, 17, 16, 15]
    assert index(r.collect(f'SELECT * FROM "{KEY}" WHERE close < 5.5 ORDER BY datetime DESC LIMIT 10')) == [4, 3, 2, 1, 0]
    assert index(r.stream(f'SELECT * FROM "{KEY}" WHERE close < 20.5 ORDER BY datetime DESC LIMIT 5')) == [15, 16, 17, 18, 19]
    assert len(r.collect(f'FROM "{KEY}" LIMIT 0')) == 200


def test_windows(bars):
    r = Runner(bars)
    at = T0 + 600_000
    assert len(r.collect(f'FROM "{KEY}" WHERE datetime >= {at}')) == 190 and len(r.collect(f'FROM "{KEY}" WHERE datetime > {at}')) == 189
    assert r.collect(f'FROM "{KEY}" WHERE datetime < 1') == [] and r.collect(f'FROM "{KEY}" WHERE datetime <= 0') == []
    assert index(r.collect(Query(KEY).between(at, 0).where("datetime", "!=", at).take(2))) == [11, 12]


def test_projection(bars):
    q = f'SELECT close, datetime FROM "{KEY}" LIMIT 1'
    assert Runner(bars).frame(q).columns == ["datetime", "close"]
    full = Runner(bars).frame(q, zero_fill=True)
    assert full.columns == [c.name for c in BAR.columns] and full.first()["close"] == 0.5 and full.first()["volume"] == 0
    assert full.dtypes == [(f.name, f.dataType.simpleString()) for f in BAR.struct()]


def test_first_and_errors(bars):
    r = Runner(bars)
    assert index([r.first(f'FROM "{KEY}" WHERE close >= 50 ORDER BY datetime DESC')]) == [50]
    assert index([r.first(f'FROM "{KEY}" ORDER BY datetime DESC LIMIT 3')]) == [197]
    with pytest.raises(NoMatchError):
        r.first(f'FROM "{KEY}" WHERE close > 1000')
    with pytest.raises(KeyNotFoundError, match="no key"):
        r.collect('FROM "nope"')
    with pytest.raises(ParseError):
        r.stream("nonsense")
    assert r.collect(f'FROM "{KEY}" WHERE close > 1000') == []


def test_retention(bars):
    def run(text, **kept):
        return index(Runner(bars, Retention(**kept)).collect(f'FROM "{KEY}" {text}'))

    assert run("WHERE close < 195 ORDER BY datetime DESC LIMIT 8", max_bars=10) == [194, 193, 192, 191, 190]
    assert len(run("", max_bars=10)) == 10 and len(run("LIMIT 3", max_bars=10)) == 3 and len(run("LIMIT 99", max_bars=10)) == 10
    assert run("", max_age=600_000) == list(range(189, 200))
    assert run("WHERE close < 195", max_age=600_000, max_bars=8) == [192, 193, 194]
    # range conditions on datetime come before the newest N, others after
    assert run(f"WHERE datetime < {T0 + 600_000}", max_bars=3) == [7, 8, 9]
    assert run(f"WHERE datetime == {T0 + 600_000}", max_bars=3) == []
    with pytest.raises(InvalidRecordError):
        Retention(max_bars=-1)


def test_prices_and_spreads(spark):
    rows = [bar(0, 0.29), bar(1, 0.57, -5), bar(2, 0.58, 7), bar(3, 1.13)]
    b = frame(spark, rows)
    assert index(Runner(b).collect(f'FROM "{KEY}" WHERE close == 0.29')) == [0] and index(Runner(b).collect(f'FROM "{KEY}" WHERE close < 0.57')) == [0]
    assert index(Runner(b, price_compare="truncate").collect(f'FROM "{KEY}" WHERE close >= 0.57')) in ([2, 3], [3])
    assert Runner(b, price_compare="truncate").collect(f'FROM "{KEY}" WHERE close == 0.29') == []
    assert index(Runner(b).collect(f'FROM "{KEY}" WHERE spread > 100')) == [1]


def test_random_queries_match_a_plain_filter(spark):
    rng = random.Random(42)
    rows = [bar(i, rng.randrange(1000) + 0.5, rng.randrange(-3, 4)) for i in range(2000)]
    b = frame(spark, rows).cache()
    value = {Field.DATETIME: 0, Field.OPEN: 1, Field.HIGH: 2, Field.LOW: 3, Field.CLOSE: 4, Field.TICK_VOLUME: 5, Field.SPREAD: 6, Field.VOLUME: 7}
    ops = {Op.EQ: int.__eq__, Op.NE: int.__ne__, Op.LT: int.__lt__, Op.LTE: int.__le__, Op.GT: int.__gt__, Op.GTE: int.__ge__}

    def stored(r, f):
        x = r[value[f]]
        return round(x * 1e8) if f.is_price else int(x) & 0xFFFFFFFF if f is Field.SPREAD else int(x)

    for _ in range(25):
        q = Query(KEY)
        if rng.random() < 0.5:
            a, z = sorted(rng.sample(range(2000), 2))
            q = q.between(rows[a][0], rows[z][0])
        for _ in range(rng.randrange(3)):
            f = rng.choice(list(Field))
            q = q.where(f, rng.choice(list(Op)), max(0, rng.choice(rows)[value[f]]))
        q = q.take(rng.choice([0, 1, 7, 5000]))
        q = q.newest_first() if rng.random() < 0.5 else q
        want = [r for r in rows if q.start <= r[0] and (not q.end or r[0] <= q.end) and all(ops[c.op](stored(r, c.field), c.stored) for c in q.conds)]
        want = want[::-1] if q.newest_first_ else want
        assert [tuple(r) for r in Runner(b).collect(q)] == (want[: q.limit] if q.limit else want), q


def test_reader(bars):
    r = Reader(bars, BAR)
    lo, hi = T0 + 60_000 * 10, T0 + 60_000 * 20
    assert index(r.range(KEY, lo, hi).collect()) == list(range(10, 21)) and index(r.range(KEY, lo, hi, 3).collect()) == [18, 19, 20]
    assert index(r.range(KEY, lo, 0, 0).collect())[0] == 10 and index(r.all(KEY, 0, hi, -1))[-1] == 20
    assert index(r.latest(KEY, 4).collect()) == [196, 197, 198, 199] and len(r.latest(KEY).collect()) == 200
    assert index(r.cursor(KEY, lo, hi)) == list(range(10, 21)) and index(r.cursor(KEY, lo, hi, 2)) == [20, 19]
    assert index(r.cursor_desc(KEY, lo, hi)) == list(range(20, 9, -1))
    assert index(r.at(KEY, lo).collect()) == [10] and r.at(KEY, lo + 1).collect() == []
    seen = []
    r.scan(KEY, lambda row: seen.append(row) or len(seen) < 3, lo, hi, 5)
    assert index(seen) == [16, 17, 18]
    assert tuple(r.bounds(KEY).first()) == (T0, T0 + 60_000 * 199) and r.count(KEY).first()[0] == 200
    assert r.retention_floor(KEY, 5, lo, hi).first()[0] == T0 + 60_000 * 16 and r.retention_floor(KEY, 50, lo, hi).first()[0] == lo
    with pytest.raises(KeyNotFoundError):
        r.count("nope")


def test_store_round_trip(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert s.writer.last(KEY) is None and s.reader.records.count() == 0
        s.writer.append_batch(KEY, [bar(i) for i in range(50)])
        s.writer.append_batch(KEY, [])
        s.writer.append("other key/ü", bar(7))
        assert s.reader.records.count() == 0
        s.refresh()
        with pytest.raises(KeyNotFoundError):
            s.query().collect('FROM "nope"')
        assert index(s.query().collect(f'FROM "{KEY}" WHERE close >= 40')) == list(range(40, 50))
        assert [tuple(r) for r in s.reader.range(KEY).collect()] == [bar(i) for i in range(50)]
        assert s.reader.list_keys() == [KEY, "other key/ü"] == [r[0] for r in s.reader.keys().collect()] and s.reader.list_keys("oth") == ["other key/ü"]
        assert s.reader.segments(KEY) >= 1 and s.writer.keys() == [KEY, "other key/ü"]
    s.close()
    again = StoreWriter(spark, str(tmp_path / "s"), BAR)
    assert again.last(KEY) == bar(49)[0]
    with pytest.raises(OutOfOrderError, match="record 0"):
        again.append(KEY, bar(49))
    again.append(KEY, dict(zip([c.name for c in BAR.columns], bar(50), strict=True)))
    assert StoreReader(spark, str(tmp_path / "s"), BAR).count(KEY).first()[0] == 51
    again.close()
    with pytest.raises(InvalidRecordError, match="closed"):
        again.append(KEY, bar(60))


def test_bad_appends_write_nothing(spark, tmp_path):
    w = StoreWriter(spark, str(tmp_path / "s"), BAR)
    w.append(KEY, bar(5))
    good = bar(6)
    for bad, error in (
        ((good, bar(6)), OutOfOrderError), ((good, bar(4)), OutOfOrderError), ((good, bar(7, float("nan"))), InvalidRecordError), ((good, bar(7, float("inf"))), InvalidRecordError),
        ((good, bar(7, -1.0)), InvalidRecordError), ((good, bar(7, 1e30)), PriceRangeError), (((-1, *good[1:]),), InvalidRecordError), ((good[:-1],), InvalidRecordError),
        (((*good[:-1], 1 << 63),), InvalidRecordError), (((*good[:-1], None),), InvalidRecordError),
    ):
        with pytest.raises(error):
            w.append_batch(KEY, bad)
    for key in ("", "x" * 256):
        with pytest.raises(InvalidRecordError):
            w.append(key, good)
    assert index(w.stored().collect()) == [5]
    w.append(KEY, good)
    assert sorted(index(w.stored().collect())) == [5, 6]


def test_append_frame(spark, tmp_path):
    w = StoreWriter(spark, str(tmp_path / "s"), BAR, segment_records=20)
    rows = frame(spark, [bar(i) for i in range(100)]).union(frame(spark, [bar(i) for i in range(10)], "b"))
    w.append_frame(rows)
    assert w.stored().count() == 110 and w.segments().where("key = 'b'").count() == 1 and w.segments().where(f"key = '{KEY}'").count() >= 5
    with pytest.raises(OutOfOrderError):
        w.append_frame(frame(spark, [bar(99)]))
    with pytest.raises(OutOfOrderError):
        w.append_frame(frame(spark, [bar(100), bar(100)]))
    with pytest.raises(InvalidRecordError):
        w.append_frame(frame(spark, [bar(100, -2.0)]))
    with pytest.raises(PriceRangeError):
        w.append_frame(frame(spark, [bar(100, 1e12)]))
    w.append_frame(frame(spark, [bar(99), bar(100), bar(100), bar(101)]), late="drop")
    assert w.stored().count() == 112
    w.append_frame(frame(spark, []))
    with pytest.raises(OutOfOrderError):  # days repeat in orders, so they are no series
        orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
        price = F.col("o_totalprice")
        w.append_frame(orders.select(F.lit("o").alias("key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("datetime"), *[price.alias(n) for n in ("open", "high", "low", "close")], F.lit(0).alias("tick_volume"), F.lit(0).alias("spread"), F.lit(0).alias("volume")))


def test_stamps_may_repeat(spark, tmp_path):
    twins = [bar(i, close=c) for i in range(6) for c in (1.5, 2.5, 2.5)]
    w = StoreWriter(spark, f"{tmp_path}/r", BAR, bucket=dt.timedelta(minutes=2), repeats=True)
    w.append_frame(frame(spark, twins[:10]))
    with pytest.raises(OutOfOrderError, match="1 keys begin"):
        w.append_frame(frame(spark, twins[8:]))
    w.append_frame(frame(spark, twins[10:12]))
    # what isn't after the stored stamps is left out, repeats within the batch are not
    w.append_frame(frame(spark, twins[7:17]), late="drop")
    w.append(KEY, twins[17])
    with pytest.raises(OutOfOrderError, match="record 0"):
        w.append(KEY, twins[14])
    reader = StoreReader(spark, f"{tmp_path}/r", BAR)
    assert [tuple(r) for r in reader.range(KEY).collect()] == twins
    assert reader.verify() == 18 and reader.facts(KEY)[0] == 18
    assert [tuple(r) for r in reader.latest(KEY, 4).collect()] == [twins[12], *twins[15:]]
    run = Runner(reader.of, bucket=reader.width, facts=reader.facts, ties=reader.ties)
    assert [r.close for r in run.collect(f'SELECT close FROM "{KEY}" ORDER BY datetime DESC LIMIT 4')] == [1.5, 2.5, 2.5, 1.5]
    with pytest.raises(CorruptError):
        StoreWriter(spark, f"{tmp_path}/r", BAR, bucket=dt.timedelta(minutes=2))


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Events three times, with other ids and the same stamps."""
    path = str(tmp_path_factory.mktemp("repeated"))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    n = events.count()
    copies = [events.withColumn("event_id", F.col("event_id") + i * n) for i in range(3)]
    copies[0].union(copies[1]).union(copies[2]).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue_keeps_events_that_share_a_stamp(spark, repeated, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet/*.parquet'")
    want = db.sql(catalogue.oracle_sql()[name])
    found = entry.queries()[name](spark, repeated)
    assert found.columns == want.columns
    rows, expected = found.collect(), want.fetchall()
    if " LIMIT " in catalogue.oracle_sql()[name]:
        # SQL leaves open which of the rows with one stamp are taken; the stamps are certain
        at = found.columns.index("datetime") if "datetime" in found.columns else 0
        rows, expected = [(r[at],) for r in rows], [(r[at],) for r in expected]
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_buckets_and_prune(spark, tmp_path):
    w = StoreWriter(spark, str(tmp_path / "s"), BAR, bucket=dt.timedelta(hours=1))
    w.append_batch(KEY, [bar(i) for i in range(180)])
    w.append_batch("short", [bar(i) for i in range(3)])
    assert w.segments().where(f"key = '{KEY}'").count() == 3
    plan = StoreReader(spark, str(tmp_path / "s"), BAR).range(KEY, T0 + 3_600_000, T0 + 2 * 3_600_000 - 1)._jdf.queryExecution().executedPlan().toString()
    assert "time_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "datetime" in plan.split("PushedFilters")[1]
    calls = []
    assert w.prune(lambda *a: calls.append(a) or True) == 2
    assert {c[0] for c in calls} == {KEY} and [c[1] for c in sorted(calls)] == [0, 1]
    r = StoreReader(spark, str(tmp_path / "s"), BAR)
    assert index(r.range(KEY).collect()) == list(range(120, 180)) and r.count("short").first()[0] == 3
    for width in (dt.timedelta(microseconds=10), dt.timedelta(0)):
        with pytest.raises(InvalidRecordError):
            StoreWriter(spark, str(tmp_path / "t"), BAR, bucket=width)


def test_bounded_reads_and_comparisons(bars):
    r = Reader(bars, BAR)
    lo, hi = T0 + 60_000 * 10, T0 + 60_000 * 20
    assert index(r.all_bounds(KEY, [("close", 12.5, 15.5)], lo, hi)) == [12, 13, 14, 15]
    assert index(r.cursor_filtered(KEY, [("close", None, 15.5)], lo, 0, 2)) == [15, 14] and index(r.cursor_filtered(KEY, [("volume", 180, None)], lo, hi)) == [18, 19, 20]
    assert index(r.cursor_desc_filtered(KEY, [("spread", 0, 0), ("open", 20.0, None)], lo, hi)) == [20, 19]
    held = [1, 2, 3]
    assert r.range_into(held, KEY, lo, hi, 3) is held and index(held) == [18, 19, 20]
    price, time, tag = BAR.field("close"), BAR.field("ts"), SchemaColumn("tag", Kind.BYTES, 2)
    a, b = ({"datetime": 1, "close": 2.5}, {"datetime": 3, "close": float("nan")})
    assert price.compare(a, b) == -1 and price.compare(b, a) == 1 and price.equal(b, b) and time.compare(b, a) == 1 and time.load(a) == 1
    assert tag.compare({"tag": b"ab"}, {"tag": b"b"}) == -1 and tag.load({"tag": b"ab"}) == 0 and tag.equal({"tag": b"x"}, {"tag": bytearray(b"x")})
    row = bars.select(price.compared(F.lit(1.0), F.lit(float("nan"))).alias("a"), time.compared(F.col("datetime"), F.lit(T0)).alias("b")).orderBy("b").first()
    assert tuple(row) == (-1, 0)


def test_nanosecond_buckets(spark, tmp_path):
    """Stamps beyond 2**53 on either side of a bucket's bounds."""
    fill = RecordSchema("Fill", (SchemaColumn("at", Kind.INT64, 8, time=True), SchemaColumn("n", Kind.INT64, 8)), TimeUnit.NS)
    w = StoreWriter(spark, str(tmp_path / "s"), fill, bucket=dt.timedelta(hours=1))
    hour, t0 = 3_600_000_000_000, T0 * 1_000_000
    stamps = [t0 + k * hour + d for k in range(3) for d in (0, 1, hour - 2, hour - 1)]
    w.append_batch("k", [(t, i) for i, t in enumerate(stamps)])
    r = StoreReader(spark, str(tmp_path / "s"), fill)
    assert [x["n"] for x in r.range("k", t0 + hour - 2, t0 + hour).collect()] == [2, 3, 4] and [x["n"] for x in r.range("k", t0 + 2 * hour - 1, t0 + 2 * hour - 1).collect()] == [7]
    assert sorted(x["time_bucket"] * hour for x in r.records.select("time_bucket").distinct().collect()) == [t0, t0 + hour, t0 + 2 * hour]
    assert r.records.where("n = 3").select(display_time(F.col("at"), TimeUnit.NS)).first()[0] == dt.datetime(2024, 1, 1, 0, 59, 59, 999_999)
    assert w.last("k") == stamps[-1] and StoreWriter(spark, str(tmp_path / "s"), fill, bucket=dt.timedelta(hours=1)).last("k") == stamps[-1]


def test_footers_answer(spark, tmp_path):
    w = StoreWriter(spark, str(tmp_path / "s"), BAR, segment_records=20)
    w.append_frame(frame(spark, [bar(i) for i in range(100)]).union(frame(spark, [bar(i) for i in range(10)], "b")))
    r = StoreReader(spark, str(tmp_path / "s"), BAR)
    for df in (r.count(KEY), r.bounds(KEY)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedAggregation: \[[A-Z]", plan), plan
    assert r.facts(KEY) == (100, bar(0)[0], bar(99)[0]) and tuple(r.bounds("b").first()) == (bar(0)[0], bar(9)[0])
    facts = r.segment_facts(KEY)
    assert len(facts) == r.segments(KEY) >= 5 and sum(f[1] for f in facts) == 100 and all(x[3] < y[2] for x, y in zip(facts, facts[1:], strict=False))


def test_an_append_looks_at_its_keys_only(spark, tmp_path):
    path = tmp_path / "s"
    w = StoreWriter(spark, str(path), BAR)
    w.append_frame(frame(spark, [bar(i) for i in range(10)]).union(frame(spark, [bar(i) for i in range(10)], "broken")))
    for f in path.glob("data/key=broken/*.parquet"):
        f.write_bytes(b"PAR1 not a file PAR1")
    again = StoreWriter(spark, str(path), BAR)
    again.append_frame(frame(spark, [bar(i) for i in range(10, 20)]))
    assert again.keys() == [KEY] and again.last(KEY) == bar(19)[0] and again.last("none") is None
    again.append_frame(frame(spark, [bar(i) for i in range(15, 20)]), late="drop")
    assert again.keys() == [KEY] and not list(path.glob("_staged/*"))
    other = StoreWriter(spark, str(path), BAR)
    assert other.last(KEY) == bar(19)[0] and other.keys() == []
    # rows that were stored are found by the stamps' statistics: nothing at or after the batch's first is there
    lasts = other._stored_lasts([KEY], bar(20)[0])
    assert lasts.collect() == [] and other._stored_lasts([KEY], bar(5)[0]).first()["last"] == bar(19)[0]


def test_many_keys_are_checked_by_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writer, "NAMED_KEYS", 2)
    w = StoreWriter(spark, str(tmp_path / "s"), BAR)
    five = [frame(spark, [bar(i) for i in range(6)], f"k{k}") for k in range(5)]
    rows = five[0].union(five[1]).union(five[2]).union(five[3]).union(five[4])
    w.append_frame(rows)
    assert w.keys() == [f"k{k}" for k in range(5)] and w.last("k3") == bar(5)[0]
    with pytest.raises(OutOfOrderError, match="5 keys begin"):
        w.append_frame(rows)
    later = rows.union(frame(spark, [bar(6)], "k1")).union(frame(spark, [bar(0)], "k9"))
    again = StoreWriter(spark, str(tmp_path / "s"), BAR)
    again.append_frame(later, late="drop")
    assert again.keys() == ["k1", "k9"] and again.stored().count() == 32


def test_what_was_checked_is_stored(spark, tmp_path):
    """An input that is other each time it is evaluated: stored rows are those that passed."""
    w = StoreWriter(spark, str(tmp_path / "s"), BAR)
    for k in range(12):
        price = F.when(F.rand() < 0.02, -1.0).otherwise(F.col("close"))
        rows = frame(spark, [bar(100 * k + i) for i in range(30)]).withColumn("close", price)
        try:
            w.append_frame(rows.withColumn("close", price))
        except InvalidRecordError:
            continue
    assert w.stored().where("close_fp < 0").count() == 0 and w.stored().count() % 30 == 0 and not list((tmp_path / "s").glob("_staged/*"))
    plan = w._laid_out(frame(spark, [bar(0)]))[0].withColumn("t", F.row_number().over(Window.partitionBy("key", "datetime").orderBy("datetime")))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_lock_and_pruning_beside_a_reader(spark, tmp_path):
    path = str(tmp_path / "s")
    w = StoreWriter(spark, path, BAR, bucket=dt.timedelta(hours=1), lock=True)
    with pytest.raises(BusyError):
        StoreWriter(spark, path, BAR, bucket=dt.timedelta(hours=1), lock=True)
    w.append_batch(KEY, [bar(i) for i in range(180)])
    r = StoreReader(spark, path, BAR)
    rows = r.range(KEY)
    assert w.prune(lambda *a: True) == 2 and index(rows.collect()) == list(range(120, 180))
    w.close()
    StoreWriter(spark, path, BAR, bucket=dt.timedelta(hours=1), lock=True).close()


def test_limits_probe_the_end_they_want(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planner, "PROBE_ROWS", 50)
    for bucket in (None, dt.timedelta(hours=3)):
        path = str(tmp_path / f"s{bool(bucket)}")
        rng = random.Random(4)
        rows = [bar(3 * i + rng.randrange(3), float(rng.randrange(50))) for i in range(400)]
        StoreWriter(spark, path, BAR, bucket=bucket).append_frame(frame(spark, rows))
        r = StoreReader(spark, path, BAR)
        for most, age in ((0, 0), (60, 0), (0, 12_000_000)):
            kept = Retention(max_bars=most, max_age=age)
            plain, probing = Runner(r.of, kept), Runner(r.of, kept, bucket=r.width, facts=r.facts)
            for where in ("", "WHERE close >= 25", "WHERE close == 7", f"WHERE close < 20 AND datetime > {rows[100][0]} AND datetime <= {rows[300][0]}", "WHERE close > 99"):
                for tail in ("LIMIT 3", "ORDER BY datetime DESC LIMIT 3", "ORDER BY datetime DESC LIMIT 40"):
                    q = f'FROM "{KEY}" {where} {tail}'
                    assert probing.collect(q) == plain.collect(q), (q, kept)
        narrowed = planner.plan(Query(KEY).newest_first().take(3), r.of(KEY), bucket=r.width, facts=r.facts)
        assert "GreaterThanOrEqual(datetime," in narrowed._jdf.queryExecution().executedPlan().toString()


def test_verify(spark, tmp_path):
    path = tmp_path / "s"
    w = StoreWriter(spark, str(path), BAR)
    w.append_batch(KEY, [bar(i) for i in range(30)])
    w.append_batch("b", [bar(i) for i in range(3)])
    r = StoreReader(spark, str(path), BAR)
    assert r.verify() == 33 and r.verify("b") == 3
    files = sorted(path.glob("data/*/*.parquet"))
    files[0].with_name("copy.parquet").write_bytes(files[0].read_bytes())
    r.refresh()
    with pytest.raises(CorruptError, match="repeat a stamp"):
        r.verify()
    files[0].with_name("copy.parquet").write_bytes(b"PAR1 not a file PAR1")
    r.refresh()
    with pytest.raises(CorruptError, match="can't be read"):
        r.verify()


def test_wrong_store(spark, tmp_path):
    StoreWriter(spark, str(tmp_path / "s"), BAR)
    with pytest.raises(CorruptError):
        StoreWriter(spark, str(tmp_path / "s"), TICK)
    with pytest.raises(CorruptError):
        StoreReader(spark, str(tmp_path / "s"), TICK)
    with pytest.raises(InvalidRecordError):
        StoreReader(spark, str(tmp_path / "none"), BAR)
    with pytest.raises(InvalidRecordError):
        Store.open(spark, "")


def test_ticks(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), TICK) as s:
        us = T0 * 1000
        s.writer.append_batch("tick/EURUSD", [(us + i, *p, i, FLAG_BID | FLAG_LAST * (i % 2), 0) for i, p in enumerate([(-37.63, -37.61, -37.62), (-0.00000134, 0.00000122, -0.00000001), (0.0, 0.0, 0.0)])])
        s.refresh()
        rows = s.reader.range("tick/EURUSD").collect()
        assert rows[0]["bid"] == -37.63 and rows[1]["last"] == -0.00000001 and rows[1]["bid"] == -0.00000134
        assert s.reader.window("tick/EURUSD").where(has_flags(F.col("flags"), FLAG_LAST)).count() == 1
        assert s.reader.records.select(display_time(F.col("datetime"), TimeUnit.US)).first()[0] == dt.datetime(2024, 1, 1)
        with pytest.raises(UnsupportedError, match="Tick"):
            s.query()


def test_custom_records(spark, tmp_path):
    quote = RecordSchema("Quote", (SchemaColumn("at", Kind.INT64, 8, time=True), SchemaColumn("bid", Kind.UINT32, 4), SchemaColumn("cond", Kind.UINT8, 1), SchemaColumn("tag", Kind.BYTES, 4)), TimeUnit.US)
    w = StoreWriter(spark, str(tmp_path / "s"), quote)
    w.append_batch("q", [(1, 4_294_967_295, 255, b"abcd"), (2, 0, 0, b"\0\xff\0\0")])
    for bad in ((3, 1 << 32, 0, b"abcd"), (3, 0, 256, b"abcd"), (3, 0, 0, b"abc")):
        with pytest.raises(InvalidRecordError):
            w.append("q", bad)
    assert [tuple(r) for r in StoreReader(spark, str(tmp_path / "s"), quote).range("q").collect()] == [(1, 4_294_967_295, 255, b"abcd"), (2, 0, 0, b"\0\xff\0\0")]


def test_waiting_rows(spark, tmp_path):
    now = [0.0]
    w = StoreWriter(spark, str(tmp_path / "s"), BAR, policy=FlushPolicy(-1, 5, now=lambda: now[0], ram=0))
    w.append_batch(KEY, [bar(0), bar(1)])
    assert w.stored().count() == 0 and not w.sync_if_due() and w.last(KEY) == bar(1)[0]
    now[0] = 5
    assert w.sync_if_due() and w.stored().count() == 2 and not w.sync_if_due()
    w.append(KEY, bar(2))
    assert w.policy.at_risk_bytes == BAR.record_size
    w.seal(KEY)
    assert w.stored().count() == 3 and w.policy.at_risk_bytes == 0
    w.append(KEY, bar(3))
    w.close()
    w.close()
    assert StoreReader(spark, str(tmp_path / "s"), BAR).count(KEY).first()[0] == 4
    assert not StoreWriter(spark, str(tmp_path / "t"), BAR).sync_if_due()


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    user = [c.name for c in BAR.columns]
    frame(spark, [bar(i) for i in range(10)]).select("key", *user).coalesce(1).write.parquet(source)
    w = StoreWriter(spark, str(tmp_path / "s"), BAR)
    schema = frame(spark, []).select("key", *user).schema

    def run(late):
        q = ingest(spark.readStream.schema(schema).parquet(source), w, late=late).option("checkpointLocation", str(tmp_path / f"c-{late}")).trigger(availableNow=True).start()
        q.awaitTermination()

    run("drop")
    frame(spark, [bar(i) for i in range(5, 15)]).select("key", *user).coalesce(1).write.mode("append").parquet(source)
    run("drop")
    assert sorted(index(w.stored().collect())) == list(range(15))
    with pytest.raises(Exception, match="begin at or before"):
        run("error")


def test_filters_reach_the_files(spark):
    df = Runner(spark.read.parquet(f"{SF_DIR}/events.parquet").transform(catalogue.bars_from_events), check_key=False).frame(f'SELECT datetime, close FROM "{catalogue.KEY}" WHERE volume >= 3')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan and "GreaterThanOrEqual(event_id,3)" in plan


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue_matches_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    got, want = entry.queries()[name](spark, SF_DIR).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.dtypes.equals(want.dtypes) or not len(got)
    assert np.array_equal(got.to_numpy(), want.to_numpy())


def test_entry(spark):
    assert entry.entry(spark).columns == ["datetime", "close"]
