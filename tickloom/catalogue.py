"""The engine's operators as named queries over the event tables, and each one's SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.codec import display_time, has_flags
from tickloom.operators.writer import StoreWriter
from tickloom.plans.planner import Retention
from tickloom.plans.query import Query
from tickloom.plans.runner import Runner
from tickloom.schema import BAR, FLAG_LAST, TICK, Column, Kind, RecordSchema, TimeUnit
from tickloom.scratch import scratch
from tickloom.sources.adapters import bars_from_events, ticks_from_events
from tickloom.sources.reader import Reader
from tickloom.store import StoreReader

KEY, TICK_KEY = "events/spot/click", "tick/view"
T0, T1 = 1_704_500_000_000, 1_705_500_000_000
STAMP = 1_704_067_432_824
HOUR, DAY = 3_600_000, 86_400_000

# prices are what a store gives back: multiples of 1e-8
_BARS = """SELECT *, open_fp / 1e8 AS open, high_fp / 1e8 AS high, low_fp / 1e8 AS low, close_fp / 1e8 AS close FROM (
  SELECT 'events/spot/' || event_type AS key, epoch_us(ts) // 1000 AS datetime,
  user_id AS tick_volume, CAST(event_id % 7 - 3 AS INTEGER) AS spread, event_id AS volume,
  CAST(round(value * 1e8) AS BIGINT) AS open_fp, CAST(round((value + 1) * 1e8) AS BIGINT) AS high_fp,
  CAST(round(greatest(value - 1, 0) * 1e8) AS BIGINT) AS low_fp, CAST(round(value * 1e8) AS BIGINT) AS close_fp
  FROM events)"""
_TICKS = """SELECT 'tick/' || event_type AS key, epoch_us(ts) AS datetime,
  CAST(round((value - 5) * 1e8) AS BIGINT) / 1e8 AS bid, CAST(round((value + 0.01) * 1e8) AS BIGINT) / 1e8 AS ask, CAST(round(value * 1e8) AS BIGINT) / 1e8 AS last,
  user_id AS volume, CAST(CASE WHEN event_id % 2 = 0 THEN 30 ELSE 6 END AS BIGINT) AS flags, CAST(0 AS BIGINT) AS volume_ext
  FROM events"""
_ALL = "datetime, open, high, low, close, tick_volume, spread, volume"
_TICK_ALL = "datetime, bid, ask, last, volume, flags, volume_ext"


def _sql(body: str) -> str:
    return f"WITH bars AS ({_BARS}), ticks AS ({_TICKS}), k AS (SELECT * FROM bars WHERE key = '{KEY}'), t AS (SELECT * FROM ticks WHERE key = '{TICK_KEY}') {body}"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


Maker = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Maker] = {}
_oracles: dict[str, str] = {}
#: Stores that a session wrote from its events, by folder and kind; they go when the driver ends.
_stores: dict[tuple[int, str, str], StoreReader] = {}


def _store(spark: SparkSession, sf_dir: str, schema: RecordSchema) -> StoreReader:
    """The events as a store of bars, in buckets of three days, or of ticks; written once a session.

    Nothing keeps events of one type from sharing a stamp, and the SQL has them all, so stamps may repeat.
    """
    held = _stores.get((id(spark), sf_dir, schema.name))
    if held is None or held.spark is not spark:
        path = scratch(spark, schema.name.lower())
        rows = bars(spark, sf_dir) if schema is BAR else ticks(spark, sf_dir)
        writer = StoreWriter(spark, path, schema, bucket=dt.timedelta(days=3) if schema is BAR else None, repeats=True)
        writer.append_frame(rows.select("key", *[c.name for c in schema.columns]))
        held = _stores[(id(spark), sf_dir, schema.name)] = StoreReader(spark, path, schema)
    return held


def _runner(spark: SparkSession, sf_dir: str, retention: Retention = Retention(), **options) -> Runner:
    held = _store(spark, sf_dir, BAR)
    return Runner(held.of, retention, bucket=held.width, facts=held.facts, ties=held.ties, **options)


def _text(name: str, text: str, sql: str, *, direction: bool = False, retention: Retention = Retention(), **options) -> None:
    """A query text over a store of bars."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        runner = _runner(spark, sf_dir, retention, **{k: v for k, v in options.items() if k == "price_compare"})
        return (runner.collected if direction else runner.frame)(text, **{k: v for k, v in options.items() if k == "zero_fill"})

    _queries[name], _oracles[name] = make, _sql(sql)


def _read(name: str, use: Callable[[Reader], DataFrame], sql: str, *, tick: bool = False) -> None:
    """A direct read of a store of bars or ticks."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return use(_store(spark, sf_dir, TICK if tick else BAR))

    _queries[name], _oracles[name] = make, _sql(sql)


def _from(where: str = "") -> str:
    return f'SELECT * FROM "{KEY}"{" WHERE " + where if where else ""}'


# projection
_text("select_all", _from(), f"SELECT {_ALL} FROM k")
_text("from_only", f'FROM "{KEY}"', f"SELECT {_ALL} FROM k")
_text("project_two", f'SELECT close, datetime, close FROM "{KEY}"', "SELECT datetime, close FROM k")
_text(
    "project_zero_fill",
    f'SELECT datetime, close FROM "{KEY}"',
    "SELECT datetime, 0.0::DOUBLE AS open, 0.0::DOUBLE AS high, 0.0::DOUBLE AS low, close, 0::BIGINT AS tick_volume, 0::INTEGER AS spread, 0::BIGINT AS volume FROM k",
    zero_fill=True,
)
_text("alias_fields", f'SELECT TS, TickVolume FROM "{KEY}" WHERE time >= {T0}', f"SELECT datetime, tick_volume FROM k WHERE datetime >= {T0}")
# windows
_text("range_window", f'SELECT * FROM "{KEY}" RANGE {T0} TO {T1}', f"SELECT {_ALL} FROM k WHERE datetime BETWEEN {T0} AND {T1}")
_text("range_open_low", f'SELECT * FROM "{KEY}" RANGE 0 TO {T0}', f"SELECT {_ALL} FROM k WHERE datetime <= {T0}")


def _open_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runner(spark, sf_dir).frame(Query(KEY).between(T1, 0))


_queries["range_open_high"], _oracles["range_open_high"] = _open_high, _sql(f"SELECT {_ALL} FROM k WHERE datetime >= {T1}")
# comparisons
for _name, _op, _sql_op in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("lte", "<=", "<="), ("gt", ">", ">"), ("gte", ">=", ">=")):
    _text(f"cmp_{_name}", _from(f"close {_op} 35.47"), f"SELECT {_ALL} FROM k WHERE close_fp {_sql_op} 3547000000")
for _name in ("open", "high", "low"):
    _text(f"cmp_price_{_name}", _from(f"{_name} >= 20.57"), f"SELECT {_ALL} FROM k WHERE {_name}_fp >= 2057000000")
_text("cmp_volume", _from("volume < 500"), f"SELECT {_ALL} FROM k WHERE volume < 500")
_text("cmp_tick_volume", _from("tick_volume >= 100"), f"SELECT {_ALL} FROM k WHERE tick_volume >= 100")
_text("cmp_spread_unsigned", _from("spread > 100"), f"SELECT {_ALL} FROM k WHERE (CAST(spread AS BIGINT) & 4294967295) > 100")
_text("cmp_fraction_truncated", _from("volume >= 1.5"), f"SELECT {_ALL} FROM k WHERE volume >= 1")
_text("cmp_price_truncate_mode", _from("close >= 20.57"), f"SELECT {_ALL} FROM k WHERE CAST(floor(close * 1e8) AS BIGINT) >= 2057000000", price_compare="truncate")
_text("and_three", _from("close >= 10 AND volume >= 100 AND spread <= 2"), f"SELECT {_ALL} FROM k WHERE close_fp >= 1000000000 AND volume >= 100 AND (CAST(spread AS BIGINT) & 4294967295) <= 2")
_text("datetime_gt", _from(f"datetime > {T0}"), f"SELECT {_ALL} FROM k WHERE datetime > {T0}")
_text("datetime_lt", _from(f"datetime < {T0}"), f"SELECT {_ALL} FROM k WHERE datetime < {T0}")
_STAMP = "(SELECT min(datetime) FROM k WHERE datetime >= %d)" % T0
_text("datetime_eq", _from(f"datetime == {STAMP}"), f"SELECT {_ALL} FROM k WHERE datetime = {STAMP}")
_text("datetime_ne", _from(f"datetime <> {T0}"), f"SELECT {_ALL} FROM k WHERE datetime <> {T0}")
_text("datetime_mixed", f'SELECT * FROM "{KEY}" RANGE {T0} TO {T1} WHERE datetime > {T0 + DAY} AND datetime < {T1 - DAY} AND close > 5', f"SELECT {_ALL} FROM k WHERE datetime > {T0 + DAY} AND datetime < {T1 - DAY} AND close_fp > 500000000")
_text("datetime_below_first", _from("datetime <= 0"), f"SELECT {_ALL} FROM k WHERE datetime <= 0")
_text("contradiction_empty", _from("close > 20 AND close < 10"), f"SELECT {_ALL} FROM k WHERE false")
# limits
_text("limit_asc", f"{_from('close >= 20')} LIMIT 10", f"SELECT {_ALL} FROM k WHERE close_fp >= 2000000000 ORDER BY datetime LIMIT 10")
_text("limit_desc", f"{_from('close >= 20')} ORDER BY datetime DESC LIMIT 10", f"SELECT {_ALL} FROM k WHERE close_fp >= 2000000000 ORDER BY datetime DESC LIMIT 10", direction=True)
_text("limit_desc_stream", f"{_from('close < 20')} ORDER BY datetime DESC LIMIT 25", f"SELECT {_ALL} FROM k WHERE close_fp < 2000000000 ORDER BY datetime DESC LIMIT 25")
_text("limit_desc_short", f"{_from('volume < 30')} ORDER BY datetime DESC LIMIT 1000", f"SELECT {_ALL} FROM k WHERE volume < 30 ORDER BY datetime DESC LIMIT 1000")
_text("limit_zero", f"{_from('close >= 20')} LIMIT 0", f"SELECT {_ALL} FROM k WHERE close_fp >= 2000000000")


def _first(text: str) -> Maker:
    return lambda spark, sf_dir: _runner(spark, sf_dir).first_frame(text)


_queries["first_asc"] = _first(_from("close >= 20"))
_oracles["first_asc"] = _sql(f"SELECT {_ALL} FROM k WHERE close_fp >= 2000000000 ORDER BY datetime LIMIT 1")
_queries["first_desc_oldest"] = _first(_from("close >= 20") + " ORDER BY datetime DESC")
_oracles["first_desc_oldest"] = _oracles["first_asc"]
_queries["first_desc_limited"] = _first(_from("close >= 20") + " ORDER BY datetime DESC LIMIT 5")
_oracles["first_desc_limited"] = _sql(f"SELECT * FROM (SELECT {_ALL} FROM k WHERE close_fp >= 2000000000 ORDER BY datetime DESC LIMIT 5) ORDER BY datetime LIMIT 1")
# retention
_text("ret_maxbars", _from(), f"SELECT {_ALL} FROM k ORDER BY datetime DESC LIMIT 50", retention=Retention(max_bars=50))
_text(
    "ret_maxbars_filter_limit",
    _from(f"datetime < {T1} AND close < 20") + " ORDER BY datetime DESC LIMIT 8",
    f"SELECT {_ALL} FROM (SELECT * FROM k WHERE datetime < {T1} ORDER BY datetime DESC LIMIT 50) WHERE close_fp < 2000000000 ORDER BY datetime DESC LIMIT 8",
    retention=Retention(max_bars=50),
    direction=True,
)
_text("ret_maxage", _from(), f"SELECT {_ALL} FROM k WHERE datetime >= (SELECT max(datetime) FROM k) - {3 * DAY}", retention=Retention(max_age=3 * DAY))
_text(
    "ret_both",
    _from("close >= 5"),
    f"SELECT {_ALL} FROM (SELECT * FROM k WHERE datetime >= (SELECT max(datetime) FROM k) - {3 * DAY} ORDER BY datetime DESC LIMIT 40) WHERE close_fp >= 500000000",
    retention=Retention(max_bars=40, max_age=3 * DAY),
)
# direct reads
_read("latest_n", lambda r: r.latest(KEY, 20), f"SELECT {_ALL} FROM k ORDER BY datetime DESC LIMIT 20")
_read("range_limit_newest", lambda r: r.range(KEY, T0, T1, 15), f"SELECT {_ALL} FROM k WHERE datetime BETWEEN {T0} AND {T1} ORDER BY datetime DESC LIMIT 15")
_read("range_full", lambda r: r.range(KEY, T0, T1), f"SELECT {_ALL} FROM k WHERE datetime BETWEEN {T0} AND {T1}")
_read("cursor_limited", lambda r: r.cursor_frame(KEY, T0, 0, 12), f"SELECT {_ALL} FROM k WHERE datetime >= {T0} ORDER BY datetime DESC LIMIT 12")
_read("full_series", lambda r: r.range(KEY), f"SELECT {_ALL} FROM k")


def _point(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _store(spark, sf_dir, BAR)
    stamp = reader.window(KEY, T0).agg(F.min("datetime")).first()[0]
    return reader.at(KEY, stamp)


_queries["point_lookup"], _oracles["point_lookup"] = _point, _sql(f"SELECT {_ALL} FROM k WHERE datetime = {_STAMP}")
_read("keys", lambda r: r.keys(), "SELECT DISTINCT key FROM bars")
_read("keys_prefix", lambda r: r.keys("events/spot/p"), "SELECT DISTINCT key FROM bars WHERE key LIKE 'events/spot/p%'")
_read("count_key", lambda r: r.count(KEY), "SELECT count(*) AS n FROM k")
_read("bounds_key", lambda r: r.bounds(KEY), 'SELECT min(datetime) AS "first", max(datetime) AS "last" FROM k')
_read(
    "retention_floor",
    lambda r: r.retention_floor(KEY, 30, T0, T1),
    f"SELECT CASE WHEN count(*) = 30 THEN min(datetime) ELSE {T0} END AS floor FROM (SELECT datetime FROM k WHERE datetime BETWEEN {T0} AND {T1} ORDER BY datetime DESC LIMIT 30)",
)
# ticks
_read("tick_window", lambda r: r.range(TICK_KEY, T0 * 1000, T1 * 1000), f"SELECT {_TICK_ALL} FROM t WHERE datetime BETWEEN {T0 * 1000} AND {T1 * 1000}", tick=True)
_read("tick_latest", lambda r: r.latest(TICK_KEY, 25), f"SELECT {_TICK_ALL} FROM t ORDER BY datetime DESC LIMIT 25", tick=True)
_read("tick_flags", lambda r: r.window(TICK_KEY).where(has_flags(F.col("flags"), FLAG_LAST)).select(r.names), f"SELECT {_TICK_ALL} FROM t WHERE (flags & 8) <> 0", tick=True)
_read("tick_negative", lambda r: r.window(TICK_KEY).where(F.col("bid_fp") < 0).select(r.names), f"SELECT {_TICK_ALL} FROM t WHERE CAST(round(bid * 1e8) AS BIGINT) < 0", tick=True)
_read("tick_time", lambda r: r.window(TICK_KEY, T0 * 1000, (T0 + DAY) * 1000).select("datetime", F.unix_micros(display_time(F.col("datetime"), TimeUnit.US)).alias("micros")), f"SELECT datetime, datetime AS micros FROM t WHERE datetime BETWEEN {T0 * 1000} AND {(T0 + DAY) * 1000}", tick=True)


# builder and text
def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Query(KEY).between(T0, T1).where("close", ">=", 12.34).where("volume", "<=", 5000).newest_first().take(20).select("datetime", "close", "volume")
    return _runner(spark, sf_dir).collected(query)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Query(KEY).between(T0, T1).where("close", ">=", 12.34).where("volume", "<=", 5000).newest_first().take(20).select("datetime", "close", "volume")
    return _runner(spark, sf_dir).collected(query.text())


_queries["builder_query"], _queries["text_round_trip"] = _built, _round_trip
_oracles["builder_query"] = _oracles["text_round_trip"] = _sql(f"SELECT datetime, close, volume FROM k WHERE datetime BETWEEN {T0} AND {T1} AND close_fp >= 1234000000 AND volume <= 5000 ORDER BY datetime DESC LIMIT 20")


# stores
def _stored(spark: SparkSession, sf_dir: str, name: str, bucket: dt.timedelta | None = None, upto: int = 0) -> tuple[StoreWriter, str]:
    path = scratch(spark, name)
    writer = StoreWriter(spark, path, BAR, bucket=bucket, repeats=True)
    rows = bars(spark, sf_dir).select("key", *[c.name for c in BAR.columns])
    writer.append_frame(rows.where(F.col("datetime") < T0))
    if not upto:
        # two commits, so that the second has to follow the first
        writer.append_frame(rows.where(F.col("datetime") >= T0))
    return writer, path


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = _stored(spark, sf_dir, "appended")
    return StoreReader(spark, path, BAR).range(KEY)


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = _stored(spark, sf_dir, "bucketed", dt.timedelta(days=3))
    return StoreReader(spark, path, BAR).range(KEY, T0, T1)


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    writer, path = _stored(spark, sf_dir, "pruned", dt.timedelta(days=3))
    cut = T0 // (3 * DAY) * (3 * DAY)
    writer.prune(lambda key, seq, first, last, sealed: last < cut)
    return StoreReader(spark, path, BAR).range(KEY)


_queries |= {"append_round_trip": _appended, "bucketed_store_window": _bucketed, "pruned_store": _pruned}
_oracles["append_round_trip"] = _sql(f"SELECT {_ALL} FROM k")
_oracles["bucketed_store_window"] = _sql(f"SELECT {_ALL} FROM k WHERE datetime BETWEEN {T0} AND {T1}")
_oracles["pruned_store"] = _sql(f"SELECT {_ALL} FROM k WHERE datetime >= {T0 // (3 * DAY) * (3 * DAY)}")


# bounds, segments, writers
_read("bounded_scan", lambda r: r.bounded(KEY, [("close", 10.0, 30.0), ("volume", None, 50_000)], T0).select(r.names), f"SELECT {_ALL} FROM k WHERE datetime >= {T0} AND close_fp BETWEEN 1000000000 AND 3000000000 AND volume <= 50000")
_read("bounded_newest", lambda r: r.bounded(KEY, [("spread", -1, 1)], T0, T1, 40).select(r.names), f"SELECT {_ALL} FROM k WHERE datetime BETWEEN {T0} AND {T1} AND spread BETWEEN -1 AND 1 ORDER BY datetime DESC LIMIT 40")
_read("tick_bounded", lambda r: r.bounded(TICK_KEY, [("bid", None, -0.5)]).select(r.names), f"SELECT {_TICK_ALL} FROM t WHERE bid <= -0.5", tick=True)
_read("tick_count", lambda r: r.count(TICK_KEY), "SELECT count(*) AS n FROM t", tick=True)
_read("compare_columns", lambda r: r.window(KEY).select("datetime", r.schema.field("close").compared(F.col("close"), F.lit(20.0)).alias("against_20")), "SELECT datetime, CAST(sign(close - 20.0) AS INTEGER) AS against_20 FROM k")


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writers remember: one commits up to T0, another resumes after each key's last stamp, late rows are dropped."""
    _, path = _stored(spark, sf_dir, "resumed", upto=T0)
    again = StoreWriter(spark, path, BAR, repeats=True)
    again.append_frame(bars(spark, sf_dir).select("key", *[c.name for c in BAR.columns]).where(F.col("datetime") >= T0 - DAY), late="drop")
    store = StoreReader(spark, path, BAR)
    touched = spark.createDataFrame([(k, again.last(k)) for k in again.keys()], "key string, last long")
    return touched.join(store.records.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")


def _ns_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of nanosecond stamps in buckets of an hour, read around bucket bounds."""
    schema = RecordSchema("Fill", (Column("at", Kind.INT64, 8, time=True), Column("price", Kind.FLOAT64, 8, price=True)), TimeUnit.NS)
    path = scratch(spark, "ns")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    # the last nanosecond of the event's hour
    hour = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(3_600_000_000))
    rows = events.groupBy(hour.alias("h")).agg(F.max("value").alias("price")).select(F.lit("fills").alias("key"), (F.col("h") * F.lit(3_600_000_000_000) + F.lit(3_599_999_999_999)).alias("at"), "price")
    StoreWriter(spark, path, schema, bucket=dt.timedelta(hours=1)).append_frame(rows)
    return StoreReader(spark, path, schema).range("fills", T0 * 1_000_000, T1 * 1_000_000 - 1)


_queries |= {"append_resume": _resumed, "ns_bucket_window": _ns_buckets}
_oracles["append_resume"] = _sql(f"SELECT key, max(datetime) AS last, count(*) AS n FROM bars GROUP BY key HAVING max(datetime) >= {T0}")
_oracles["ns_bucket_window"] = f"""SELECT h * 3600000000000 + 3599999999999 AS "at", CAST(round(price * 1e8) AS BIGINT) / 1e8 AS price
  FROM (SELECT epoch_us(ts) // 3600000000 AS h, max(value) AS price FROM events WHERE event_type = 'click' GROUP BY 1)
  WHERE h * 3600000000000 + 3599999999999 BETWEEN {T0 * 1_000_000} AND {T1 * 1_000_000 - 1}"""


def queries() -> dict[str, Maker]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
