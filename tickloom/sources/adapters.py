"""Event rows as bars and ticks.

Stamps are read as UTC: the session's time zone must be UTC for events without a zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.codec import scaled
from tickloom.schema import BAR, FLAG_ASK, FLAG_BID, FLAG_LAST, FLAG_VOLUME, TICK, RecordSchema


def with_stored(df: DataFrame, schema: RecordSchema) -> DataFrame:
    """Records (key and user columns) with their stored prices beside them."""
    return df.select("key", *[F.col(c.name) for c in schema.columns], *[scaled(F.col(c.name)).alias(c.stored) for c in schema.columns if c.price])


def bars_from_events(events: DataFrame) -> DataFrame:
    """A bar an event: key ``events/spot/<event_type>``, milliseconds, prices around ``value``."""
    micros, value = F.unix_micros(F.col("ts").cast("timestamp")), F.col("value")
    return with_stored(
        events.select(
            F.concat(F.lit("events/spot/"), "event_type").alias("key"),
            F.call_function("div", micros, F.lit(1000)).alias("datetime"),
            value.alias("open"),
            (value + 1).alias("high"),
            F.greatest(value - 1, F.lit(0.0)).alias("low"),
            value.alias("close"),
            F.col("user_id").alias("tick_volume"),
            (F.col("event_id") % 7 - 3).cast("int").alias("spread"),
            F.col("event_id").alias("volume"),
        ),
        BAR,
    )


def ticks_from_events(events: DataFrame) -> DataFrame:
    """A tick an event: key ``tick/<event_type>``, microseconds; every other event has last and volume."""
    value = F.col("value")
    quote = FLAG_BID | FLAG_ASK
    return with_stored(
        events.select(
            F.concat(F.lit("tick/"), "event_type").alias("key"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("datetime"),
            (value - 5).alias("bid"),
            (value + 0.01).alias("ask"),
            value.alias("last"),
            F.col("user_id").alias("volume"),
            F.when(F.col("event_id") % 2 == 0, quote | FLAG_LAST | FLAG_VOLUME).otherwise(quote).cast("long").alias("flags"),
            F.lit(0).cast("long").alias("volume_ext"),
        ),
        TICK,
    )
