"""Deduplication, set operations and incremental upserts, all with explicit arrival order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The row with the greatest `order` per key, by one aggregate that combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    picked = df.groupBy(key).agg(F.max_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("row_"))
    return picked.select(*[F.col(c) if c == key else F.col(f"row_.{c}").alias(c) for c in df.columns])


def both(old: DataFrame, new: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Old and new rows with the union of their columns and `arrival_`: old before new, then by `ordinal`."""
    place = lambda k: F.struct(F.lit(k).alias("part"), (F.col(ordinal) if ordinal else F.lit(0)).cast("long").alias("place"))
    return old.withColumn("arrival_", place(0)).unionByName(new.withColumn("arrival_", place(1)), allowMissingColumns=True)


def upsert_latest(master: DataFrame, increment: DataFrame, key: str, changed: str, ordinal: str | None = None) -> DataFrame:
    """Newest row per key by `changed`; a missing time counts as epoch, of equal times the later arrival wins."""
    time = F.coalesce(F.unix_micros(F.col(changed).cast("timestamp")), F.lit(0).cast("long"))
    return newest(both(master, increment, ordinal), key, [time, F.col("arrival_")]).drop("arrival_")


def latest_by_date(df: DataFrame, key: str, date: str, ordinal: str, nulls: str = "win") -> DataFrame:
    """Latest row per key; undated rows win (or, with nulls="lose", lose), of equal dates the later arrival wins."""
    undated = F.col(date).isNull() if nulls == "win" else F.col(date).isNotNull()
    return newest(df, key, [undated, F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), F.lit(0).cast("long")), F.col(ordinal)])


def keep_last_arrival(old: DataFrame, new: DataFrame, key: str, ordinal: str | None = None) -> DataFrame:
    """Last arrival per key, whatever its date."""
    return newest(both(old, new, ordinal), key, [F.col("arrival_")]).drop("arrival_")


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """First row per key by `ordinal`."""
    return newest(df, key, [-F.col(ordinal)])


def distinct_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True).distinct()


def incremental_slice(df: DataFrame, since: datetime | str, until: datetime | str, date: str) -> DataFrame:
    return df.filter(F.col(date).cast("timestamp").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


def high_water(df: DataFrame, dates: Sequence[str], until: datetime | str) -> DataFrame:
    """One row: the latest time in any of the columns, else `until`."""
    seen = F.greatest(*[F.col(d).cast("timestamp") for d in dates]) if len(dates) > 1 else F.col(dates[0]).cast("timestamp")
    return df.agg(F.coalesce(F.max(seen), F.lit(until).cast("timestamp")).alias("high_water"))


def calendar_windows(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """For each row of bounds, month windows to the last second, the last one clipped at the end."""
    first = F.date_trunc("month", F.col(start).cast("timestamp"))
    months = F.explode(F.sequence(first, F.col(end).cast("timestamp"), F.expr("interval 1 month"))).alias("month")
    opened = bounds.select(start, end, months)
    last = F.col("month") + F.expr("interval 1 month") - F.expr("interval 1 second")
    return opened.select(F.greatest(F.col("month"), F.col(start).cast("timestamp")).alias("window_start"), F.least(last, F.col(end).cast("timestamp")).alias("window_end"))
