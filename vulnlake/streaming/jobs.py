"""Feeds as streams: keyed upserts per micro-batch, and the newest event time per feed."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from vulnlake.operators.upsert import newest
from vulnlake.sources import snapshots


def feed_stream(spark: SparkSession, place: str, schema: StructType, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(place)


def stream_upsert(feed: DataFrame, master: str, key: str, changed: str, checkpoint: str, ordinal: str | None = None) -> StreamingQuery:
    """Upserts each micro-batch into the master at a path, one version a batch.

    A batch writes its own newest rows and is put together with small parts of the master only (`snapshots.upsert`); the
    version that takes it notes the stream (by its checkpoint's id) and the batch, so one that comes again after a stop
    changes nothing. Readers see whole versions; other writers may write between batches.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        order = [snapshots.moment(changed), F.col(ordinal).cast("long") if ordinal else F.lit(0)]
        snapshots.upsert(newest(batch, key, order), master, key, changed, csv=False, batch=(stream, number))

    return feed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_high_water(feed: DataFrame, name: str, dates: Sequence[str], late: str = "30 days") -> DataFrame:
    """Newest event time per feed, in update mode; rows later than `late` behind the watermark may be dropped."""
    seen = F.greatest(*[F.col(d).cast("timestamp") for d in dates]) if len(dates) > 1 else F.col(dates[0]).cast("timestamp")
    return feed.select(F.col(name), seen.alias("seen")).withWatermark("seen", late).groupBy(name).agg(F.max("seen").alias("high_water"))


MARK = "feed string, high_water timestamp_ntz, late_rows long, idle boolean"


def stream_marks(feed: DataFrame, name: str, dates: Sequence[str], idle: str = "1 day", late: str = "30 days") -> DataFrame:
    """High-water marks that also move on without data, in update mode: feed, high_water, late_rows, idle.

    A mark is the newest time seen. A feed that is silent for `idle` (of processing time) has its mark moved to now, and
    again as long as it stays silent. Rows of a day more than `late` before the mark are counted apart and don't move it.
    Tasks reduce a batch to a row per feed and day first, so no feed's rows meet in one task.
    """
    seen = F.greatest(*[F.col(d).cast("timestamp") for d in dates]) if len(dates) > 1 else F.col(dates[0]).cast("timestamp")
    wait, behind = (pd.Timedelta(t) for t in (idle, late))

    def by_day(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            days = frame.groupby([frame["feed"], frame["seen"].dt.floor("D")])["seen"]
            yield pd.DataFrame({"n": days.size(), "newest": days.max()}).reset_index(names=["feed", "day"])

    def moved(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, late_rows = state.get if state.exists else (None, 0)
        mark = None if mark is None else pd.Timestamp(mark, unit="us")
        if state.hasTimedOut:
            mark = max(mark, pd.Timestamp.now("UTC").tz_localize(None))
        else:
            for frame in frames:
                for day, n, newest in zip(frame["day"], frame["n"], frame["newest"]):
                    if mark is not None and day < (mark - behind).floor("D"):
                        late_rows += int(n)
                    else:
                        mark = newest if mark is None else max(mark, newest)
        silent = bool(state.hasTimedOut)
        state.update((int(mark.value // 1000), late_rows))
        state.setTimeoutDuration(int(wait.total_seconds() * 1000))
        yield pd.DataFrame({"feed": [key[0]], "high_water": [mark], "late_rows": [late_rows], "idle": [silent]})

    rows = feed.select(F.col(name).cast("string").alias("feed"), seen.cast("timestamp_ntz").alias("seen")).filter("feed IS NOT NULL AND seen IS NOT NULL")
    reduced = rows.mapInPandas(by_day, "feed string, day timestamp_ntz, n long, newest timestamp_ntz")
    marks = reduced.groupBy("feed").applyInPandasWithState(moved, MARK, "mark long, late_rows long", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return marks.withColumn("high_water", F.col("high_water").cast("timestamp"))
