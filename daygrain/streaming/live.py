"""Bursts and daily activity over streams.

Both take rows in any order that the watermark allows and give what the batch
operators give for the same rows; a result is issued once, when the watermark
has passed it, and its state is dropped then.  Rows that come later than the
watermark allows are left out.

Spark's session windows hold the state of open bursts: a late event between two
of them makes them one.  Copies of a minute fold to its first record in the
state of that minute, and closed minutes fold to the state of their day.

Event time of a stream needs a zone in Spark, so zone-less stamps are taken as
UTC, the zone of the session, and given back zone-less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daygrain.operators.daily import activity_totals
from daygrain.operators.runs import BURST_SECONDS
from daygrain.session import scratch_dir

#: How late rows may come.
DELAY = "1 hour"


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows with a time stamp, and the watermark on it."""
    return df.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def live_bursts(events: DataFrame, keys: Sequence[str], ts: str, ident: str, seconds: float = BURST_SECONDS, delay: str = DELAY) -> DataFrame:
    """First shot, extent and size of every burst that the watermark has closed.

    Events up to ``seconds`` apart share a burst, as in ``runs.burst_groups``;
    put the day into ``keys`` to cut bursts at midnight.
    """
    gap = f"{int(seconds * 1_000_000) + 1} microseconds"  # exactly ``seconds`` apart is still together
    timed = _timed(events, ts, delay)
    return timed.groupBy(*keys, F.session_window(ts, gap).alias("_session")).agg(
        F.min_by(ident, F.struct(ts, ident)).alias("representative"), F.min(ts).cast("timestamp_ntz").alias("first_ts"),
        F.max(ts).cast("timestamp_ntz").alias("last_ts"), F.count("*").alias("n_events")).drop("_session")


def live_activity(minute: DataFrame, delay: str = DELAY) -> DataFrame:
    """``daily.activity_daily`` for every day that the watermark has closed."""
    first = _timed(minute, "ts", delay).groupBy("participant_id", "metric", "ts").agg(F.min_by("value", "seq").alias("value"), F.count("*").alias("n_raw"))
    days = first.groupBy("participant_id", F.window("ts", "1 day").alias("_day")).agg(*activity_totals())
    return days.select("participant_id", F.to_date("_day.start").alias("date"), *[c for c in days.columns if c not in ("participant_id", "_day")])


def run_to_end(stream: DataFrame) -> DataFrame:
    """Take all input that is there now, as many batches as the source makes of it, and read back what was issued."""
    spark = stream.sparkSession
    out = scratch_dir(spark, "issued")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "progress"))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
