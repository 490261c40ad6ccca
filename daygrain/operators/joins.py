"""Joins: spine, dimension, as-of, time proximity and keyed caches.

No join is forced to broadcast: AQE broadcasts a side once its measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions
of sort-merge joins otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.functions.cleaning import valid_macros
from daygrain.functions.dates import epoch_us, seconds_between
from daygrain.operators.timetree import WindowTree
from daygrain.session import stored

KEYS = ["participant_id", "date"]


def day_spine(participants: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """One row per participant and calendar day of the horizon, both ends in.

    ``start``/``end`` are ISO dates or columns of ``participants``.
    """
    first = F.to_date(F.lit(start) if isinstance(start, str) else start)
    last = F.to_date(F.lit(end) if isinstance(end, str) else end)
    return participants.select("participant_id", F.explode(F.sequence(first, last)).alias("date"))


def minute_grid(days: DataFrame) -> DataFrame:
    """All 1440 minutes of each day row; only for output that needs the grid."""
    start = F.col("date").cast("timestamp_ntz")
    stop = start + F.expr("INTERVAL '23:59' HOUR TO MINUTE")
    return days.withColumn("minute", F.explode(
        F.sequence(start, stop, F.expr("INTERVAL 1 MINUTE"))))


def join_spine(spine: DataFrame, dailies: Mapping[str, DataFrame],
               defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join every daily aggregate onto the spine, then fill per column.

    ``defaults`` names the columns where an absent source means a true zero;
    all others stay NULL (unknown).
    """
    out = spine
    for daily in dailies.values():
        out = out.join(daily, KEYS, "left")
    fills = {c: v for c, v in (defaults or {}).items() if c in out.columns}
    return out.fillna(fills) if fills else out


def reindex_days(daily: DataFrame, spine: DataFrame, fill: float | None = None,
                 cols: Sequence[str] | None = None) -> DataFrame:
    """Stretch a daily table to the full horizon, NULL- or constant-filled."""
    out = spine.join(daily, KEYS, "left")
    targets = list(cols) if cols else [c for c in daily.columns if c not in KEYS]
    return out if fill is None else out.fillna(fill, subset=targets)


def with_static(df: DataFrame, dim: DataFrame, key: str = "participant_id") -> DataFrame:
    """Attach per-participant covariates; unknown participants get NULLs."""
    return df.join(dim, key, "left")


def nights_ending_in(sleep: DataFrame, windows: DataFrame | WindowTree) -> DataFrame:
    """Sleep records whose end lies in the window of their participant.

    ``windows``: participant_id, window_id, lower, upper, inclusive.  A record
    must start no earlier than the day before the window.
    """
    lookback = (F.to_date("lower") - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return rows_in_windows(sleep, "end_ts", windows).where(F.col("start_ts") >= lookback)


def rows_in_windows(df: DataFrame, ts: str, windows: DataFrame | WindowTree) -> DataFrame:
    """Rows matched to the windows of their participant that contain ``ts``, with the columns of the window."""
    return WindowTree.of(windows).rows(df, ts)


def last_known(df: DataFrame, windows: DataFrame, ts: str, payload: str) -> DataFrame:
    """Latest payload up to the last day of each window (as-of join).

    Reports are folded to the last one per participant and day; days and
    window ends are then merged in one ordered pass per participant, whose
    length the calendar bounds.  ``payload`` is a ``MAP<STRING,STRING>``.
    """
    report = F.max(F.struct(F.col(ts).alias("at"), F.to_json(payload).alias("json")))
    daily = (df.groupBy("participant_id", F.to_date(ts).alias("_day"))
             .agg(report.alias("_report")).withColumn("window_id", F.lit(None)))
    asked = windows.select("participant_id", F.to_date("upper").alias("_day"), "window_id")
    # NULLs sort first, so a day's report precedes the windows ending that day.
    so_far = (Window.partitionBy("participant_id").orderBy("_day", F.col("window_id").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, 0))
    merged = daily.unionByName(asked, allowMissingColumns=True).withColumn(
        "_last", F.last("_report", ignorenulls=True).over(so_far))
    return merged.where(F.col("window_id").isNotNull()).select(
        "participant_id", "window_id", F.col("_last.at").alias("last_report_ts"),
        F.from_json("_last.json", "map<string,string>").alias("last_known"))


def pairs_within(events: DataFrame, key: str, ts: str, ident: str, seconds: float) -> DataFrame:
    """Pairs of events of one key at most ``seconds`` apart (inclusive).

    Time is cut into buckets of ``seconds``; the earlier event looks only into
    its own and the next bucket, so the join is an equality join of
    (key, bucket) and never compares events further apart.  The earlier event
    (ties by ``ident``) is side 1.
    """
    width = int(seconds * 1_000_000)
    base = events.where(F.col(ts).isNotNull()).select(key, ts, ident, epoch_us(ts).alias("_us"))
    base = base.withColumn("_bucket", F.floor(F.col("_us") / F.lit(max(width, 1))))
    left = base.select(key, F.col(ts).alias("ts_1"), F.col(ident).alias(f"{ident}_1"),
                       F.col("_us").alias("_us_1"),
                       F.explode(F.array("_bucket", F.col("_bucket") + 1)).alias("_bucket"))
    right = base.select(key, F.col(ts).alias("ts_2"), F.col(ident).alias(f"{ident}_2"),
                        F.col("_us").alias("_us_2"), "_bucket")
    gap = F.col("_us_2") - F.col("_us_1")
    ordered = (gap > 0) | ((gap == 0) & (F.col(f"{ident}_1") < F.col(f"{ident}_2")))
    return (left.join(right, [key, "_bucket"]).where(ordered & (gap <= width))
            .withColumn("gap_s", gap / F.lit(1e6))
            .drop("_bucket", "_us_1", "_us_2"))


def adjacency(pairs: DataFrame, key: str, ident: str) -> DataFrame:
    """Both directions of every pair, one neighbour per row."""
    a, b = f"{ident}_1", f"{ident}_2"
    forward = pairs.select(key, F.col(a).alias("node"), F.col(b).alias("neighbour"))
    return forward.unionByName(
        pairs.select(key, F.col(b).alias("node"), F.col(a).alias("neighbour")))


def with_labels(items: DataFrame, labels: DataFrame, key: str, label: str,
                default: str = "PENDING") -> DataFrame:
    """Attach cached labels; items without a cache entry read ``default``."""
    marked = labels.withColumn("_hit", F.lit(True))
    return (items.join(marked, key, "left")
            .withColumn(label, F.when(F.col("_hit"), F.col(label)).otherwise(F.lit(default)))
            .drop("_hit"))


def pending_keys(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Items that are not in the cache yet."""
    return items.join(cache.select(key), key, "left_anti")


def cache_hits(items: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """Items whose cached payload exists and is valid."""
    usable = cache.select(key, valid_macros(payload).alias(payload)).where(F.col(payload).isNotNull())
    return items.join(usable, key)


def pair_gaps(pairs: DataFrame, events: DataFrame, key: str, file: str, ts: str) -> DataFrame:
    """Absolute gap in seconds of named file pairs; NULL if either is unknown."""
    stamps = events.select(key, file, ts)
    first = stamps.withColumnsRenamed({file: "file1", ts: "_ts1"})
    second = stamps.withColumnsRenamed({file: "file2", ts: "_ts2"})
    return (pairs.join(first, [key, "file1"], "left").join(second, [key, "file2"], "left")
            .withColumn("gap_s", F.abs(seconds_between("_ts1", "_ts2"))).drop("_ts1", "_ts2"))


def lookup_with_fallback(df: DataFrame, params: DataFrame, group: str,
                         cols: Sequence[str], suffix: str = "_mean",
                         global_name: str = "GLOBAL") -> DataFrame:
    """Per-group parameters, or the row of all groups for groups that have none.

    That row is the one marked by a column ``is_global``, else the one named
    ``global_name``.  A group that exists keeps its own NULL parameters; there is no fallback
    column by column.  The parameters are stored first, so that Spark knows their size: small ones are
    broadcast, and the rows stay where they are instead of meeting by group.
    """
    params = stored(params, "params")
    pooled_row = F.col("is_global") if "is_global" in params.columns else F.col(group) == global_name
    own = params.where(~pooled_row).select(
        group, F.lit(True).alias("_hit"), *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    pooled = params.where(pooled_row)
    out = df.join(own, group, "left")
    fallback = pooled.select(F.struct(*cols)).scalar()
    filled = {f"{c}{suffix}": F.when(F.col("_hit"), F.col(f"{c}{suffix}"))
              .otherwise(fallback.getField(c)) for c in cols}
    return out.withColumns(filled).drop("_hit")
