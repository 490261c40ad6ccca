"""Trailing-window features on the daily table.

The table has exactly one row per participant and day, so a partition of
these windows holds at most the days of the horizon whatever the volume of
the raw sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

GROUP, ORDER = "participant_id", "date"
FFILL_LIMIT = 2
MISSING_SPECS = {  # ratio name -> (column, how a missing day shows)
    "wellness": ("n_wellness_rows", "zero"),
    "weight": ("weight_raw", "null"),
    "zones": ("zones_available", "zero"),
    "sleep": ("n_nights", "zero"),
    "srpe": ("srpe_n_sessions", "zero"),
}


def trailing(days: int, group: str = GROUP, order: str = ORDER):
    """Window over the last ``days`` daily rows, today included."""
    return Window.partitionBy(group).orderBy(order).rowsBetween(-(days - 1), 0)


def rolling_sum_mean(df: DataFrame, col: str, days: int = 7, prefix: str = "load") -> DataFrame:
    """Trailing sum and mean, one decimal."""
    w = trailing(days)
    return df.withColumns({f"{prefix}_{days}d_sum": F.round(F.sum(col).over(w), 1),
                           f"{prefix}_{days}d_mean": F.round(F.avg(col).over(w), 1)})


def rolling_mean(df: DataFrame, col: str, days: int, out: str) -> DataFrame:
    """Trailing mean."""
    return df.withColumn(out, F.avg(col).over(trailing(days)))


def rolling_sd(df: DataFrame, col: str, days: int, out: str) -> DataFrame:
    """Trailing sample standard deviation; NULL on one value."""
    return df.withColumn(out, F.stddev_samp(col).over(trailing(days)))


def rolling_max(df: DataFrame, col: str, days: int, out: str) -> DataFrame:
    """Trailing maximum with NULL read as 0."""
    return df.withColumn(out, F.max(F.coalesce(F.col(col), F.lit(0))).over(trailing(days)))




def monotony(df: DataFrame, col: str = "srpe_load", days: int = 7) -> Column:
    """Unrounded mean over sd of the trailing window; NULL without spread."""
    w = trailing(days)
    spread = F.max(col).over(w) > F.min(col).over(w)
    return F.when(spread, F.avg(col).over(w) / F.nullif(F.stddev_samp(col).over(w), F.lit(0.0)))


def load_features(df: DataFrame, col: str = "srpe_load") -> DataFrame:
    """Load sum, mean, monotony, strain and acute:chronic ratio."""
    w7, w28 = trailing(7), trailing(28)
    total, mean7, mean28 = F.sum(col).over(w7), F.avg(col).over(w7), F.avg(col).over(w28)
    mono = monotony(df, col)
    return df.withColumns({
        "load_7d_sum": F.round(total, 1), "load_7d_mean": F.round(mean7, 1),
        "monotony_7d": F.round(mono, 2), "strain_7d": F.round(total * mono, 1),
        "acwr_7_28": F.round(mean7 / F.nullif(mean28, F.lit(0.0)), 2)})


def rolling_median_residual(df: DataFrame, col: str, days: int = 7, stem: str | None = None) -> DataFrame:
    """Trailing median and the distance of today's value from it."""
    stem = stem or col.removesuffix("_raw")
    median = F.percentile(F.col(col), F.lit(0.5)).over(trailing(days))
    return df.withColumns({f"{stem}_{days}d_median": F.round(median, 2),
                           f"{stem}_residual": F.round(F.col(col) - median, 2)})


def window_stats(df: DataFrame, cols: Sequence[str], days: int = 7) -> DataFrame:
    """Trailing mean, median and sd of each column that is present."""
    w = trailing(days)
    out = {}
    for c in (c for c in cols if c in df.columns):
        out[f"{c}_mean_{days}d"] = F.avg(c).over(w)
        out[f"{c}_median_{days}d"] = F.percentile(F.col(c), F.lit(0.5)).over(w)
        out[f"{c}_std_{days}d"] = F.stddev_samp(c).over(w)
    return df.withColumns(out)


def missing_ratios(df: DataFrame, specs: Mapping[str, tuple[str, str]] = MISSING_SPECS,
                   days: int = 7) -> DataFrame:
    """Share of missing days in the trailing window, per signal."""
    w = trailing(days)
    out = {}
    for name, (col, shows) in specs.items():
        if col in df.columns:
            gone = F.col(col).isNull()
            if shows == "zero":
                gone = gone | (F.col(col) == 0)
            out[f"missing_ratio_{name}_{days}d"] = F.avg(gone.cast("double")).over(w)
    return df.withColumns(out)


def causal_ffill(df: DataFrame, cols: Sequence[str], limit: int = FFILL_LIMIT) -> DataFrame:
    """Carry the last value forward over at most ``limit`` days, with a flag.

    Nothing is filled from the future.
    """
    recent = Window.partitionBy(GROUP).orderBy(ORDER).rowsBetween(-limit, -1)
    out = {}
    for c in (c for c in cols if c in df.columns):
        carried = F.last(c, ignorenulls=True).over(recent)
        out[f"was_imputed_{c}"] = (F.col(c).isNull() & carried.isNotNull()).cast("int")
        out[c] = F.coalesce(F.col(c), carried)
    return df.withColumns(out)


def next_day_label(df: DataFrame, col: str = "readiness_same_day",
                   out: str = "readiness_next_day") -> DataFrame:
    """Tomorrow's value as the label, and whether it is known."""
    following = Window.partitionBy(GROUP).orderBy(ORDER)
    return (df.withColumn(out, F.lead(col).over(following))
            .withColumn("label_available", F.col(out).isNotNull().cast("int")))


def calendar_features(df: DataFrame, col: str = ORDER) -> DataFrame:
    """Weekday number and weekend flag."""
    return df.withColumns({"dow": F.weekday(col), "weekend_bin": F.weekday(col).isin(4, 5, 6).cast("int")})


def demean_within(df: DataFrame, cols: Sequence[str], group: str = GROUP) -> DataFrame:
    """Subtract the group mean of each column.

    The means are aggregated map-side and joined back, so a hot group is not
    collected the way a window over the group would.
    """
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, group, "left")
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def spike_days(df: DataFrame, col: str, k: float = 2.0, key: str = GROUP) -> DataFrame:
    """Days above mean + k sd of the participant's whole series."""
    spread = F.when(F.min(col) < F.max(col), F.stddev_samp(col))
    bounds = df.groupBy(key).agg(F.avg(col).alias("_mean"), spread.alias("_sd"))
    return (df.join(bounds, key).where((F.col("_sd") > 0) & (F.col(col) > F.col("_mean") + k * F.col("_sd")))
            .drop("_mean", "_sd"))
