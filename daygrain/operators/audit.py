"""Data-quality audits of the typed sources, one table each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daygrain.functions import cleaning as C, dates as D, encoding as E
from daygrain.operators.joins import KEYS, reindex_days
from daygrain.operators.ordered import with_position, with_previous
from daygrain.operators.runs import gap_profile, gaps, nonwear_horizon, nonwear_runs
from daygrain.operators.stats import bounded_quantiles, describe12, value_shares
from daygrain.operators.tables import distinct_text, top_k

PID = "participant_id"
# The expected sources of one participant.
EXPECTED_SOURCES = (
    "calories.json", "distance.json", "steps.json", "heart_rate.json", "resting_heart_rate.json",
    "time_in_heart_rate_zones.json", "sleep.json", "exercise.json", "sleep_score.csv",
    "wellness.csv", "srpe.csv", "injury.csv", "reporting.csv")
HALF_SPLIT_MIN = 10


def _pct(condition: Column, digits: int = 1) -> Column:
    return F.round(100 * F.avg(condition.cast("double")), digits)


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Path and bytes of every file of a per-person tree (contents not read)."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
              .select("path", F.col("length").alias("size_bytes")))
    parts = F.regexp_extract("path", r"([^/]+)/[^/]+/([^/]+)$", 1)
    return listed.select(parts.alias(PID), E.basename("path").alias("source"), "size_bytes")


def audit_inventory(participants: DataFrame, row_counts: DataFrame, sizes: DataFrame | None = None,
                    expected: Sequence[str] = EXPECTED_SOURCES) -> DataFrame:
    """Every expected source of every participant: is it there, how large.

    ``row_counts``: participant_id, source, n_rows.
    """
    wanted = participants.select(PID, F.explode(F.array(*[F.lit(s) for s in expected])).alias("source"))
    out = wanted.join(row_counts, [PID, "source"], "left")
    if sizes is not None:
        out = out.join(sizes, [PID, "source"], "left").fillna(0, subset=["size_bytes"])
    return (out.withColumn("exists", F.col("n_rows").isNotNull()).fillna(0, subset=["n_rows"]))


def audit_schema(df: DataFrame, source: str, keys: Sequence[str] = (PID,),
                 timestamp: str | None = None, order: str = "seq") -> DataFrame:
    """Per field: type, share of numeric text, missing values, and the first known value in record order.

    Without an ``order`` column the sample is the smallest value.
    """
    placed = order in df.columns
    fields = [c for c in df.columns if c not in keys and c != order]
    ids = [*keys, *([order] if placed else [])]
    long = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(ids, fields, "field", "v")
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes if c in fields for x in (c, t)])
    return long.groupBy(*keys, "field").agg(
        F.round(F.avg(F.col("v").try_cast("double").isNotNull().cast("double")), 3).alias("numeric_share"),
        F.count_if(F.col("v").isNull()).alias("n_missing"),
        (F.min_by("v", F.when(F.col("v").isNotNull(), F.col(order))) if placed else F.min("v")).alias("sample"),
    ).select(F.lit(source).alias("dataset"), *keys, "field", F.element_at(types, F.col("field")).alias("dtype"),
             "numeric_share", "n_missing", "sample",
             (F.col("field") == F.lit(timestamp or "")).alias("is_timestamp"))


def audit_drift(sleep: DataFrame, exercise: DataFrame) -> DataFrame:
    """Counts of sleep types, logs with event data and activity names."""
    def counted(df: DataFrame, what: str, value: Column) -> DataFrame:
        return (df.groupBy(PID, value.cast("string").alias("value")).agg(F.count("*").alias("n"))
                .withColumn("what", F.lit(what)))

    parts = [counted(sleep, "sleep_type", F.col("sleep_type")),
             counted(sleep, "has_level_data", F.col("has_level_data")),
             counted(exercise, "activity_name", F.col("activity_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(PID, "what", "value", "n")


def audit_horizon(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """First, last, rows and distinct days per participant and modality.

    Rows fold to days first; the distinct count is then a plain count.
    """
    parts = None
    for name, (df, ts) in sources.items():
        days = df.groupBy(PID, F.to_date(ts).alias("_d")).agg(
            F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count("*").alias("_n"))
        part = days.withColumn("modality", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(PID, "modality").agg(
        F.min("_lo").alias("first_ts"), F.max("_hi").alias("last_ts"), F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_days"))


def audit_minutes(minute: DataFrame, start: str, end: str) -> DataFrame:
    """Duplicates, missing slots and daily coverage of the minute metrics."""
    expected = D.days_between_inclusive(start, end) * 1440
    stamps = minute.groupBy(PID, "metric", "ts").agg(F.count("*").alias("_n"))
    days = stamps.groupBy(PID, "metric", F.to_date("ts").alias("_d")).agg(
        F.sum("_n").alias("_rows"), F.count("*").alias("_distinct"))
    return days.groupBy(PID, "metric").agg(
        F.sum("_rows").alias("n_records"), F.sum("_distinct").alias("n_unique_ts"),
        F.sum(F.col("_rows") - F.col("_distinct")).alias("n_duplicates"),
        F.lit(expected).cast("long").alias("expected_slots"),
        (F.lit(expected) - F.sum("_distinct")).alias("missing_slots"),
        F.round(100 * (F.lit(expected) - F.sum("_distinct")) / F.lit(float(expected)), 2).alias("missing_pct"),
        F.count("*").alias("days_present"), F.count_if(F.col("_rows") == 1440).alias("days_full"),
        F.count_if(F.col("_rows") < 1440).alias("days_partial"), F.min("_rows").alias("min_daily"),
        F.max("_rows").alias("max_daily"), F.round(F.avg("_rows"), 1).alias("mean_daily"))


def audit_nonwear(steps: DataFrame, hr: DataFrame, participants: DataFrame, start: str, end: str) -> DataFrame:
    """Summary of the horizon non-wear per participant."""
    per_run = nonwear_runs(steps, hr, participants, start, end).groupBy(PID).agg(
        F.count("*").alias("n_long_runs"), F.sum("n_min").alias("total_nonwear_min"))
    per_day = nonwear_horizon(steps, hr, participants, start, end).groupBy(PID).agg(
        F.round(F.avg("nonwear_min"), 1).alias("mean_per_day"),
        *bounded_quantiles("nonwear_min", {"median_per_day": 0.5}),
        F.max("nonwear_min").alias("max_one_day"), F.count("*").alias("days_with_any"))
    return (participants.select(PID).join(per_run, PID, "left").join(per_day, PID, "left")
            .fillna(0).withColumn("total_nonwear_hours", F.round(F.col("total_nonwear_min") / 60, 1)))


def daily_values(minute: DataFrame, bouts: DataFrame, spine: DataFrame) -> DataFrame:
    """Long daily values: NULL gaps for the minute sums, zeros for exercise."""
    sums = (minute.groupBy(PID, F.to_date("ts").alias("date"), "metric").agg(F.sum("value").alias("value")))
    metrics = F.explode(F.array(*[F.lit(m) for m in ("steps", "distance", "calories")]))
    grid = spine.select(*KEYS, metrics.alias("metric"))
    active = bouts.groupBy(PID, F.to_date("start_ts").alias("date")).agg(
        C.total_minutes("active_ms", "duration_ms").alias("value"))
    exercise = reindex_days(active, spine.select(*KEYS), 0.0, ["value"]).withColumn(
        "metric", F.lit("exercise_active_min"))
    return grid.join(sums, [*KEYS, "metric"], "left").unionByName(exercise.select(*KEYS, "metric", "value"))


def audit_daily(values: DataFrame) -> DataFrame:
    """Twelve-number summary of the daily values (at most a horizon of rows each)."""
    return describe12(values, [PID, "metric"], "value", bounded=True)


def daily_wide(values: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One column per metric, one row per participant and day."""
    return values.groupBy(*KEYS).pivot("metric", list(metrics)).agg(F.max("value"))


def half_split_drift(df: DataFrame, key: str, ts: str, ident: str, col: str,
                     min_n: int = HALF_SPLIT_MIN) -> DataFrame:
    """Mean of the later half minus mean of the earlier half of the valid values.

    The middle value of an odd count belongs to the later half.
    """
    valid = df.where(F.col(col).isNotNull())
    placed = with_position(valid, [key], ts, [ts, ident], "_pos")
    sizes = valid.groupBy(key).agg(F.count("*").alias("_n"))
    early = F.col("_pos") <= F.floor(F.col("_n") / 2)
    means = placed.join(sizes, key).groupBy(key).agg(
        F.avg(F.when(~early, F.col(col))).alias("_late"), F.avg(F.when(early, F.col(col))).alias("_early"),
        F.max("_n").alias("n_valid"))
    drift = F.when(F.col("n_valid") >= min_n, F.col("_late") - F.col("_early"))
    return means.select(key, "n_valid", drift.alias("drift"))


def audit_rhr(rhr: DataFrame) -> DataFrame:
    """Valid and sentinel counts, summary and drift of the resting heart rate."""
    valid = rhr.withColumn("_v", F.when(F.col("value") > 0, F.col("value")))
    counts = valid.groupBy(PID).agg(F.count_if(F.col("_v").isNull()).alias("n_sentinel"))
    drift = half_split_drift(valid, PID, "ts", "seq", "_v").withColumn("drift", F.round("drift", 2))
    return (counts.join(describe12(valid, [PID], "_v"), PID, "left")
            .join(drift.drop("n_valid"), PID, "left"))


def audit_hr(hr: DataFrame) -> DataFrame:
    """Summaries of all samples and of the daily peaks."""
    samples = describe12(hr, [PID], "bpm").withColumn("modality", F.lit("samples"))
    peaks = hr.groupBy(PID, F.to_date("ts").alias("date")).agg(F.max("bpm").alias("peak"))
    daily_peak = describe12(peaks, [PID], "peak", bounded=True).withColumn("modality", F.lit("daily_peak"))
    return samples.unionByName(daily_peak)


def audit_confidence(hr: DataFrame) -> DataFrame:
    """Samples per confidence level; unknown is a level of its own."""
    return hr.groupBy(PID, "confidence").agg(F.count("*").alias("n"))


def audit_zones(zones: DataFrame, keys: Sequence[str] = E.ZONE_KEYS) -> DataFrame:
    """Summary of the daily minutes of each zone; a missing zone counts 0."""
    minutes = F.array(*[F.struct(F.lit(z).alias("zone"), F.coalesce(
        F.try_element_at("zones", F.lit(z)), F.lit(0.0)).alias("minutes")) for z in keys])
    stamped = zones.select(PID, F.to_date("ts").alias("date"), F.inline(minutes))
    days = stamped.groupBy(PID, "date", "zone").agg(F.sum("minutes").alias("minutes"))
    return describe12(days, [PID, "zone"], "minutes", bounded=True)


def sleep_nights(sleep: DataFrame) -> DataFrame:
    """Night table; only staged logs have a stage split."""
    staged = F.coalesce(F.col("sleep_type") == "stages", F.lit(False))
    return sleep.withColumns({f"{s}_min": F.when(staged, F.col(f"{s}_min"))
                              for s in ("deep", "light", "rem", "wake")})


SLEEP_METRICS = ("asleep_min", "awake_total_min", "time_in_bed_min", "efficiency_pct", "deep_min",
                 "light_min", "rem_min", "wake_min")


def audit_sleep(sleep: DataFrame, metrics: Sequence[str] = SLEEP_METRICS) -> DataFrame:
    """Summary of every night metric."""
    nights = sleep_nights(sleep).select(PID, *[F.col(c).cast("double").alias(c) for c in metrics])
    return describe12(nights.unpivot([PID], list(metrics), "metric", "value"), [PID, "metric"], "value")


def sleep_architecture(sleep: DataFrame) -> DataFrame:
    """Unrounded stage shares of the staged nights with a complete split."""
    nights = sleep_nights(sleep)
    total = F.col("deep_min") + F.col("light_min") + F.col("rem_min") + F.col("wake_min")
    return nights.withColumn("_t", total).where(F.col("_t") > 0).select(
        PID, "date_of_sleep", *[(100 * F.col(f"{s}_min") / F.col("_t")).alias(f"{s}_pct")
                                for s in ("deep", "light", "rem", "wake")])


def audit_sleep_arch(sleep: DataFrame) -> DataFrame:
    """Summary of the stage shares."""
    shares = [f"{s}_pct" for s in ("deep", "light", "rem", "wake")]
    long = sleep_architecture(sleep).select(PID, *shares).unpivot([PID], shares, "metric", "value")
    return describe12(long, [PID, "metric"], "value")


def audit_response(wellness: DataFrame, days: int) -> DataFrame:
    """Response rate and time of day of the questionnaires.

    Hours have 24 values, so they are counted before the median is taken.
    """
    hours = wellness.groupBy(PID, F.to_date("ts").alias("_d"), F.hour("ts").alias("_h")).agg(
        F.count("*").alias("_n"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    per_day = hours.groupBy(PID, "_d").agg(F.lit(1).alias("_one")).groupBy(PID).agg(
        F.count("*").alias("n_days_with_log"))
    by_hour = hours.groupBy(PID, "_h").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"),
                                           F.max("_hi").alias("_hi"))
    n, h = F.col("_n"), F.col("_h").cast("double")
    total = F.sum(n)
    spread = F.sum(n * h * h) - F.sum(n * h) * F.sum(n * h) / total
    stats = by_hour.groupBy(PID).agg(
        total.alias("n_rows"), F.min("_lo").alias("first_ts"), F.max("_hi").alias("last_ts"),
        F.round(F.percentile(h, F.lit(0.5), n), 2).alias("median_hour"),
        F.round(F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(total - 1, F.lit(0))), 2).alias("sd_hour"),
        F.round(100 * F.sum(F.when(h < 9, n).otherwise(0)) / total, 1).alias("pct_before_09"),
        F.round(100 * F.sum(F.when(h >= 12, n).otherwise(0)) / total, 1).alias("pct_after_12"))
    return stats.join(per_day, PID).withColumns({
        "horizon_days": F.lit(days), "response_rate": F.round(F.col("n_days_with_log") / days, 3)})


def audit_hours(wellness: DataFrame) -> DataFrame:
    """Answers per hour of day."""
    return wellness.groupBy(PID, F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def audit_likert(wellness: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Summary, mode, share of the mode and shares of all answers per item.

    Answers are counted first; the lists below hold one entry per answer of a
    scale.
    """
    long = wellness.select(PID, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [PID], list(cols), "metric", "value")
    shares = value_shares(long, [PID, "metric"], "value")
    text = F.concat(F.col("value").cast("int").cast("string"), F.lit(":"),
                    F.format_string("%.0f", 100 * F.col("share")), F.lit("%"))
    modes = shares.groupBy(PID, "metric").agg(
        F.max_by("value", F.struct("n", (-F.col("value")).alias("v"))).alias("mode"),
        F.round(F.max("share"), 3).alias("mode_share"), F.count("*").alias("n_unique"))
    listed = (distinct_text(shares.withColumn("_t", F.concat(
        F.lpad(F.format_string("%.3f", "value"), 16, " "), F.lit("|"), text)), [PID, "metric"], "_t", ";", "_all"))
    clean = listed.select(PID, "metric", F.regexp_replace("_all", r" *-?[0-9.]+\|", "").alias("value_counts"))
    return (describe12(long, [PID, "metric"], "value").join(modes, [PID, "metric"], "left")
            .join(clean, [PID, "metric"], "left"))


def audit_variance(df: DataFrame, cols: Sequence[str], group: str = PID) -> DataFrame:
    """Within- against between-participant spread of each column."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [group], list(cols), "metric", "value")
    groups = long.groupBy("metric", group).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"),
        F.sum("value").alias("s"), F.count("value").alias("n"))
    out = groups.groupBy("metric").agg(
        (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("grand_mean"),
        F.avg("sd").alias("within_sd"), F.stddev_samp("m").alias("between_sd"))
    return out.select(
        "metric", F.round("grand_mean", 2).alias("grand_mean"), F.round("within_sd", 3).alias("within_sd"),
        F.round("between_sd", 3).alias("between_sd"),
        F.round(F.col("between_sd") / F.nullif(F.col("within_sd"), F.lit(0.0)), 2).alias("ratio"))


def audit_load(srpe: DataFrame, spine: DataFrame) -> DataFrame:
    """Training-load summary over the zero-filled horizon."""
    load = F.col("rpe") * F.col("duration_min")
    sessions = srpe.groupBy(PID).agg(
        F.count("*").alias("n_sessions"), F.round(F.avg("rpe"), 2).alias("mean_rpe"),
        F.round(F.avg("duration_min"), 1).alias("mean_duration"),
        F.round(F.coalesce(F.sum(load), F.lit(0.0)), 1).alias("total_load"))
    per_day = srpe.groupBy(PID, F.to_date("ts").alias("date")).agg(F.sum(load).alias("load"))
    full = reindex_days(per_day, spine.select(*KEYS), 0.0, ["load"])
    spread = F.when(F.min("load") < F.max("load"), F.stddev_samp("load")).otherwise(0.0)
    horizon = full.groupBy(PID).agg(F.avg("load").alias("_m"), spread.alias("_sd"),
                                    F.sum("load").alias("_s"), F.max("load").alias("max_daily_load"))
    spikes = full.join(horizon.select(PID, "_m", "_sd"), PID).groupBy(PID).agg(
        F.count_if((F.col("_sd") > 0) & (F.col("load") > F.col("_m") + 2 * F.col("_sd"))).alias("n_spike_days"))
    kinds = distinct_text(srpe.select(PID, F.explode("activity_names").alias("activity")), [PID],
                          "activity", ";", "activity_types")
    mono = F.col("_m") / F.nullif(F.col("_sd"), F.lit(0.0))
    return (horizon.join(spikes, PID).join(sessions, PID, "left").join(kinds, PID, "left")
            .fillna(0, subset=["n_sessions"]).fillna(0.0, subset=["total_load"])
            .select(PID, "n_sessions", "mean_rpe", "mean_duration", "total_load",
                    F.round("_m", 2).alias("mean_daily_load"), F.round("_sd", 2).alias("sd_daily_load"),
                    F.round(mono, 3).alias("monotony"), F.round(F.col("_s") * mono, 1).alias("strain"),
                    "n_spike_days", "max_daily_load", "activity_types"))


def abs_deltas(df: DataFrame, key: str, ts: str, ident: str, col: str) -> DataFrame:
    """Absolute change from the previous known value."""
    known = df.where(F.col(col).isNotNull())
    lagged = with_previous(known, [key], ts, [ts, ident], {"_before": col})
    return lagged.where(F.col("_before").isNotNull()).withColumn(
        "abs_delta", F.abs(F.col(col) - F.col("_before"))).drop("_before")


def audit_weight(reporting: DataFrame, col: str = "weight") -> DataFrame:
    """Stability of the self-reported weight."""
    w = F.col(col)
    base = reporting.groupBy(PID).agg(
        F.count(w).alias("n_obs"), F.count_if(w.isNull()).alias("n_missing"), F.round(F.avg(w), 2).alias("mean"),
        F.round(F.stddev_samp(w), 3).alias("sd"),
        F.round(100 * F.stddev_samp(w) / F.nullif(F.avg(w), F.lit(0.0)), 3).alias("cv_pct"),
        F.min(w).alias("min"), F.max(w).alias("max"), (F.max(w) - F.min(w)).alias("range"))
    steps = abs_deltas(reporting, PID, "ts", "seq", col).groupBy(PID).agg(
        F.round(F.avg("abs_delta"), 3).alias("mean_abs_delta"), F.max("abs_delta").alias("max_abs_delta"),
        F.count_if(F.col("abs_delta") > 2).alias("n_gt2"))
    return base.join(steps, PID, "left").fillna(0, subset=["n_gt2"])


def audit_alcohol(reporting: DataFrame) -> DataFrame:
    """How often, and on which weekdays, alcohol is reported."""
    yes = F.coalesce(F.lower("alcohol_consumed") == "yes", F.lit(False))
    names = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    per_day = [F.count_if(yes & (F.weekday("ts") == i)).alias(f"yes_{n.lower()}") for i, n in enumerate(names)]
    weekend = F.when(yes, F.weekday("ts").isin(4, 5, 6).cast("double"))
    return reporting.groupBy(PID).agg(
        F.count("*").alias("n_rows"), F.count_if(yes).alias("n_yes"), _pct(yes).alias("pct_yes"),
        F.round(100 * F.avg(weekend), 1).alias("pct_weekend"),
        F.round(F.avg("glasses_of_fluid"), 2).alias("glasses_mean"), *per_day)


def audit_photos(meta: DataFrame) -> DataFrame:
    """Size, metadata completeness and odd names of the photo files.

    ``meta``: participant_id, file, format, mode, width, height, size_bytes,
    ts, has_gps, has_orientation (decoding happens upstream).
    """
    return meta.groupBy(PID).agg(
        F.count("*").alias("n_images"), F.round(F.avg("size_bytes") / 1024, 1).alias("mean_kb"),
        F.round(F.min("size_bytes") / 1024, 1).alias("min_kb"),
        F.round(F.max("size_bytes") / 1024, 1).alias("max_kb"),
        _pct(F.col("ts").isNotNull()).alias("pct_datetime"), _pct(F.col("has_gps")).alias("pct_gps"),
        _pct(F.col("has_orientation")).alias("pct_orientation"),
        F.count_if(F.col("format") == "UNREADABLE").alias("n_unreadable"),
        F.count_if(C.suspicious_name("file")).alias("n_suspicious"))


def photo_facets(meta: DataFrame, facets: Sequence[str] = ("format", "mode"), k: int = 3) -> DataFrame:
    """Files per format and colour mode, and the k most frequent resolutions."""
    counted = None
    for facet in facets:
        part = meta.groupBy(PID, F.col(facet).alias("value")).agg(F.count("*").alias("n")).withColumn(
            "facet", F.lit(facet))
        counted = part if counted is None else counted.unionByName(part)
    sized = meta.withColumn("value", F.concat_ws("x", "width", "height"))
    return counted.unionByName(top_k(sized, ["value"], k, [PID]).withColumn("facet", F.lit("resolution")))


def audit_cadence(photos: DataFrame, ts: str = "ts", ident: str = "file") -> DataFrame:
    """Intervals between consecutive photos."""
    return gap_profile(gaps(photos, [PID], ts, ident), [PID])


def audit_injuries(injury: DataFrame) -> DataFrame:
    """Reports and events per participant, and counts by location and severity."""
    named = injury.select(PID, F.explode("injuries").alias("location", "severity"))
    totals = injury.groupBy(PID).agg(
        F.count("*").alias("reports"), F.count_if(F.size("injuries") > 0).alias("events"))
    kinds = F.array(F.struct(F.lit("reports").alias("kind"), F.lit("all").alias("value"), F.col("reports").alias("n")),
                    F.struct(F.lit("events").alias("kind"), F.lit("all").alias("value"), F.col("events").alias("n")))
    parts = [totals.select(PID, F.inline(kinds))]
    for kind in ("location", "severity"):
        parts.append(named.groupBy(PID, F.col(kind).alias("value")).agg(F.count("*").alias("n"))
                     .select(PID, F.lit(kind).alias("kind"), "value", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def incidence(injury: DataFrame, exposure: DataFrame) -> DataFrame:
    """Injury events per 1,000 hours, over all exposure and over logged training."""
    events = injury.agg(F.count_if(F.size("injuries") > 0).alias("n_events"))
    hours = exposure.agg((F.sum("srpe_min") / 60).alias("srpe_h"), F.sum("total_h").alias("total_h"))
    e = events.select("n_events").scalar()
    return hours.select(
        e.alias("n_events"), "srpe_h", "total_h",
        F.round(1000 * e / F.nullif(F.col("total_h"), F.lit(0.0)), 1).alias("per_1000h"),
        F.round(1000 * e / F.nullif(F.col("srpe_h"), F.lit(0.0)), 1).alias("per_1000h_srpe"))


def class_imbalance(injury: DataFrame, participants: DataFrame, days: int) -> DataFrame:
    """Event days against the horizon per participant."""
    hurt = (injury.where(F.size("injuries") > 0).groupBy(PID, F.to_date("ts").alias("_d"))
            .agg(F.lit(1).alias("_one")).groupBy(PID).agg(F.count("*").alias("event_days")))
    out = participants.select(PID).join(hurt, PID, "left").fillna(0, subset=["event_days"])
    rest = F.lit(days) - F.col("event_days")
    ratio = F.when(F.col("event_days") == 0, "0 events").otherwise(
        F.concat(F.lit("1:"), F.floor(rest / F.nullif(F.col("event_days"), F.lit(0))).cast("string")))
    return out.select(PID, "event_days", F.lit(days).alias("horizon_days"), rest.alias("non_event_days"),
                      ratio.alias("imbalance_ratio"),
                      F.round(100 * F.col("event_days") / days, 2).alias("event_day_rate_pct"))


def label_summary(photos: DataFrame, label: str = "is_food", model: str = "model") -> DataFrame:
    """YES/NO/PENDING counts, labelling models and the non-food files."""
    verdict = F.col(label)
    counts = photos.groupBy(PID).agg(
        F.count("*").alias("n_images"), F.count_if(verdict == "YES").alias("n_yes"),
        F.count_if(verdict == "NO").alias("n_no"), F.count_if(verdict == "PENDING").alias("n_pending"))
    done = photos.where(verdict != "PENDING")
    models = (done.groupBy(PID, model).agg(F.count("*").alias("_n"))
              .withColumn("_t", F.concat(F.col(model), F.lit(":"), F.col("_n").cast("string"))))
    names = distinct_text(models, [PID], "_t", "; ", "models")
    rejected = distinct_text(done.where(verdict == "NO"), [PID], "file", "; ", "non_food_files")
    return counts.join(names, PID, "left").join(rejected, PID, "left")


