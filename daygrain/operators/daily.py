"""One row per participant and day from each typed source.

Each function aggregates by (participant_id, date) with map-side partial
aggregation; duplicate and per-minute folding happens on finer keys first, so
a participant or day with a large share of the rows is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.functions import cleaning as C, dates as D, encoding as E
from daygrain.operators.joins import KEYS, cache_hits
from daygrain.operators.runs import BURST_SECONDS, burst_groups, burst_representatives, burst_starts

SCORE_COLUMNS = ("overall_score", "composition_score", "revitalization_score", "duration_score",
                 "deep_sleep_in_minutes", "restlessness")
STAGES = ("deep", "light", "rem", "wake")


def _by_day(df: DataFrame, ts: str = "ts"):
    return df.groupBy("participant_id", F.to_date(ts).alias("date"))


def dedupe_minutes(minute: DataFrame, keys: Sequence[str] = ("participant_id", "metric", "ts"),
                   ordinal: str = "seq", value: str = "value") -> DataFrame:
    """First record of every time stamp, with the number of records it stood for.

    An aggregate instead of a ranking: copies fold map-side, however many.
    """
    return minute.groupBy(*keys).agg(F.min_by(value, ordinal).alias(value),
                                     F.count("*").alias("n_raw"))


def dedupe_counts_per_day(minute: DataFrame, metrics: Sequence[str] = ("steps", "distance"),
                          keys: Sequence[str] = ("participant_id", "metric", "ts")) -> DataFrame:
    """Duplicate minute rows per day, the named metrics added up."""
    folded = (minute.where(F.col("metric").isin(*metrics)).groupBy(*keys)
              .agg(F.count("*").alias("_n")))
    return _by_day(folded).agg(F.sum(F.col("_n") - 1).alias("n_deduped_min"))


def activity_daily(minute: DataFrame) -> DataFrame:
    """Daily totals of the deduplicated minute metrics and their coverage."""
    return _by_day(dedupe_minutes(minute)).agg(*activity_totals())


def activity_totals() -> list[Column]:
    """The aggregates of one day of deduplicated minutes."""
    value, metric = F.col("value"), F.col("metric")

    def of(name: str) -> Column:
        return F.when(metric == name, value)

    distance = F.coalesce(F.sum(of("distance")), F.lit(0.0))
    return [
        F.coalesce(F.sum(of("steps")), F.lit(0.0)).alias("total_steps"),
        F.coalesce(F.max(of("steps")), F.lit(0.0)).alias("peak_1min_steps"),
        F.count(of("steps")).cast("int").alias("steps_cov_min"),
        F.coalesce(F.sum(F.when(metric.isin("steps", "distance"), F.col("n_raw") - 1)), F.lit(0))
        .cast("int").alias("n_deduped_min"),
        distance.alias("total_distance_cm"), C.cm_to_m(distance).alias("total_distance_m"),
        F.coalesce(F.sum(of("calories")), F.lit(0.0)).alias("total_kcal")]


def exercise_daily(bouts: DataFrame, min_minutes: float = C.MIN_BOUT_MINUTES,
                   labels: Sequence[str] = E.ACTIVITY_LABELS) -> DataFrame:
    """Minutes, bouts and activity flags; artefact bouts count for nothing."""
    real = (bouts.withColumn("_min", C.bout_minutes("active_ms", "duration_ms"))
            .where(C.real_bout("_min", min_minutes)))
    name = F.lower(F.coalesce("activity_name", F.lit("")))
    flags = [F.max(F.contains(name, F.lit(a)).cast("int")).alias(f"ex_{a}") for a in labels]
    return _by_day(real, "start_ts").agg(
        F.round(C.total_minutes("active_ms", "duration_ms"), 1).alias("exercise_min"),
        F.count("*").cast("int").alias("n_exercise_sessions"), *flags)


def clean_hr(hr: DataFrame) -> DataFrame:
    """Trusted samples, clipped, with a mark on the samples clipping changed."""
    return (hr.where(C.trusted_sample("confidence"))
            .withColumn("clipped", C.out_of_hr_range("bpm").cast("int"))
            .withColumn("bpm", C.clip("bpm", *C.HR_RANGE)))


def confidence_summary(hr: DataFrame) -> DataFrame:
    """Dropped samples and mean confidence of the kept ones per participant."""
    kept = C.trusted_sample("confidence")
    return hr.groupBy("participant_id").agg(
        F.count_if(~kept).alias("n_dropped"),
        F.round(F.avg(F.when(kept, F.col("confidence"))), 3).alias("mean_conf"))


def clipped_per_day(hr: DataFrame, lo: int = C.HR_RANGE[0], hi: int = C.HR_RANGE[1]) -> DataFrame:
    """Samples outside the heart-rate range per day."""
    return _by_day(hr).agg(F.count_if(C.out_of_hr_range("bpm", lo, hi)).alias("n_clipped_hr"))


def hr_minutes(hr: DataFrame) -> DataFrame:
    """Per-minute sums of cleaned samples, the step that spreads a hot day."""
    known = hr.where(F.col("bpm").isNotNull())
    return known.groupBy("participant_id", D.minute("ts").alias("minute")).agg(
        F.count("*").alias("n"), F.sum("bpm").alias("s"), F.sum(F.col("bpm") * F.col("bpm")).alias("ss"),
        F.min("bpm").alias("lo"), F.max("bpm").alias("hi"),
        F.count("confidence").alias("n_conf"), F.sum("confidence").alias("s_conf"),
        F.sum("clipped").alias("clipped"))


def hr_daily(hr: DataFrame) -> DataFrame:
    """Daily heart-rate statistics of cleaned samples (see ``clean_hr``).

    The sd of a single sample is 0.
    """
    day = _by_day(hr_minutes(hr), "minute").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.sum("n_conf").alias("n_conf"), F.sum("s_conf").alias("s_conf"),
        F.sum("clipped").alias("clipped"), F.count("*").alias("minutes"))
    mean = F.col("s") / F.col("n")
    spread = F.greatest(F.col("ss") - F.col("n") * mean * mean, F.lit(0.0))
    sd = F.when((F.col("n") == 1) | (F.col("lo") == F.col("hi")), F.lit(0.0)).otherwise(
        F.sqrt(spread / F.nullif(F.col("n") - 1, F.lit(0))))
    return day.select(
        *KEYS, F.round(mean, 2).alias("hr_mean"), F.round(sd, 2).alias("hr_sd"), F.col("hi").alias("hr_peak"),
        F.col("n").cast("int").alias("hr_n_samples"),
        F.round(F.col("s_conf") / F.nullif(F.col("n_conf"), F.lit(0)), 3).alias("mean_conf"),
        F.col("minutes").cast("int").alias("hr_cov_min"), F.col("clipped").cast("int").alias("n_clipped_hr"))


def rhr_daily(rhr: DataFrame) -> DataFrame:
    """Cleaned resting heart rate, the last record of a day."""
    cleaned = rhr.withColumn("value", C.clean_rhr("value", "rhr_date"))
    return _by_day(cleaned).agg(F.max_by("value", "seq").alias("rhr_raw"))


def zones_daily(zones: DataFrame) -> DataFrame:
    """Zone minutes and training impulse; a missing zone of a known day is 0."""
    day = _by_day(zones).agg(F.max_by("zones", "seq").alias("zones"))

    def minutes(zone: str) -> Column:
        return F.coalesce(F.try_element_at("zones", F.lit(zone)), F.lit(0.0))

    return day.select(*KEYS, F.lit(1).alias("zones_available"),
                      *[minutes(z).alias(f"zone_min_{z}") for z in E.ZONE_KEYS],
                      E.trimp("zones").alias("trimp_edwards"),
                      minutes(E.HIGHEST_ZONE).alias("time_ge85_min"))


def stage_minutes(night: DataFrame) -> DataFrame:
    """Stage columns of a night; classic logs only know their awake minutes."""
    classic = F.coalesce(F.col("sleep_type") == "classic", F.lit(False))
    out = {f"{s}_min": F.when(~classic, F.col(f"{s}_min")) for s in ("deep", "light", "rem")}
    out["wake_min"] = F.when(classic, F.col("awake_min")).otherwise(F.col("wake_min"))
    return night.withColumns({**out, "is_classic": classic.cast("int")})


def stage_pct(night: DataFrame) -> DataFrame:
    """Stage shares in percent; NULL unless all four stages are known."""
    # NULL stages make the sum NULL.
    total = sum((F.col(f"{s}_min") for s in STAGES[1:]), F.col("deep_min"))
    total = F.when((total > 0) & (F.col("is_classic") == 0), total)
    return night.withColumns({f"{s}_pct": F.round(100 * F.col(f"{s}_min") / total, 2) for s in STAGES})


def main_night(sleep: DataFrame) -> DataFrame:
    """The longest main sleep ending on each day; naps are only counted."""
    record = F.struct(*[c for c in sleep.columns if c not in ("participant_id", "date")])
    order = F.struct(F.coalesce("asleep_min", F.lit(0.0)), F.col("seq"))
    main = F.col("main_sleep")
    picked = (sleep.where(F.col("end_ts").isNotNull())
              .where(F.datediff(F.to_date("end_ts"), F.to_date("start_ts")) <= 1))
    return _by_day(picked, "end_ts").agg(
        F.count_if(main).cast("int").alias("n_nights"), F.count_if(~main).cast("int").alias("n_naps"),
        F.max_by(F.when(main, record), F.when(main, order)).alias("night"))


def sleep_daily(sleep: DataFrame) -> DataFrame:
    """Features of the main night: duration, stages, timing, naps."""
    picked = main_night(sleep).select(*KEYS, "n_nights", "n_naps", "night.*")
    night = stage_pct(stage_minutes(picked))
    onset, offset = D.hour_of_day("start_ts"), D.hour_of_day("end_ts")
    return night.select(
        *KEYS, "n_nights", "n_naps", (F.col("n_nights") > 0).cast("int").alias("has_sleep_record"),
        F.when(F.col("n_nights") > 0, F.col("is_classic")).alias("is_classic"),
        "asleep_min", "time_in_bed_min", "efficiency_pct", *[f"{s}_min" for s in STAGES],
        *[f"{s}_pct" for s in STAGES], onset.alias("onset_hour"), offset.alias("offset_hour"),
        D.midsleep(onset, offset).alias("midsleep_hour"))


def sleep_scores_daily(scores: DataFrame, clip_restlessness: bool = True) -> DataFrame:
    """Mean of each score by the day of its time stamp."""
    def value(c: str) -> Column:
        bounded = clip_restlessness and c == "restlessness"
        return C.clip(c, *C.RESTLESSNESS_RANGE) if bounded else F.col(c)

    return _by_day(scores).agg(*[F.round(F.avg(value(c)), 2).alias(f"mean_{c}") for c in SCORE_COLUMNS])


def latest_row(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key."""
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row"))
            .select(*keys, "_row.*"))


def wellness_daily(wellness: DataFrame) -> DataFrame:
    """Rows, cleaned readiness and submission time of the last answer of a day."""
    cleaned = C.clean_readiness(wellness).withColumn("_hour", D.hour_of_day("ts"))
    day = _by_day(cleaned).agg(F.count("*").cast("int").alias("n_wellness_rows"),
                               F.max_by("readiness_clean", "seq").alias("readiness_same_day"),
                               F.max_by("_hour", "seq").alias("submission_hour"))
    late = (F.col("submission_hour") >= C.LATE_SUBMISSION_HOUR).cast("int")
    return day.withColumn("delayed_flag_ge12", late)


def srpe_daily(srpe: DataFrame, labels: Sequence[str] = E.ACTIVITY_LABELS) -> DataFrame:
    """Sessions, load and activity flags of a day with sessions.

    The load is NULL when no session has both exertion and duration; days
    without sessions are not here and become 0 on the spine.
    """
    flags = [F.max(E.activity_flag("activity_names", a)).alias(f"sr_{a}") for a in labels]
    return _by_day(srpe).agg(
        F.count("*").cast("int").alias("srpe_n_sessions"),
        F.round(F.sum(F.col("rpe") * F.col("duration_min")), 1).alias("srpe_load"),
        F.round(F.avg("rpe"), 2).alias("mean_rpe"),
        F.coalesce(F.sum("duration_min"), F.lit(0)).cast("int").alias("srpe_minutes"), *flags)


def injury_daily(injury: DataFrame) -> DataFrame:
    """Reports of a day and whether any of them names an injury."""
    return _by_day(injury).agg(
        F.max((F.size("injuries") > 0).cast("int")).alias("is_injured_day"),
        F.count("*").cast("int").alias("n_injury_reports"))


def injury_state(injury: DataFrame) -> DataFrame:
    """Severity per day and location; the last report of a day decides."""
    return (injury.select("participant_id", F.to_date("ts").alias("date"), "seq",
                          F.explode("injuries").alias("loc", "sev"))
            .groupBy(*KEYS, "loc").agg(F.max_by("sev", "seq").alias("sev")))


def injury_onehots(injury: DataFrame, names: Sequence[str]) -> DataFrame:
    """One 0/1 column per ``inj_<location>__<severity>`` name and day."""
    flag = E.onehot_name("loc", "sev")
    return injury_state(injury).groupBy(*KEYS).agg(
        *[F.max((flag == n).cast("int")).alias(n) for n in names] or [F.count("*").alias("n_locations")])


def last_non_null(df: DataFrame, keys: Sequence[str], col: str, order: str) -> DataFrame:
    """The last known value of each key."""
    known = F.when(F.col(col).isNotNull(), F.col(order))
    return df.groupBy(*keys).agg(F.max_by(col, known).alias(col))


def reporting_daily(reporting: DataFrame) -> DataFrame:
    """Self report of a day: weight, fluids, alcohol, meals, recall lag."""
    known_weight = F.when(F.col("weight").isNotNull(), F.col("seq"))
    return _by_day(reporting).agg(
        F.count("*").cast("int").alias("n_reporting_rows"),
        F.max_by("weight", known_weight).alias("weight_raw"),
        F.sum(F.coalesce("glasses_of_fluid", F.lit(0.0))).alias("fluids_glasses"),
        F.max(E.yes_no("alcohol_consumed")).alias("alcohol_bin"),
        F.sum(F.size(E.split_set("meals"))).cast("int").alias("n_meals_logged"),
        F.round(F.avg(D.lag_days("ts", "submitted_ts")), 2).alias("lag_days"))


def photo_counts(photos: DataFrame, seconds: float = BURST_SECONDS) -> DataFrame:
    """Photos, food photos and meal bursts per day; bursts end at midnight."""
    stamped = photos.withColumn("date", F.to_date("ts"))
    all_shots = stamped.groupBy(*KEYS).agg(
        F.count("*").cast("int").alias("n_photos"),
        F.count_if(F.col("is_food") == "YES").cast("int").alias("n_food_photos"))
    bursts = (burst_starts(stamped.where(F.col("is_food") == "YES"), KEYS, "ts", "file", seconds)
              .groupBy(*KEYS).agg(F.sum("is_start").cast("int").alias("n_photo_meals")))
    return (all_shots.join(bursts, KEYS, "left").fillna(0, subset=["n_photo_meals"])
            .withColumn("has_nutrition", (F.col("n_food_photos") > 0).cast("int")))


def photo_meals(photos: DataFrame, seconds: float = BURST_SECONDS) -> DataFrame:
    """Food bursts of each day with their first photo."""
    food = photos.where(F.col("is_food") == "YES").withColumn("date", F.to_date("ts"))
    return burst_representatives(burst_groups(food, KEYS, "ts", "file", seconds), KEYS, "ts", "file")


def day_estimate_keys(meals: DataFrame) -> DataFrame:
    """Cache key of each food day.

    Bursts of a day lie more than the burst gap apart, so a day lists at most
    86400 / gap names.
    """
    return (meals.groupBy(*KEYS).agg(F.collect_list("representative").alias("_files"))
            .select(*KEYS, E.estimate_key("participant_id", "date", "_files").alias("cache_key")))


def attach_macros(day_keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Macro estimates of the food days whose cached payload is valid."""
    payload = cache.select("cache_key", F.struct(*C.MACRO_KEYS).alias("macros"))
    hits = cache_hits(day_keys, payload, "cache_key", "macros")
    names = dict(zip(C.MACRO_KEYS, ("estimated_kcal", "protein_g", "carbs_g", "fat_g")))
    return hits.select(*KEYS, *[F.col(f"macros.{k}").alias(n) for k, n in names.items()],
                       F.lit(1).alias("nutrition_kcal_available"))


def sum_map(df: DataFrame, keys: Sequence[str], map_col: str) -> DataFrame:
    """Add up maps key by key (NULL counts 0); long form: one row per map key."""
    return (df.select(*keys, F.explode(map_col).alias("zone", "_v"))
            .groupBy(*keys, "zone").agg(F.sum(F.coalesce("_v", F.lit(0.0))).alias("minutes")))


def exposure_hours(srpe: DataFrame, bouts: DataFrame) -> DataFrame:
    """Logged training minutes and recorded exercise minutes per participant."""
    a = srpe.groupBy("participant_id").agg(F.coalesce(F.sum("duration_min"), F.lit(0.0)).alias("srpe_min"))
    b = bouts.groupBy("participant_id").agg(
        C.total_minutes("active_ms", "duration_ms").alias("exercise_min"))
    both = a.join(b, "participant_id", "full").fillna(0.0, subset=["srpe_min", "exercise_min"])
    return both.withColumn("total_h", (F.col("srpe_min") + F.col("exercise_min")) / 60)


def presence_counts(df: DataFrame, spine: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    """Rows of a source on every day of the spine, 0 where there are none."""
    counts = _by_day(df, ts).agg(F.count("*").cast("int").alias(name))
    return spine.join(counts, KEYS, "left").fillna(0, subset=[name])
