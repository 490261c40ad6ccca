"""Daily and window aggregates of every source."""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.joins import WINDOWS_SQL, in_window_sql, windows
from catalog.registry import ORACLE_SQL, query
from daygrain.functions import encoding as E
from daygrain.operators import daily, windowed as W
from daygrain.plans import report as R

rnd = B.rnd
KEYS = ["participant_id", "date"]
BOUT = "coalesce(active_ms, duration_ms, 0)"


def per_window(source: str, ts: str = "s.ts") -> str:
    return ("FROM windows w LEFT JOIN " + source + " s ON s.participant_id = w.participant_id AND "
            + in_window_sql(ts) + " GROUP BY w.participant_id, w.window_id")


def windowed(select: str, source: str, ts: str = "s.ts") -> str:
    """One row per window with at least one row of the source."""
    return B.with_views(WINDOWS_SQL + f"""
        SELECT w.participant_id, w.window_id, {select} FROM windows w JOIN {source} s
        ON s.participant_id = w.participant_id AND {in_window_sql(ts)} GROUP BY w.participant_id, w.window_id""",
                        "people", source)


@query("activity_by_window", B.with_views(WINDOWS_SQL + """
    SELECT w.participant_id, w.window_id, coalesce(sum(value) FILTER (metric = 'steps'), 0) AS total_steps,
        coalesce(max(value) FILTER (metric = 'steps'), 0) AS peak_1min_steps,
        coalesce(sum(value) FILTER (metric = 'distance'), 0) AS total_distance,
        coalesce(sum(value) FILTER (metric = 'calories'), 0) AS total_calories_burned """
    + per_window("minute"), "people", "minute"))
def activity_by_window(spark, sf_dir):
    return W.activity_window(B.minute(spark, sf_dir), windows(spark, sf_dir)).drop("total_distance_display")


@query("activity_by_day", B.with_views(f"""
    one AS (SELECT participant_id, metric, ts, d, arg_min(value, seq) AS value, count(*) AS n FROM minute GROUP BY 1, 2, 3, 4)
    SELECT participant_id, d AS date, coalesce(sum(value) FILTER (metric = 'steps'), 0) AS total_steps,
        coalesce(max(value) FILTER (metric = 'steps'), 0) AS peak_1min_steps,
        CAST(count(*) FILTER (metric = 'steps') AS INTEGER) AS steps_cov_min,
        CAST(coalesce(sum(n - 1) FILTER (metric IN ('steps', 'distance')), 0) AS INTEGER) AS n_deduped_min,
        coalesce(sum(value) FILTER (metric = 'distance'), 0) AS total_distance_cm,
        {rnd("(coalesce(sum(value) FILTER (metric = 'distance'), 0) / 100)", 2)} AS total_distance_m,
        coalesce(sum(value) FILTER (metric = 'calories'), 0) AS total_kcal FROM one GROUP BY 1, 2""", "minute"))
def activity_by_day(spark, sf_dir):
    return daily.activity_daily(B.minute(spark, sf_dir))


@query("exercise_by_window", B.with_views(WINDOWS_SQL + f"""
    SELECT w.participant_id, w.window_id, count(log_id) AS n_exercise_sessions,
        coalesce({rnd(f"(sum({BOUT}) / 60000.0::DOUBLE)", 1)}, 0) AS exercise_minutes,
        coalesce(string_agg(DISTINCT activity_name, ',' ORDER BY activity_name), '') AS activities
    FROM windows w LEFT JOIN exercise s ON s.participant_id = w.participant_id AND {in_window_sql('s.start_ts')}
    GROUP BY 1, 2""", "people", "exercise"))
def exercise_by_window(spark, sf_dir):
    out = W.exercise_window(B.exercise(spark, sf_dir), windows(spark, sf_dir))
    n = F.col("n_exercise_sessions") > 0
    return out.withColumns({"activities": F.array_join("activities", ","),
                            "exercise_minutes": F.when(n, F.col("exercise_minutes")).otherwise(0.0)})


@query("exercise_by_day", B.with_views(f"""
    real AS (SELECT * FROM exercise WHERE {BOUT} / 60000.0::DOUBLE > 0.03)
    SELECT participant_id, d AS date, {rnd(f"(sum({BOUT}) / 60000.0::DOUBLE)", 1)} AS exercise_min,
        CAST(count(*) AS INTEGER) AS n_exercise_sessions, {", ".join(
            f"max(contains(lower(activity_name), '{a}')::INTEGER) AS ex_{a}" for a in E.ACTIVITY_LABELS)}
    FROM real GROUP BY 1, 2""", "exercise"))
def exercise_by_day(spark, sf_dir):
    return daily.exercise_daily(B.exercise(spark, sf_dir))


@query("mean_resting_hr", windowed(f"{rnd('avg(value) FILTER (value > 0)', 2)} AS resting_hr_bpm", "rhr"))
def mean_resting_hr(spark, sf_dir):
    return W.mean_rhr(B.rhr(spark, sf_dir), windows(spark, sf_dir))


ZONE_SUMS = ", ".join(f"coalesce(sum(z{i}), 0) AS z{i}" for i in range(4))


@query("zone_minutes_by_window", windowed(ZONE_SUMS, "zones"))
def zone_minutes_by_window(spark, sf_dir):
    out = W.zones_window(B.zones(spark, sf_dir), windows(spark, sf_dir))
    return out.select(*W.WINDOW, *[F.coalesce(F.try_element_at("hr_zones_min", F.lit(z)), F.lit(0.0)).alias(f"z{i}")
                                   for i, z in enumerate(E.ZONE_KEYS)])


@query("sum_map_by_key", B.with_views("""
    SELECT participant_id, zone, sum(minutes) AS minutes FROM (
        SELECT participant_id, unnest(['BELOW_DEFAULT_ZONE_1', 'IN_DEFAULT_ZONE_1', 'IN_DEFAULT_ZONE_2', 'IN_DEFAULT_ZONE_3'])
            AS zone, unnest([z0, z1, z2, z3]) AS minutes FROM zones) WHERE minutes IS NOT NULL GROUP BY 1, 2""", "zones"))
def sum_map_by_key(spark, sf_dir):
    return daily.sum_map(B.zones(spark, sf_dir), ["participant_id"], "zones")


@query("edwards_trimp", B.with_views("""
    SELECT seq, z0 + 2 * z1 + 3 * coalesce(z2, 0) + 4 * coalesce(z3, 0) AS trimp FROM zones""", "zones"))
def edwards_trimp(spark, sf_dir):
    return B.zones(spark, sf_dir).select("seq", E.trimp("zones").alias("trimp"))


@query("zones_by_day", B.with_views("""
    last AS (SELECT participant_id, d AS date, max(seq) AS seq FROM zones GROUP BY 1, 2)
    SELECT participant_id, date, 1 AS zones_available, z0 AS zone_min_BELOW_DEFAULT_ZONE_1,
        z1 AS zone_min_IN_DEFAULT_ZONE_1, coalesce(z2, 0) AS zone_min_IN_DEFAULT_ZONE_2,
        coalesce(z3, 0) AS zone_min_IN_DEFAULT_ZONE_3, coalesce(z3, 0) AS time_ge85_min,
        z0 + 2 * z1 + 3 * coalesce(z2, 0) + 4 * coalesce(z3, 0) AS trimp_edwards
    FROM last JOIN zones USING (participant_id, seq)""", "zones"))
def zones_by_day(spark, sf_dir):
    return daily.zones_daily(B.zones(spark, sf_dir))


@query("heart_rate_by_day", B.with_views(f"""
    c AS (SELECT participant_id, d, ts, greatest(least(bpm, 220), 30) AS b, confidence, (bpm < 30 OR bpm > 220) AS cl FROM hr
          WHERE confidence IS DISTINCT FROM 0)
    SELECT participant_id, d AS date, {rnd('avg(b)', 2)} AS hr_mean,
        CASE WHEN count(*) = 1 THEN 0 ELSE {rnd('stddev_samp(b)', 2)} END AS hr_sd, max(b) AS hr_peak,
        CAST(count(*) AS INTEGER) AS hr_n_samples, {rnd('avg(confidence)', 3)} AS mean_conf,
        CAST(count(DISTINCT date_trunc('minute', ts)) AS INTEGER) AS hr_cov_min,
        CAST(count(*) FILTER (cl) AS INTEGER) AS n_clipped_hr FROM c GROUP BY 1, 2""", "hr"))
def heart_rate_by_day(spark, sf_dir):
    return daily.hr_daily(daily.clean_hr(B.hr(spark, sf_dir)))


@query("resting_hr_by_day", B.with_views("""
    SELECT participant_id, d AS date, arg_max_null(CASE WHEN rhr_date IS NOT NULL AND value > 0 THEN value END, seq) AS rhr_raw
    FROM rhr GROUP BY 1, 2""", "rhr"))
def resting_hr_by_day(spark, sf_dir):
    return daily.rhr_daily(B.rhr(spark, sf_dir))


NIGHT_SQL = "date_of_sleep, asleep_min, time_in_bed_min, efficiency_pct, deep_min, light_min, rem_min, wake_min"


@query("nights_of_windows", B.with_views(WINDOWS_SQL + f"""
    SELECT w.participant_id, w.window_id, position, n_nights, {NIGHT_SQL} FROM (
        SELECT w.participant_id, w.window_id, {NIGHT_SQL}, s.seq,
            row_number() OVER (PARTITION BY w.participant_id, w.window_id ORDER BY seq) - 1 AS position,
            count(*) OVER (PARTITION BY w.participant_id, w.window_id) AS n_nights
        FROM windows w JOIN sleep s ON s.participant_id = w.participant_id AND {in_window_sql('s.end_ts')}
            AND s.start_ts >= CAST(w.lower AS DATE) - INTERVAL 1 DAY) w""", "people", "sleep"))
def nights_of_windows(spark, sf_dir):
    out = W.nights_array(B.sleep(spark, sf_dir), windows(spark, sf_dir))
    return out.select(*W.WINDOW, "n_nights", F.posexplode("nights").alias("position", "night")).select(
        *W.WINDOW, "n_nights", F.col("position").cast("long").alias("position"), "night.*")


MAIN_NIGHT = """main AS (SELECT participant_id, d AS date, count(*) FILTER (main_sleep) AS n_nights,
        count(*) FILTER (NOT main_sleep) AS n_naps FROM sleep GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY participant_id, d
        ORDER BY coalesce(asleep_min, 0) DESC, seq DESC) AS r FROM sleep WHERE main_sleep),
    night AS (SELECT m.participant_id, m.date, m.n_nights, m.n_naps, r.* EXCLUDE (participant_id) FROM main m
        LEFT JOIN ranked r ON r.participant_id = m.participant_id AND r.d = m.date AND r.r = 1)"""


@query("main_night_pick", B.with_views(MAIN_NIGHT + """
    SELECT participant_id, date, CAST(n_nights AS INTEGER) AS n_nights, CAST(n_naps AS INTEGER) AS n_naps, log_id, asleep_min
    FROM night""", "sleep"))
def main_night_pick(spark, sf_dir):
    out = daily.main_night(B.sleep(spark, sf_dir))
    return out.select(*KEYS, "n_nights", "n_naps", "night.log_id", "night.asleep_min")


@query("stage_minutes_and_shares", B.with_views(f"""
    s AS (SELECT log_id, (sleep_type = 'classic')::INTEGER AS is_classic, CASE WHEN sleep_type <> 'classic' THEN deep_min END AS deep_min,
        CASE WHEN sleep_type <> 'classic' THEN light_min END AS light_min,
        CASE WHEN sleep_type <> 'classic' THEN rem_min END AS rem_min,
        CASE WHEN sleep_type = 'classic' THEN awake_min ELSE wake_min END AS wake_min FROM sleep),
    t AS (SELECT *, CASE WHEN is_classic = 0 AND deep_min + light_min + rem_min + wake_min > 0
        THEN deep_min + light_min + rem_min + wake_min END AS total FROM s)
    SELECT log_id, is_classic, deep_min, light_min, rem_min, wake_min, {", ".join(
        f"{rnd(f'(100 * {x}_min / total)', 2)} AS {x}_pct" for x in ("deep", "light", "rem", "wake"))} FROM t""", "sleep"))
def stage_minutes_and_shares(spark, sf_dir):
    out = daily.stage_pct(daily.stage_minutes(B.sleep(spark, sf_dir)))
    return out.select("log_id", "is_classic", *[f"{s}_min" for s in daily.STAGES], *[f"{s}_pct" for s in daily.STAGES])


@query("sleep_by_day", B.with_views(MAIN_NIGHT + """
    SELECT participant_id, date, CAST(n_nights AS INTEGER) AS n_nights, CAST(n_naps AS INTEGER) AS n_naps,
        (n_nights > 0)::INTEGER AS has_sleep_record, CASE WHEN n_nights > 0 THEN (sleep_type = 'classic')::INTEGER END AS is_classic,
        asleep_min, time_in_bed_min, CASE WHEN sleep_type <> 'classic' THEN rem_min END AS rem_min,
        CASE WHEN sleep_type = 'classic' THEN awake_min ELSE wake_min END AS wake_min FROM night""", "sleep"))
def sleep_by_day(spark, sf_dir):
    return daily.sleep_daily(B.sleep(spark, sf_dir)).select(
        *KEYS, "n_nights", "n_naps", "has_sleep_record", "is_classic", "asleep_min", "time_in_bed_min", "rem_min", "wake_min")


SCORE_SQL = ", ".join(f"{rnd(f'avg({c})', 2)} AS mean_{c}" for c in daily.SCORE_COLUMNS[:-1])


@query("sleep_scores_by_day", B.with_views(f"""
    SELECT participant_id, d AS date, {SCORE_SQL},
        {rnd('avg(greatest(least(restlessness, 0.2::DOUBLE), 0.03::DOUBLE))', 2)} AS mean_restlessness
    FROM sleep_score GROUP BY 1, 2""", "sleep_score"))
def sleep_scores_by_day(spark, sf_dir):
    return daily.sleep_scores_daily(B.sleep_score(spark, sf_dir))


@query("sleep_scores_by_window", windowed(SCORE_SQL + f", {rnd('avg(restlessness)', 2)} AS mean_restlessness", "sleep_score"))
def sleep_scores_by_window(spark, sf_dir):
    return W.scores_window(B.sleep_score(spark, sf_dir), windows(spark, sf_dir))


@query("latest_wellness_by_window", windowed("""count(*) AS n_wellness_rows, arg_max(fatigue, seq) AS fatigue,
    arg_max(mood, seq) AS mood, arg_max(readiness, seq) AS readiness, arg_max(soreness_area, seq) AS soreness_area""", "wellness"))
def latest_wellness_by_window(spark, sf_dir):
    out = W.wellness_window(B.wellness(spark, sf_dir), windows(spark, sf_dir))
    return out.select(*W.WINDOW, "n_wellness_rows", *[f"latest_wellness.{c}" for c in ("fatigue", "mood", "readiness", "soreness_area")])


@query("latest_row_per_day", B.with_views("""
    SELECT participant_id, date, seq, mood, readiness FROM (SELECT participant_id, d AS date, seq, mood, readiness,
        row_number() OVER (PARTITION BY participant_id, d ORDER BY seq DESC) AS r FROM wellness) WHERE r = 1""", "wellness"))
def latest_row_per_day(spark, sf_dir):
    w = B.wellness(spark, sf_dir).withColumn("date", F.to_date("ts"))
    return daily.latest_row(w, KEYS, "seq", ["seq", "mood", "readiness"])


@query("submission_timing", B.with_views(f"""
    last AS (SELECT participant_id, d AS date, count(*) AS n, max(seq) AS seq FROM wellness GROUP BY 1, 2),
    h AS (SELECT l.*, readiness, {rnd("(hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE)", 2)} AS hh
          FROM last l JOIN wellness w ON w.seq = l.seq)
    SELECT participant_id, date, CAST(n AS INTEGER) AS n_wellness_rows, CASE WHEN readiness BETWEEN 1 AND 10 THEN readiness END
        AS readiness_same_day, hh AS submission_hour, (hh >= 12)::INTEGER AS delayed_flag_ge12 FROM h""", "wellness"))
def submission_timing(spark, sf_dir):
    return daily.wellness_daily(B.wellness(spark, sf_dir))


@query("training_load_by_window", windowed(f"""count(*) AS n_srpe_sessions, {rnd('avg(rpe)', 2)} AS mean_rpe,
    CAST(sum(coalesce(duration_min, 0)) AS INTEGER) AS srpe_total_duration_min,
    sum(coalesce(rpe, 0) * coalesce(duration_min, 0)) AS training_load""", "srpe"))
def training_load_by_window(spark, sf_dir):
    return W.srpe_window(B.srpe(spark, sf_dir), windows(spark, sf_dir))


@query("training_load_three_state", B.with_views(f"""
    s AS (SELECT participant_id, d AS date, count(*) AS n, sum(rpe * duration_min) AS load, {rnd('avg(rpe)', 2)} AS mean_rpe,
        sum(duration_min) AS minutes FROM srpe GROUP BY 1, 2)
    SELECT participant_id, date, CAST(coalesce(n, 0) AS INTEGER) AS srpe_n_sessions,
        CASE WHEN n IS NULL THEN 0 ELSE load END AS srpe_load, mean_rpe, CAST(coalesce(minutes, 0) AS INTEGER) AS srpe_minutes
    FROM spine LEFT JOIN s USING (participant_id, date)""", "spine", "srpe"))
def training_load_three_state(spark, sf_dir):
    day = daily.srpe_daily(B.srpe(spark, sf_dir)).select(*KEYS, "srpe_n_sessions", "srpe_load", "mean_rpe", "srpe_minutes")
    out = B.spine(spark, sf_dir).join(day, KEYS, "left")
    none = F.col("srpe_n_sessions").isNull()
    return out.withColumn("srpe_load", F.when(none, 0.0).otherwise(F.col("srpe_load"))).fillna(
        0, subset=["srpe_n_sessions", "srpe_minutes"])


@query("reporting_by_window", windowed("""count(*) AS n_reporting_rows,
    arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight_kg,
    sum(coalesce(glasses_of_fluid, 0)) AS total_glasses_of_fluid,
    bool_or(lower(alcohol_consumed) = 'yes') AS alcohol_consumed,
    CAST(sum(CASE meals WHEN 'Breakfast, Lunch' THEN 2 WHEN 'Dinner' THEN 1 WHEN 'Lunch,, Lunch ' THEN 2 ELSE 0 END) AS BIGINT)
        AS n_meals_logged,
    concat_ws(',', max(CASE WHEN meals = 'Breakfast, Lunch' THEN 'Breakfast' END), max(CASE WHEN meals = 'Dinner' THEN 'Dinner' END),
        max(CASE WHEN meals LIKE '%Lunch%' THEN 'Lunch' END)) AS meal_names""", "reporting"))
def reporting_by_window(spark, sf_dir):
    out = W.reporting_window(B.reporting(spark, sf_dir), windows(spark, sf_dir))
    return out.withColumn("meal_names", F.coalesce(F.array_join("meal_names", ","), F.lit("")))


@query("reporting_by_day", B.with_views(f"""
    SELECT participant_id, d AS date, CAST(count(*) AS INTEGER) AS n_reporting_rows,
        arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight_raw, sum(coalesce(glasses_of_fluid, 0)) AS fluids_glasses,
        max(CASE lower(trim(alcohol_consumed)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) AS alcohol_bin,
        CAST(sum(CASE meals WHEN 'Breakfast, Lunch' THEN 2 WHEN 'Dinner' THEN 1 WHEN 'Lunch,, Lunch ' THEN 2 ELSE 0 END) AS INTEGER)
            AS n_meals_logged,
        {rnd("avg(" + rnd("((epoch_us(submitted_ts) - epoch_us(ts)) / 1e6::DOUBLE / 86400.0::DOUBLE)", 2) + ")", 2)} AS lag_days
    FROM reporting GROUP BY 1, 2""", "reporting"))
def reporting_by_day(spark, sf_dir):
    return daily.reporting_daily(B.reporting(spark, sf_dir))


@query("last_non_null_weight", B.with_views("""
    SELECT participant_id, arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight FROM reporting GROUP BY 1""", "reporting"))
def last_non_null_weight(spark, sf_dir):
    return daily.last_non_null(B.reporting(spark, sf_dir), ["participant_id"], "weight", "seq")


@query("injury_by_window", B.with_views(WINDOWS_SQL + f""",
    r AS (SELECT w.participant_id, w.window_id, count(*) AS n, bool_or(foot IS NOT NULL) AS hurt,
        count(*) FILTER (foot IS NOT NULL) AS n_named FROM windows w JOIN injury s ON s.participant_id = w.participant_id
        AND {in_window_sql('s.ts')} GROUP BY 1, 2)
    SELECT participant_id, window_id, coalesce(n, 0) AS reports_in_window, coalesce(hurt, false) AS is_injured,
        coalesce(n > 0, false) AS has_report_in_window, CAST(coalesce(n_named, 0) AS INTEGER) AS n_named
    FROM windows LEFT JOIN r USING (participant_id, window_id)""", "people", "injury"))
def injury_by_window(spark, sf_dir):
    out = W.injury_window(B.injury(spark, sf_dir), windows(spark, sf_dir))
    return out.select(*W.WINDOW, "reports_in_window", "is_injured", "has_report_in_window",
                      F.coalesce(F.size("injuries"), F.lit(0)).alias("n_named"))


@query("injury_by_day", B.with_views("""
    SELECT participant_id, d AS date, max((foot IS NOT NULL)::INTEGER) AS is_injured_day,
        CAST(count(*) AS INTEGER) AS n_injury_reports FROM injury GROUP BY 1, 2""", "injury"))
def injury_by_day(spark, sf_dir):
    return daily.injury_daily(B.injury(spark, sf_dir))


@query("nutrition_totals", f"""
    SELECT l_orderkey, count(*) AS meals_from_photos, {rnd('sum(l_quantity)', 1)} AS estimated_calories_kcal,
        {rnd('sum(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END)', 1)} AS lines_sum FROM lineitem GROUP BY 1""")
def nutrition_totals(spark, sf_dir):
    meals = B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("calories"),
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("protein"),
        F.lit(0.0).alias("carbohydrates"), F.lit(None).cast("double").alias("fats"))
    out = W.nutrition_totals(meals, ["l_orderkey"])
    other = F.when(F.col("estimated_protein_g") == 0, None).otherwise(F.col("estimated_protein_g"))
    return out.select("l_orderkey", "meals_from_photos", "estimated_calories_kcal", other.alias("lines_sum"))


BURSTS = """food AS (SELECT *, ts - lag(ts) OVER (PARTITION BY participant_id, d ORDER BY ts, file) AS gap FROM photos WHERE is_food = 'YES'),
    starts AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY participant_id, d ORDER BY ts, file) AS burst FROM food)"""


@query("photo_counts_by_day", B.with_views(BURSTS + """
    SELECT p.participant_id, p.d AS date, CAST(count(*) AS INTEGER) AS n_photos,
        CAST(count(*) FILTER (is_food = 'YES') AS INTEGER) AS n_food_photos,
        CAST(coalesce(max(b.n), 0) AS INTEGER) AS n_photo_meals, max((is_food = 'YES')::INTEGER) AS has_nutrition
    FROM photos p LEFT JOIN (SELECT participant_id, d, max(burst) AS n FROM starts GROUP BY 1, 2) b
    ON b.participant_id = p.participant_id AND b.d = p.d GROUP BY 1, 2""", "photos"))
def photo_counts_by_day(spark, sf_dir):
    return daily.photo_counts(B.photos(spark, sf_dir), seconds=7200)


MACRO_KEYS_SQL = BURSTS + """, reps AS (SELECT participant_id, d, burst, arg_min(file, (ts, file)) AS rep FROM starts GROUP BY 1, 2, 3),
    keys AS (SELECT participant_id, d AS date, participant_id || '|' || d || '|' || string_agg(rep, ',' ORDER BY rep) AS cache_key
             FROM reps GROUP BY participant_id, d)"""


@query("day_estimate_keys", B.with_views(MACRO_KEYS_SQL + " SELECT participant_id, date, cache_key FROM keys", "photos"))
def day_estimate_keys(spark, sf_dir):
    return daily.day_estimate_keys(daily.photo_meals(B.photos(spark, sf_dir), seconds=7200))


@query("attach_macro_estimates", B.with_views(MACRO_KEYS_SQL + """
    SELECT participant_id, date, CAST(length(cache_key) AS DOUBLE) AS estimated_kcal, CAST(day(date) AS DOUBLE) AS protein_g,
        2.0::DOUBLE AS carbs_g, 3.0::DOUBLE AS fat_g, 1 AS nutrition_kcal_available FROM keys WHERE day(date) <> 13""", "photos"))
def attach_macro_estimates(spark, sf_dir):
    keys = daily.day_estimate_keys(daily.photo_meals(B.photos(spark, sf_dir), seconds=7200))
    spoiled = F.when(F.dayofmonth("date") == 13, F.lit(-1.0)).otherwise(F.dayofmonth("date").cast("double"))
    cache = keys.select("cache_key", F.length("cache_key").cast("double").alias("calories"), spoiled.alias("protein"),
                        F.lit(2.0).alias("carbohydrates"), F.lit(3.0).alias("fats"))
    return daily.attach_macros(keys, cache)


@query("presence_counts", B.with_views("""
    w AS (SELECT participant_id, d AS date, count(*) AS n FROM wellness GROUP BY 1, 2)
    SELECT participant_id, date, CAST(coalesce(n, 0) AS INTEGER) AS n_wellness_rows FROM spine
    LEFT JOIN w USING (participant_id, date)""", "spine", "wellness"))
def presence_counts(spark, sf_dir):
    return daily.presence_counts(B.wellness(spark, sf_dir), B.spine(spark, sf_dir), "n_wellness_rows")


def report(spark, sf_dir):
    return R.window_report(B.sources(spark, sf_dir), windows(spark, sf_dir))


@query("window_report", B.with_views(WINDOWS_SQL + f""",
    a AS (SELECT w.participant_id, w.window_id, coalesce(sum(value) FILTER (metric = 'steps'), 0) AS total_steps {per_window('minute')}),
    b AS (SELECT w.participant_id, w.window_id, count(log_id) AS n_nights FROM windows w LEFT JOIN sleep s
          ON s.participant_id = w.participant_id AND {in_window_sql('s.end_ts')}
          AND s.start_ts >= CAST(w.lower AS DATE) - INTERVAL 1 DAY GROUP BY 1, 2),
    c AS (SELECT w.participant_id, w.window_id, coalesce(sum(coalesce(rpe, 0) * coalesce(duration_min, 0)), 0) AS training_load
          {per_window('srpe')}),
    e AS (SELECT w.participant_id, w.window_id, count(s.seq) AS reports_in_window {per_window('injury')}),
    f AS (SELECT w.participant_id, w.window_id, count(s.seq) AS n_food_photos {per_window('photos')})
    SELECT participant_id, window_id, CAST(lower AS DATE) AS start_date, CAST(upper AS DATE) AS end_date, total_steps, n_nights,
        training_load, reports_in_window, n_food_photos
    FROM windows JOIN a USING (participant_id, window_id) JOIN b USING (participant_id, window_id)
    JOIN c USING (participant_id, window_id) JOIN e USING (participant_id, window_id) JOIN f USING (participant_id, window_id)""",
    "people", "minute", "sleep", "srpe", "injury", "photos", split=True))
def window_report(spark, sf_dir):
    return report(spark, sf_dir).select(
        *W.WINDOW, "start_date", "end_date", "activity.total_steps", "sleep.n_nights", "questionnaire.training_load",
        "injury.reports_in_window", "nutrition.n_food_photos")


# The whole record: the twins of its parts side by side, lists and maps as text.
RECORD_TWINS = ("activity_by_window", "exercise_by_window", "mean_resting_hr", "zone_minutes_by_window", "sleep_scores_by_window",
                "latest_wellness_by_window", "training_load_by_window", "reporting_by_window", "injury_by_window", "last_known_injury")
NIGHT_NUMBERS = ("asleep_min", "time_in_bed_min", "efficiency_pct", "deep_min", "light_min", "rem_min", "wake_min")
ZERO_IN_RECORD = ("n_wellness_rows", "n_srpe_sessions", "srpe_total_duration_min", "training_load", "n_reporting_rows", "n_meals_logged")


def record_sql() -> str:
    parts = ", ".join(f"r{i} AS ({B.split_twin(ORACLE_SQL[name])})" for i, name in enumerate(RECORD_TWINS))
    joins = " ".join(f"LEFT JOIN {t} USING (participant_id, window_id)" for t in (*[f"r{i}" for i in range(len(RECORD_TWINS))], "nn", "pp", "ii"))
    numbers = " || '/' || ".join(f"coalesce(CAST(CAST({c} AS BIGINT) AS VARCHAR), '-')" for c in NIGHT_NUMBERS)
    zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*ZERO_IN_RECORD, "z0", "z1", "z2", "z3"))
    return B.with_views(WINDOWS_SQL + f""", {parts},
    nn AS (SELECT participant_id, window_id, count(*) AS nights, string_agg(date_of_sleep || '/' || {numbers}, ';' ORDER BY position) AS night_list
        FROM ({B.split_twin(ORACLE_SQL["nights_of_windows"])}) GROUP BY 1, 2),
    pp AS (SELECT w.participant_id, w.window_id, count(*) AS photos, string_agg(DISTINCT file, ',' ORDER BY file) AS photo_files
        FROM windows w JOIN photos s ON s.participant_id = w.participant_id AND {in_window_sql('s.ts')} GROUP BY 1, 2),
    ii AS (SELECT w.participant_id, w.window_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '=' || foot || '/' || coalesce(head, ''), ';'
        ORDER BY ts) AS injuries FROM windows w JOIN injury s ON s.participant_id = w.participant_id AND {in_window_sql('s.ts')}
        WHERE foot IS NOT NULL GROUP BY 1, 2)
    SELECT * EXCLUDE (lower, upper, inclusive, n_named, nights, photos, meal_names) REPLACE ({zeros}), CAST(lower AS DATE) AS start_date,
        CAST(upper AS DATE) AS end_date, coalesce(meal_names, '') AS meal_names, coalesce(nights, 0) AS n_nights,
        coalesce(nights, 0) > 0 AS has_sleep_record, coalesce(photos, 0) AS n_food_photos FROM windows {joins}""",
        "people", "photos", "injury", split=True)


@query("window_record", record_sql())
def window_record(spark, sf_dir):
    """Every field of the record (the estimates are the caller's)."""
    zone = {f"z{i}": F.coalesce(F.try_element_at("activity.hr_zones_min", F.lit(z)), F.lit(0.0)).alias(f"z{i}")
            for i, z in enumerate(E.ZONE_KEYS)}
    night = F.transform("sleep.nights", lambda n: F.concat_ws("/", n["date_of_sleep"], *[
        F.coalesce(n[c].cast("long").cast("string"), F.lit("-")) for c in NIGHT_NUMBERS]))
    hurt = F.transform(F.map_entries("injury.injuries"), lambda e: F.concat(
        e["key"], F.lit("="), F.try_element_at(e["value"], F.lit("left_foot")), F.lit("/"),
        F.coalesce(F.try_element_at(e["value"], F.lit("head_neck")), F.lit(""))))
    foot = F.coalesce(F.try_element_at("injury.last_known", F.lit("left_foot")), F.lit("none"))
    sessions = F.col("activity.n_exercise_sessions") > 0
    return report(spark, sf_dir).select(
        *W.WINDOW, "start_date", "end_date",
        *[f"activity.{c}" for c in ("total_steps", "peak_1min_steps", "total_distance", "total_calories_burned", "n_exercise_sessions",
                                    "resting_hr_bpm")],
        F.when(sessions, F.col("activity.exercise_minutes")).otherwise(0.0).alias("exercise_minutes"),
        F.array_join("activity.activities", ",").alias("activities"), *zone.values(),
        "sleep.n_nights", "sleep.has_sleep_record", F.array_join(night, ";").alias("night_list"),
        *[f"sleep.mean_{c}" for c in daily.SCORE_COLUMNS],
        "questionnaire.n_wellness_rows", *[f"questionnaire.latest_wellness.{c}" for c in ("fatigue", "mood", "readiness", "soreness_area")],
        *[f"questionnaire.{c}" for c in ("n_srpe_sessions", "mean_rpe", "srpe_total_duration_min", "training_load", "weight_kg",
                                         "total_glasses_of_fluid", "alcohol_consumed")],
        *[f"injury.{c}" for c in ("reports_in_window", "is_injured", "has_report_in_window", "last_report_ts")],
        F.array_join(hurt, ";").alias("injuries"), F.when(F.col("injury.last_known").isNotNull(), foot).alias("left_foot"),
        "nutrition.n_reporting_rows", "nutrition.n_meals_logged", F.coalesce(F.array_join("nutrition.meal_names", ","), F.lit("")).alias("meal_names"),
        "nutrition.n_food_photos", F.array_join("nutrition.photo_files", ",").alias("photo_files"))


@query("report_text")
def report_text(spark, sf_dir):
    return R.render_report(report(spark, sf_dir)).select(*W.WINDOW, "text")


@query("report_lines", B.with_views(WINDOWS_SQL + f""",
    n AS (SELECT w.participant_id, w.window_id, count(log_id) AS n_nights FROM windows w LEFT JOIN sleep s
          ON s.participant_id = w.participant_id AND {in_window_sql('s.end_ts')}
          AND s.start_ts >= CAST(w.lower AS DATE) - INTERVAL 1 DAY GROUP BY 1, 2),
    f AS (SELECT w.participant_id, w.window_id, count(s.seq) AS n_photos {per_window('photos')})
    SELECT participant_id, window_id, 33 + 7 * n_nights + CASE WHEN n_photos > 0 THEN 2 ELSE 0 END AS n_lines,
        '- **Nights recorded**: ' || n_nights AS nights_line
    FROM n JOIN f USING (participant_id, window_id)""", "people", "sleep", "photos", split=True))
def report_lines(spark, sf_dir):
    lines = R.report_lines(report(spark, sf_dir), W.window_nights(B.sleep(spark, sf_dir, split=True), windows(spark, sf_dir)))
    return lines.groupBy(*W.WINDOW).agg(
        F.count("*").alias("n_lines"),
        F.max(F.when(F.col("line").startswith("- **Nights recorded**"), F.col("line"))).alias("nights_line"))
