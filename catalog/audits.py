"""Data-quality audits over the bound sources."""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.registry import query
from catalog.rolling import LOAD_SQL
from catalog.runs import GAPS_SQL, HORIZON_SQL, wear_sources
from daygrain.operators import audit as A, stats as S

rnd = B.rnd
SUMMARY = ("n", "mean", "median", "sd", "q25", "q75", "iqr", "skew", "p1", "p99", "min", "max")


def summary_sql(c: str, digits: int = 4) -> str:
    """The twelve numbers of a column as SQL aggregates."""
    g1 = (f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END")
    parts = {"mean": f"avg({c})", "median": f"quantile_cont({c}, 0.5)", "sd": f"stddev_samp({c})",
             "q25": f"quantile_cont({c}, 0.25)", "q75": f"quantile_cont({c}, 0.75)",
             "iqr": f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", "skew": g1,
             "p1": f"quantile_cont({c}, 0.01)", "p99": f"quantile_cont({c}, 0.99)", "min": f"min({c})", "max": f"max({c})"}
    return f"count({c}) AS n, " + ", ".join(f"{rnd(v, digits)} + 0.0::DOUBLE AS \"{k}\"" for k, v in parts.items())


def tidy(df, digits: int = 4):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in SUMMARY if c != "n"})


@query("twelve_number_summary", f"""
    SELECT l_returnflag, {summary_sql('l_extendedprice')} FROM lineitem GROUP BY 1""")
def twelve_number_summary(spark, sf_dir):
    return tidy(S.describe12(B.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("twelve_number_summary_pooled", f"SELECT {summary_sql('o_totalprice')} FROM orders")
def twelve_number_summary_pooled(spark, sf_dir):
    return tidy(S.describe12(B.table(spark, sf_dir, "orders"), [], "o_totalprice"))


@query("exact_quantiles", f"""
    SELECT o_orderpriority, {rnd('quantile_cont(o_totalprice, 0.1)', 4)} AS p10, {rnd('quantile_cont(o_totalprice, 0.9)', 4)} AS p90
    FROM orders GROUP BY 1""")
def exact_quantiles(spark, sf_dir):
    out = S.exact_quantiles(B.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p90": 0.9})
    return out.select("o_orderpriority", F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"))


@query("equal_width_histogram", f"""
    WITH s AS (SELECT l_returnflag AS g, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
    g AS (SELECT g, lo, hi, CAST(i AS INTEGER) AS bin FROM s, range(12) t(i)),
    c AS (SELECT l_returnflag AS g, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS n
          FROM lineitem JOIN s ON s.g = l_returnflag GROUP BY 1, 2)
    SELECT g AS l_returnflag, bin, {rnd('(lo + bin * ((hi - lo) / 12))', 4)} AS bin_lo, {rnd('(lo + (bin + 1) * ((hi - lo) / 12))', 4)} AS bin_hi,
        coalesce(n, 0) AS n FROM g LEFT JOIN c USING (g, bin)""")
def equal_width_histogram(spark, sf_dir):
    out = S.histogram(B.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 12)
    return out.withColumns({c: F.round(c, 4) for c in ("bin_lo", "bin_hi")})


@query("source_inventory", B.with_views("""
    expected AS (SELECT participant_id, unnest(['steps.json', 'sleep.json', 'injury.csv', 'gone.csv']) AS source FROM people),
    c AS (SELECT participant_id, CASE event_type WHEN 'click' THEN 'steps.json' WHEN 'purchase' THEN 'sleep.json'
        WHEN 'error' THEN 'injury.csv' ELSE 'other' END AS source, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT participant_id, source, coalesce(n, 0) AS n_rows, n IS NOT NULL AS "exists" FROM expected LEFT JOIN c USING (participant_id, source)""",
    "people"))
def source_inventory(spark, sf_dir):
    named = F.expr("""CASE event_type WHEN 'click' THEN 'steps.json' WHEN 'purchase' THEN 'sleep.json'
        WHEN 'error' THEN 'injury.csv' ELSE 'other' END""")
    counts = B.events(spark, sf_dir).groupBy("participant_id", named.alias("source")).agg(F.count("*").alias("n_rows"))
    return A.audit_inventory(B.participants(spark, sf_dir), counts, expected=("steps.json", "sleep.json", "injury.csv", "gone.csv"))


@query("file_inventory")
def file_inventory(spark, sf_dir):
    from catalog.scans import scratch
    root = scratch(spark)
    rows = B.events(spark, sf_dir).select(F.concat_ws(",", "event_id", "value").alias("line"), F.weekday("ts").alias("weekday"), "event_type")
    rows.repartition("weekday", "event_type").write.partitionBy("weekday", "event_type").text(root)
    return A.file_sizes(spark, root).groupBy("participant_id").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query("schema_matrix", B.with_views(f"""
    r AS (SELECT participant_id, seq, meals, CAST(weight AS VARCHAR) AS weight, alcohol_consumed FROM reporting)
    SELECT 'reporting' AS dataset, participant_id, field, dtype, {rnd('avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INTEGER)', 3)} AS numeric_share,
        count(*) FILTER (v IS NULL) AS n_missing, arg_min(v, seq) FILTER (v IS NOT NULL) AS sample, false AS is_timestamp FROM (
        SELECT participant_id, seq, unnest(['meals', 'weight', 'alcohol_consumed']) AS field, unnest(['string', 'double', 'string']) AS dtype,
            unnest([meals, weight, alcohol_consumed]) AS v FROM r) GROUP BY 1, 2, 3, 4""", "reporting"))
def schema_matrix(spark, sf_dir):
    rows = B.reporting(spark, sf_dir).select("participant_id", "seq", "meals", "weight", "alcohol_consumed")
    return A.audit_schema(rows, "reporting", timestamp="ts")


@query("schema_drift_counts", B.with_views("""
    SELECT participant_id, 'sleep_type' AS what, sleep_type AS value, count(*) AS n FROM sleep GROUP BY 1, 2, 3
    UNION ALL SELECT participant_id, 'has_level_data', CAST(has_level_data AS VARCHAR), count(*) FROM sleep GROUP BY 1, 2, 3
    UNION ALL SELECT participant_id, 'activity_name', activity_name, count(*) FROM exercise GROUP BY 1, 2, 3""", "sleep", "exercise"))
def schema_drift_counts(spark, sf_dir):
    return A.audit_drift(B.sleep(spark, sf_dir), B.exercise(spark, sf_dir))


@query("temporal_horizon", B.with_views("""
    SELECT participant_id, 'wellness' AS modality, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(DISTINCT d) AS n_days
        FROM wellness GROUP BY 1 UNION ALL
    SELECT participant_id, 'heart_rate', min(ts), max(ts), count(*), count(DISTINCT d) FROM hr GROUP BY 1 UNION ALL
    SELECT participant_id, 'sleep', min(end_ts), max(end_ts), count(*), count(DISTINCT d) FROM sleep GROUP BY 1""", "wellness", "hr", "sleep"))
def temporal_horizon(spark, sf_dir):
    return A.audit_horizon({"wellness": (B.wellness(spark, sf_dir), "ts"), "heart_rate": (B.hr(spark, sf_dir), "ts"),
                            "sleep": (B.sleep(spark, sf_dir), "end_ts")})


@query("minute_missingness", B.with_views(f"""
    days AS (SELECT participant_id, metric, d, count(*) AS r, count(DISTINCT ts) AS u FROM minute GROUP BY 1, 2, 3)
    SELECT participant_id, metric, CAST(sum(r) AS BIGINT) AS n_records, CAST(sum(u) AS BIGINT) AS n_unique_ts,
        CAST(sum(r - u) AS BIGINT) AS n_duplicates, 43200::BIGINT AS expected_slots, CAST(43200 - sum(u) AS BIGINT) AS missing_slots,
        {rnd('(100 * (43200 - sum(u)) / 43200.0::DOUBLE)', 2)} AS missing_pct, count(*) AS days_present,
        count(*) FILTER (r = 1440) AS days_full, count(*) FILTER (r < 1440) AS days_partial, min(r) AS min_daily, max(r) AS max_daily,
        {rnd('avg(r)', 1)} AS mean_daily FROM days GROUP BY 1, 2""", "minute"))
def minute_missingness(spark, sf_dir):
    return A.audit_minutes(B.minute(spark, sf_dir), B.START, B.END)


@query("nonwear_summary", B.with_views(HORIZON_SQL + f""",
    per_day AS (SELECT participant_id, day, sum(least(b, day * 1440 + 1439) - greatest(a, day * 1440) + 1) AS m FROM split GROUP BY 1, 2),
    r AS (SELECT participant_id, count(*) AS n_long_runs, CAST(sum(n_min) AS BIGINT) AS total_nonwear_min FROM long GROUP BY 1),
    q AS (SELECT participant_id, {rnd('avg(m)', 1)} AS mean_per_day, CAST(median(m) AS DOUBLE) AS median_per_day,
        CAST(max(m) AS BIGINT) AS max_one_day, count(*) AS days_with_any FROM per_day GROUP BY 1)
    SELECT *, {rnd('(total_nonwear_min / 60.0::DOUBLE)', 1)} AS total_nonwear_hours FROM r JOIN q USING (participant_id)""", "people"))
def nonwear_summary(spark, sf_dir):
    return A.audit_nonwear(*wear_sources(spark, sf_dir), B.participants(spark, sf_dir), B.START, B.END)


VALUES_SQL = """m AS (SELECT participant_id, d AS date, metric, sum(value) AS value FROM minute GROUP BY 1, 2, 3),
    e AS (SELECT participant_id, d AS date, sum(coalesce(active_ms, duration_ms, 0)) / 60000.0::DOUBLE AS value FROM exercise GROUP BY 1, 2),
    g AS (SELECT participant_id, date, unnest(['steps', 'distance', 'calories']) AS metric FROM spine),
    vals AS (SELECT participant_id, date, metric, value FROM g LEFT JOIN m USING (participant_id, date, metric)
        UNION ALL SELECT participant_id, date, 'exercise_active_min', coalesce(value, 0) FROM spine LEFT JOIN e USING (participant_id, date))"""


def values(spark, sf_dir):
    return A.daily_values(B.minute(spark, sf_dir), B.exercise(spark, sf_dir), B.spine(spark, sf_dir))


@query("daily_distributions", B.with_views(VALUES_SQL + f"""
    SELECT participant_id, metric, {summary_sql('value', 6)} FROM vals GROUP BY 1, 2""", "spine", "minute", "exercise"))
def daily_distributions(spark, sf_dir):
    return tidy(A.audit_daily(values(spark, sf_dir)), 6)


@query("daily_values_wide", B.with_views(VALUES_SQL + f"""
    SELECT participant_id, date, max(value) FILTER (metric = 'steps') AS steps, max(value) FILTER (metric = 'calories') AS calories,
        {rnd("max(value) FILTER (metric = 'exercise_active_min')", 6)} AS exercise_active_min FROM vals GROUP BY 1, 2""",
    "spine", "minute", "exercise"))
def daily_values_wide(spark, sf_dir):
    out = A.daily_wide(values(spark, sf_dir), ["steps", "calories", "exercise_active_min"])
    return out.withColumn("exercise_active_min", F.round("exercise_active_min", 6))


@query("resting_hr_baseline", B.with_views(f"""
    v AS (SELECT participant_id, CASE WHEN value > 0 THEN value END AS v, ts, seq FROM rhr),
    p AS (SELECT participant_id, v, row_number() OVER (PARTITION BY participant_id ORDER BY ts, seq) AS r,
        count(*) OVER (PARTITION BY participant_id) AS cnt FROM v WHERE v IS NOT NULL),
    dr AS (SELECT participant_id, CASE WHEN max(cnt) >= 10 THEN {rnd('(avg(v) FILTER (r > cnt // 2) - avg(v) FILTER (r <= cnt // 2))', 2)} END
        AS drift FROM p GROUP BY 1)
    SELECT participant_id, count(*) FILTER (v IS NULL) AS n_sentinel, {summary_sql('v')}, max(drift) AS drift
    FROM v LEFT JOIN dr USING (participant_id) GROUP BY 1""", "rhr"))
def resting_hr_baseline(spark, sf_dir):
    return tidy(A.audit_rhr(B.rhr(spark, sf_dir)))


@query("heart_rate_distributions", B.with_views(f"""
    peaks AS (SELECT participant_id, d, max(bpm) AS bpm FROM hr GROUP BY 1, 2)
    SELECT participant_id, 'samples' AS modality, {summary_sql('bpm')} FROM hr GROUP BY 1
    UNION ALL SELECT participant_id, 'daily_peak', {summary_sql('bpm')} FROM peaks GROUP BY 1""", "hr"))
def heart_rate_distributions(spark, sf_dir):
    return tidy(A.audit_hr(B.hr(spark, sf_dir)))


@query("confidence_histogram", B.with_views("SELECT participant_id, confidence, count(*) AS n FROM hr GROUP BY 1, 2", "hr"))
def confidence_histogram(spark, sf_dir):
    return A.audit_confidence(B.hr(spark, sf_dir))


@query("zone_distributions", B.with_views(f"""
    r AS (SELECT participant_id, d, unnest(['BELOW_DEFAULT_ZONE_1', 'IN_DEFAULT_ZONE_1', 'IN_DEFAULT_ZONE_2', 'IN_DEFAULT_ZONE_3']) AS zone,
        unnest([z0, z1, coalesce(z2, 0), coalesce(z3, 0)]) AS m FROM zones),
    l AS (SELECT participant_id, d, zone, sum(m) AS m FROM r GROUP BY 1, 2, 3)
    SELECT participant_id, zone, {summary_sql('m')} FROM l GROUP BY 1, 2""", "zones"))
def zone_distributions(spark, sf_dir):
    return tidy(A.audit_zones(B.zones(spark, sf_dir)))


STAGED = "CASE WHEN sleep_type = 'stages' THEN {c} END"


@query("sleep_distributions", B.with_views(f"""
    n AS (SELECT participant_id, asleep_min, awake_total_min, time_in_bed_min, efficiency_pct, {", ".join(
        STAGED.format(c=c) + f" AS {c}" for c in ("deep_min", "light_min", "rem_min", "wake_min"))} FROM sleep),
    l AS (SELECT participant_id, unnest([{", ".join(f"'{c}'" for c in A.SLEEP_METRICS)}]) AS metric,
        unnest([{", ".join(A.SLEEP_METRICS)}]) AS v FROM n)
    SELECT participant_id, metric, {summary_sql('v')} FROM l GROUP BY 1, 2""", "sleep"))
def sleep_distributions(spark, sf_dir):
    return tidy(A.audit_sleep(B.sleep(spark, sf_dir)))


ARCH_SQL = """t AS (SELECT participant_id, deep_min + light_min + rem_min + wake_min AS t, deep_min, light_min, rem_min, wake_min FROM sleep
        WHERE sleep_type = 'stages' AND wake_min IS NOT NULL),
    l AS (SELECT participant_id, unnest(['deep_pct', 'light_pct', 'rem_pct', 'wake_pct']) AS metric,
        unnest([100 * deep_min / t, 100 * light_min / t, 100 * rem_min / t, 100 * wake_min / t]) AS v FROM t WHERE t > 0)"""


@query("sleep_architecture_shares", B.with_views(ARCH_SQL + f"""
    SELECT participant_id, metric, {summary_sql('v', 6)} FROM l GROUP BY 1, 2""", "sleep"))
def sleep_architecture_shares(spark, sf_dir):
    return tidy(A.audit_sleep_arch(B.sleep(spark, sf_dir)), 6)


@query("questionnaire_response", B.with_views(f"""
    SELECT participant_id, count(*) AS n_rows, count(DISTINCT d) AS n_days_with_log, 30 AS horizon_days,
        {rnd('(count(DISTINCT d) / 30.0::DOUBLE)', 3)} AS response_rate, min(ts) AS first_ts, max(ts) AS last_ts,
        {rnd('median(hour(ts))', 2)} AS median_hour, {rnd('stddev_samp(hour(ts))', 2)} AS sd_hour,
        {rnd('(100 * count(*) FILTER (hour(ts) < 9) / count(*)::DOUBLE)', 1)} AS pct_before_09,
        {rnd('(100 * count(*) FILTER (hour(ts) >= 12) / count(*)::DOUBLE)', 1)} AS pct_after_12 FROM wellness GROUP BY 1""", "wellness"))
def questionnaire_response(spark, sf_dir):
    return A.audit_response(B.wellness(spark, sf_dir), B.DAYS)


@query("submission_hours", B.with_views("SELECT participant_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM wellness GROUP BY 1, 2", "wellness"))
def submission_hours(spark, sf_dir):
    return A.audit_hours(B.wellness(spark, sf_dir))


@query("likert_distributions", B.with_views(f"""
    l AS (SELECT participant_id, unnest(['fatigue', 'sleep_quality']) AS metric, unnest([fatigue, sleep_quality]) AS v FROM wellness),
    c AS (SELECT participant_id, metric, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3),
    m AS (SELECT participant_id, metric, arg_max(v, (n, -v)) AS mode, {rnd('max(n) / sum(n)::DOUBLE', 3)} AS mode_share, count(*) AS n_unique,
        string_agg(CAST(v AS INTEGER) || ':' || CAST(round(100 * n / t::DOUBLE) AS INTEGER) || '%', ';' ORDER BY v) AS value_counts
        FROM (SELECT *, sum(n) OVER (PARTITION BY participant_id, metric) AS t FROM c) GROUP BY 1, 2),
    s AS (SELECT participant_id, metric, {summary_sql('v')} FROM l GROUP BY 1, 2)
    SELECT * FROM s LEFT JOIN m USING (participant_id, metric)""", "wellness"))
def likert_distributions(spark, sf_dir):
    return tidy(A.audit_likert(B.wellness(spark, sf_dir), ["fatigue", "sleep_quality"]))


@query("intra_vs_inter_variance", B.with_views(f"""
    l AS (SELECT participant_id, unnest(['fatigue', 'readiness', 'sleep_quality']) AS metric, unnest([fatigue, readiness, sleep_quality]) AS v
          FROM wellness),
    g AS (SELECT metric, participant_id, avg(v) AS m, stddev_samp(v) AS sd FROM l GROUP BY 1, 2),
    o AS (SELECT metric, avg(sd) AS w, stddev_samp(m) AS b FROM g GROUP BY 1), t AS (SELECT metric, avg(v) AS gm FROM l GROUP BY 1)
    SELECT metric, {rnd('gm', 2)} AS grand_mean, {rnd('w', 3)} AS within_sd, {rnd('b', 3)} AS between_sd, {rnd('(b / w)', 2)} AS ratio
    FROM o JOIN t USING (metric)""", "wellness"))
def intra_vs_inter_variance(spark, sf_dir):
    return A.audit_variance(B.wellness(spark, sf_dir), ["fatigue", "readiness", "sleep_quality"])


@query("training_load_summary", B.with_views(LOAD_SQL + f""",
    z AS (SELECT participant_id, date, coalesce(srpe_load, 0) AS load FROM day),
    h AS (SELECT participant_id, avg(load) AS m, stddev_samp(load) AS sd, sum(load) AS t, max(load) AS mx FROM z GROUP BY 1),
    k AS (SELECT participant_id, count(*) AS n FROM z JOIN h USING (participant_id) WHERE sd > 0 AND load > m + 2 * sd GROUP BY 1),
    q AS (SELECT participant_id, count(*) AS n_sessions, {rnd('avg(rpe)', 2)} AS mean_rpe, {rnd('avg(duration_min)', 1)} AS mean_duration,
        coalesce(sum(rpe * duration_min), 0) AS total_load FROM srpe GROUP BY 1),
    a AS (SELECT participant_id, string_agg(DISTINCT x, ';' ORDER BY x) AS activity_types
        FROM (SELECT participant_id, unnest(activity_names) AS x FROM srpe) GROUP BY 1)
    SELECT participant_id, coalesce(n_sessions, 0) AS n_sessions, mean_rpe, mean_duration, coalesce(total_load, 0) AS total_load,
        {rnd('m', 2)} AS mean_daily_load, {rnd('sd', 2)} AS sd_daily_load, {rnd('(m / nullif(sd, 0))', 3)} AS monotony,
        {rnd('(t * (m / nullif(sd, 0)))', 1)} AS strain, coalesce(k.n, 0) AS n_spike_days, mx AS max_daily_load, activity_types
    FROM h LEFT JOIN k USING (participant_id) LEFT JOIN q USING (participant_id) LEFT JOIN a USING (participant_id)""", "spine", "srpe"))
def training_load_summary(spark, sf_dir):
    return A.audit_load(B.srpe(spark, sf_dir), B.spine(spark, sf_dir))


@query("weight_stability", B.with_views(f"""
    l AS (SELECT participant_id, abs(weight - lag(weight) OVER (PARTITION BY participant_id ORDER BY ts, seq)) AS dw FROM reporting
          WHERE weight IS NOT NULL),
    s AS (SELECT participant_id, {rnd('avg(dw)', 3)} AS mean_abs_delta, max(dw) AS max_abs_delta, count(*) FILTER (dw > 2) AS n_gt2
          FROM l WHERE dw IS NOT NULL GROUP BY 1)
    SELECT participant_id, count(weight) AS n_obs, count(*) FILTER (weight IS NULL) AS n_missing, {rnd('avg(weight)', 2)} AS mean,
        {rnd('stddev_samp(weight)', 3)} AS sd, {rnd('(100 * stddev_samp(weight) / avg(weight))', 3)} AS cv_pct, min(weight) AS min,
        max(weight) AS max, max(weight) - min(weight) AS range, max(mean_abs_delta) AS mean_abs_delta, max(max_abs_delta) AS max_abs_delta,
        coalesce(max(n_gt2), 0) AS n_gt2 FROM reporting LEFT JOIN s USING (participant_id) GROUP BY 1""", "reporting"))
def weight_stability(spark, sf_dir):
    return A.audit_weight(B.reporting(spark, sf_dir))


DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@query("alcohol_frequency", B.with_views(f"""
    r AS (SELECT *, lower(alcohol_consumed) = 'yes' AS yes, isodow(d) - 1 AS w FROM reporting)
    SELECT participant_id, count(*) AS n_rows, count(*) FILTER (yes) AS n_yes, {rnd('(100 * avg(yes::INTEGER))', 1)} AS pct_yes,
        {rnd('(100 * avg((w >= 4)::INTEGER) FILTER (yes))', 1)} AS pct_weekend, {rnd('avg(glasses_of_fluid)', 2)} AS glasses_mean,
        {", ".join(f"count(*) FILTER (yes AND w = {i}) AS yes_{n}" for i, n in enumerate(DAY_NAMES))} FROM r GROUP BY 1""", "reporting"))
def alcohol_frequency(spark, sf_dir):
    return A.audit_alcohol(B.reporting(spark, sf_dir))


META_SQL = """meta AS (SELECT user_id AS participant_id, CASE event_id % 7 WHEN 0 THEN 'shot.PNG' ELSE 'IMG_1.jpg' END AS file,
    CASE event_type WHEN 'error' THEN 'UNREADABLE' ELSE 'JPEG' END AS format, event_type AS mode, CAST(floor(value / 100) AS INTEGER) AS width,
    10 AS height, floor(value * 100) AS size_bytes, CASE event_type WHEN 'error' THEN NULL ELSE ts END AS ts, event_type = 'view' AS has_gps,
    event_type <> 'view' AS has_orientation FROM events)"""


def photo_meta(spark, sf_dir):
    return B.events(spark, sf_dir).select(
        "participant_id", F.expr("CASE event_id % 7 WHEN 0 THEN 'shot.PNG' ELSE 'IMG_1.jpg' END").alias("file"),
        F.expr("CASE event_type WHEN 'error' THEN 'UNREADABLE' ELSE 'JPEG' END").alias("format"), F.col("event_type").alias("mode"),
        F.floor(F.col("value") / 100).cast("int").alias("width"), F.lit(10).alias("height"),
        F.floor(F.col("value") * 100).cast("double").alias("size_bytes"),
        F.expr("CASE event_type WHEN 'error' THEN NULL ELSE ts END").alias("ts"),
        (F.col("event_type") == "view").alias("has_gps"), (F.col("event_type") != "view").alias("has_orientation"))


@query("photo_file_summary", f"""WITH {META_SQL}
    SELECT participant_id, count(*) AS n_images, {rnd('(avg(size_bytes) / 1024)', 1)} AS mean_kb, {rnd('(min(size_bytes) / 1024)', 1)} AS min_kb,
        {rnd('(max(size_bytes) / 1024)', 1)} AS max_kb, {rnd('(100 * avg((ts IS NOT NULL)::INTEGER))', 1)} AS pct_datetime,
        {rnd('(100 * avg(has_gps::INTEGER))', 1)} AS pct_gps, {rnd('(100 * avg(has_orientation::INTEGER))', 1)} AS pct_orientation,
        count(*) FILTER (format = 'UNREADABLE') AS n_unreadable, count(*) FILTER (lower(file) LIKE '%.png') AS n_suspicious
    FROM meta GROUP BY 1""")
def photo_file_summary(spark, sf_dir):
    return A.audit_photos(photo_meta(spark, sf_dir))


@query("photo_file_facets", f"""WITH {META_SQL},
    res AS (SELECT participant_id, width || 'x' || height AS value, count(*) AS n FROM meta GROUP BY 1, 2)
    SELECT participant_id, format AS value, count(*) AS n, 'format' AS facet FROM meta GROUP BY 1, 2
    UNION ALL SELECT participant_id, mode, count(*), 'mode' FROM meta GROUP BY 1, 2
    UNION ALL SELECT participant_id, value, n, 'resolution' FROM (SELECT *, row_number() OVER (PARTITION BY participant_id
        ORDER BY n DESC, value) AS r FROM res) WHERE r <= 3""")
def photo_file_facets(spark, sf_dir):
    return A.photo_facets(photo_meta(spark, sf_dir))


@query("meal_cadence", B.with_views(GAPS_SQL + f"""
    SELECT participant_id, count(*) AS n_gaps, {rnd('100 * avg((gap_s <= 1800)::INTEGER)', 1)} AS pct_le_30min,
        {rnd('quantile_cont(gap_s, 0.5) / 3600', 2)} AS median_interval_h FROM gaps GROUP BY 1"""))
def meal_cadence(spark, sf_dir):
    return A.audit_cadence(B.photos(spark, sf_dir)).select("participant_id", "n_gaps", "pct_le_30min", "median_interval_h")


@query("injury_counts", B.with_views("""
    n AS (SELECT participant_id, 'left_foot' AS loc, foot AS sev FROM injury WHERE foot IS NOT NULL
          UNION ALL SELECT participant_id, 'head_neck', head FROM injury WHERE head IS NOT NULL)
    SELECT participant_id, 'reports' AS kind, 'all' AS value, count(*) AS n FROM injury GROUP BY 1
    UNION ALL SELECT participant_id, 'events', 'all', count(*) FILTER (foot IS NOT NULL) FROM injury GROUP BY 1
    UNION ALL SELECT participant_id, 'location', loc, count(*) FROM n GROUP BY 1, 3
    UNION ALL SELECT participant_id, 'severity', sev, count(*) FROM n GROUP BY 1, 3""", "injury"))
def injury_counts(spark, sf_dir):
    return A.audit_injuries(B.injury(spark, sf_dir))


@query("injury_incidence", B.with_views(f"""
    h AS (SELECT (SELECT sum(duration_min) FROM srpe) / 60 AS srpe_h,
        ((SELECT sum(duration_min) FROM srpe) + (SELECT sum(coalesce(active_ms, duration_ms, 0)) / 60000.0::DOUBLE FROM exercise)) / 60 AS total_h,
        (SELECT count(*) FROM injury WHERE foot IS NOT NULL) AS n_events)
    SELECT n_events, {rnd('srpe_h', 4)} AS srpe_h, {rnd('total_h', 4)} AS total_h, {rnd('(1000 * n_events / total_h)', 1)} AS per_1000h,
        {rnd('(1000 * n_events / srpe_h)', 1)} AS per_1000h_srpe FROM h""", "srpe", "exercise", "injury"))
def injury_incidence(spark, sf_dir):
    from daygrain.operators.daily import exposure_hours
    out = A.incidence(B.injury(spark, sf_dir), exposure_hours(B.srpe(spark, sf_dir), B.exercise(spark, sf_dir)))
    return out.withColumns({"srpe_h": F.round("srpe_h", 4), "total_h": F.round("total_h", 4)})


@query("class_imbalance", B.with_views(f"""
    e AS (SELECT participant_id, count(DISTINCT d) FILTER (foot IS NOT NULL) AS n FROM injury GROUP BY 1),
    c AS (SELECT participant_id, coalesce(n, 0) AS event_days FROM people LEFT JOIN e USING (participant_id))
    SELECT participant_id, event_days, 30 AS horizon_days, 30 - event_days AS non_event_days,
        CASE WHEN event_days = 0 THEN '0 events' ELSE '1:' || ((30 - event_days) // event_days) END AS imbalance_ratio,
        {rnd('(100 * event_days / 30.0::DOUBLE)', 2)} AS event_day_rate_pct FROM c""", "people", "injury"))
def class_imbalance(spark, sf_dir):
    return A.class_imbalance(B.injury(spark, sf_dir), B.participants(spark, sf_dir), B.DAYS)


@query("label_run_summary", """
    WITH p AS (SELECT source AS participant_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file, coalesce(CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END,
        'PENDING') AS is_food, lang AS model FROM documents LEFT JOIN labels USING (doc_id)),
    m AS (SELECT participant_id, string_agg(t, '; ' ORDER BY t) AS models FROM (SELECT participant_id, model || ':' || count(*) AS t FROM p
        WHERE is_food <> 'PENDING' GROUP BY participant_id, model) GROUP BY 1),
    f AS (SELECT participant_id, string_agg(DISTINCT file, '; ' ORDER BY file) AS non_food_files FROM p WHERE is_food = 'NO' GROUP BY 1)
    SELECT participant_id, count(*) AS n_images, count(*) FILTER (is_food = 'YES') AS n_yes, count(*) FILTER (is_food = 'NO') AS n_no,
        count(*) FILTER (is_food = 'PENDING') AS n_pending, max(models) AS models, max(non_food_files) AS non_food_files
    FROM p LEFT JOIN m USING (participant_id) LEFT JOIN f USING (participant_id) GROUP BY 1""")
def label_run_summary(spark, sf_dir):
    from daygrain.operators.joins import with_labels
    docs = B.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("participant_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file"), F.col("lang").alias("model"))
    labels = B.table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE quality WHEN 1 THEN 'YES' ELSE 'NO' END").alias("is_food"))
    return A.label_summary(with_labels(docs, labels, "doc_id", "is_food"))


@query("basic_column_stats", "WITH x AS (SELECT l_quantity, l_discount, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS l_tax FROM lineitem) "
       + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, {rnd(f'avg({c})', 8)} AS mean, {rnd(f'stddev_samp({c})', 8)} AS std,
       min({c}) AS min, {rnd(f'median({c})', 8)} AS median, max({c}) AS max, count(*) FILTER ({c} IS NULL) AS missing FROM x"""
       for c in ("l_quantity", "l_discount", "l_tax")))
def basic_column_stats(spark, sf_dir):
    tax = F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("l_tax")
    rows = B.table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", tax)
    out = S.basic_stats(rows, ["l_quantity", "l_discount", "l_tax"])
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std", "median")})


@query("value_shares", f"""
    SELECT l_returnflag, l_quantity, count(*) AS n, {rnd('(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE)', 9)} AS share
    FROM lineitem GROUP BY 1, 2""")
def value_shares(spark, sf_dir):
    out = S.value_shares(B.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.withColumn("share", F.round("share", 9))
