"""Trailing windows, forward fill, labels and missingness on daily tables."""

from pyspark.sql import functions as F

from catalog import bindings as B, cleaning  # noqa: F401  (its twins are part of the whole table)
from catalog.aggregates import MAIN_NIGHT
from catalog.registry import ORACLE_SQL, query
from daygrain.operators import daily, missing as M, rolling as W
from daygrain.operators.audit import abs_deltas, half_split_drift
from daygrain.operators.joins import reindex_days
from daygrain.plans import feature_table as P, refresh
from daygrain.session import scratch_dir

rnd = B.rnd
KEYS = ["participant_id", "date"]
W7 = "OVER (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
W28 = "OVER (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)"

# Daily load on the spine: no session 0, sessions without a valid load NULL.
LOAD_SQL = """s AS (SELECT participant_id, d AS date, count(*) AS n, sum(rpe * duration_min) AS load FROM srpe GROUP BY 1, 2),
    day AS (SELECT participant_id, date, coalesce(n, 0) AS srpe_n_sessions,
        CASE WHEN n IS NULL THEN 0::DOUBLE ELSE load END AS srpe_load FROM spine LEFT JOIN s USING (participant_id, date))"""
# Daily weight with gaps.
WEIGHT_SQL = """r AS (SELECT participant_id, d AS date, arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight_raw
        FROM reporting GROUP BY 1, 2),
    day AS (SELECT participant_id, date, weight_raw FROM spine LEFT JOIN r USING (participant_id, date))"""
READY_SQL = """r AS (SELECT participant_id, d AS date, count(*) AS n, arg_max_null(CASE WHEN readiness BETWEEN 1 AND 10 THEN readiness END, seq)
        AS ready FROM wellness GROUP BY 1, 2),
    day AS (SELECT participant_id, date, coalesce(n, 0) AS n_wellness_rows, ready AS readiness_same_day
        FROM spine LEFT JOIN r USING (participant_id, date))"""


def load_days(spark, sf_dir):
    srpe = daily.srpe_daily(B.srpe(spark, sf_dir)).select(*KEYS, "srpe_n_sessions", "srpe_load")
    out = B.spine(spark, sf_dir).join(srpe, KEYS, "left")
    return out.withColumn("srpe_load", F.when(F.col("srpe_n_sessions").isNull(), 0.0).otherwise(
        F.col("srpe_load"))).fillna(0, subset=["srpe_n_sessions"])


def weight_days(spark, sf_dir):
    day = daily.reporting_daily(B.reporting(spark, sf_dir)).select(*KEYS, "weight_raw")
    return reindex_days(day, B.spine(spark, sf_dir))


def ready_days(spark, sf_dir):
    day = daily.wellness_daily(B.wellness(spark, sf_dir)).select(*KEYS, "n_wellness_rows", "readiness_same_day")
    return reindex_days(day, B.spine(spark, sf_dir)).fillna(0, subset=["n_wellness_rows"])


@query("trailing_load_sum_mean", B.with_views(LOAD_SQL + f"""
    SELECT participant_id, date, srpe_load, {rnd(f'(sum(srpe_load) {W7})', 1)} AS load_7d_sum,
        {rnd(f'(avg(srpe_load) {W7})', 1)} AS load_7d_mean FROM day""", "spine", "srpe"))
def trailing_load_sum_mean(spark, sf_dir):
    return W.rolling_sum_mean(load_days(spark, sf_dir), "srpe_load").drop("srpe_n_sessions")


@query("trailing_mean_28", B.with_views(LOAD_SQL + f"""
    SELECT participant_id, date, {rnd(f'(avg(srpe_load) {W28})', 6)} AS load_28d_mean FROM day""", "spine", "srpe"))
def trailing_mean_28(spark, sf_dir):
    return W.rolling_mean(load_days(spark, sf_dir), "srpe_load", 28, "load_28d_mean").select(
        *KEYS, F.round("load_28d_mean", 6).alias("load_28d_mean"))


@query("trailing_sd", B.with_views(LOAD_SQL + f"""
    SELECT participant_id, date, {rnd(f'(stddev_samp(srpe_load) {W7})', 4)} AS load_7d_sd FROM day""", "spine", "srpe"))
def trailing_sd(spark, sf_dir):
    return W.rolling_sd(load_days(spark, sf_dir), "srpe_load", 7, "load_7d_sd").select(
        *KEYS, F.round("load_7d_sd", 4).alias("load_7d_sd"))


MONO = f"CASE WHEN max(srpe_load) {W7} > min(srpe_load) {W7} THEN avg(srpe_load) {W7} / stddev_samp(srpe_load) {W7} END"


@query("monotony_strain_acwr", B.with_views(LOAD_SQL + f""",
    m AS (SELECT participant_id, date, {MONO} AS mono, sum(srpe_load) {W7} AS s7, avg(srpe_load) {W7} AS m7,
        avg(srpe_load) {W28} AS m28 FROM day)
    SELECT participant_id, date, {rnd('mono', 2)} AS monotony_7d, {rnd('(s7 * mono)', 1)} AS strain_7d,
        {rnd('(m7 / nullif(m28, 0))', 2)} AS acwr_7_28 FROM m""", "spine", "srpe"))
def monotony_strain_acwr(spark, sf_dir):
    return W.load_features(load_days(spark, sf_dir)).select(*KEYS, "monotony_7d", "strain_7d", "acwr_7_28")


@query("injured_in_last_week", B.with_views(f"""
    i AS (SELECT participant_id, d AS date, max((foot IS NOT NULL)::INTEGER) AS is_injured_day FROM injury GROUP BY 1, 2)
    SELECT participant_id, date, max(coalesce(is_injured_day, 0)) {W7} AS injured_last_7d
    FROM spine LEFT JOIN i USING (participant_id, date)""", "spine", "injury"))
def injured_in_last_week(spark, sf_dir):
    day = reindex_days(daily.injury_daily(B.injury(spark, sf_dir)), B.spine(spark, sf_dir))
    return W.rolling_max(day, "is_injured_day", 7, "injured_last_7d").select(*KEYS, "injured_last_7d")


@query("trailing_median_residual", B.with_views(WEIGHT_SQL + f""",
    m AS (SELECT *, median(weight_raw) {W7} AS med FROM day)
    SELECT participant_id, date, weight_raw, {rnd('med', 2)} AS weight_7d_median, {rnd('(weight_raw - med)', 2)} AS weight_residual
    FROM m""", "spine", "reporting"))
def trailing_median_residual(spark, sf_dir):
    return W.rolling_median_residual(weight_days(spark, sf_dir), "weight_raw")


@query("trailing_window_stats", B.with_views(WEIGHT_SQL + f"""
    SELECT participant_id, date, {rnd(f'(avg(weight_raw) {W7})', 6)} AS weight_raw_mean_7d,
        {rnd(f'(median(weight_raw) {W7})', 6)} AS weight_raw_median_7d, {rnd(f'(stddev_samp(weight_raw) {W7})', 4)} AS weight_raw_std_7d
    FROM day""", "spine", "reporting"))
def trailing_window_stats(spark, sf_dir):
    out = W.window_stats(weight_days(spark, sf_dir), ["weight_raw"])
    return out.select(*KEYS, F.round("weight_raw_mean_7d", 6).alias("weight_raw_mean_7d"),
                      F.round("weight_raw_median_7d", 6).alias("weight_raw_median_7d"),
                      F.round("weight_raw_std_7d", 4).alias("weight_raw_std_7d"))


@query("missing_day_ratios", B.with_views(WEIGHT_SQL + f"""
    SELECT day.participant_id, day.date, {rnd(f'(avg((weight_raw IS NULL)::INTEGER) {W7.replace("participant_id", "day.participant_id").replace("BY date", "BY day.date")})', 6)}
        AS missing_ratio_weight_7d FROM day""", "spine", "reporting"))
def missing_day_ratios(spark, sf_dir):
    return W.missing_ratios(weight_days(spark, sf_dir)).select(
        *KEYS, F.round("missing_ratio_weight_7d", 6).alias("missing_ratio_weight_7d"))


@query("causal_forward_fill", B.with_views(WEIGHT_SQL + """,
    f AS (SELECT *, last_value(weight_raw IGNORE NULLS) OVER (PARTITION BY participant_id ORDER BY date
        ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS carried FROM day)
    SELECT participant_id, date, coalesce(weight_raw, carried) AS weight_raw,
        (weight_raw IS NULL AND carried IS NOT NULL)::INTEGER AS was_imputed_weight_raw FROM f""", "spine", "reporting"))
def causal_forward_fill(spark, sf_dir):
    return W.causal_ffill(weight_days(spark, sf_dir), ["weight_raw"])


@query("next_day_label", B.with_views(READY_SQL + """,
    l AS (SELECT *, lead(readiness_same_day) OVER (PARTITION BY participant_id ORDER BY date) AS readiness_next_day FROM day)
    SELECT participant_id, date, readiness_same_day, readiness_next_day, (readiness_next_day IS NOT NULL)::INTEGER AS label_available
    FROM l""", "spine", "wellness"))
def next_day_label(spark, sf_dir):
    return W.next_day_label(ready_days(spark, sf_dir)).drop("n_wellness_rows")


@query("labelled_rows", B.with_views(READY_SQL + """
    SELECT participant_id, date, readiness_same_day FROM day WHERE readiness_same_day IS NOT NULL""", "spine", "wellness"))
def labelled_rows(spark, sf_dir):
    from daygrain.sources.sinks import load_labeled
    return load_labeled(ready_days(spark, sf_dir), "readiness_same_day").drop("n_wellness_rows")


@query("demean_within_group", """
    SELECT o_orderkey, """ + rnd("(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey))", 4) + " AS o_totalprice FROM orders")
def demean_within_group(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return W.demean_within(orders, ["o_totalprice"], "o_custkey").select(
        "o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("consecutive_changes", """
    WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
        AS delta FROM orders WHERE o_totalprice IS NOT NULL)
    SELECT o_custkey, o_orderkey, """ + rnd("abs(delta)", 4) + " AS abs_delta FROM l WHERE delta IS NOT NULL")
def consecutive_changes(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    out = abs_deltas(orders, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", "o_orderkey", F.round("abs_delta", 4).alias("abs_delta"))


@query("half_split_drift", f"""
    WITH p AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, max(n) AS n_valid, {rnd("CASE WHEN max(n) >= 10 THEN avg(o_totalprice) FILTER (r > n // 2) - avg(o_totalprice) FILTER (r <= n // 2) END", 6)}
        AS drift FROM p GROUP BY 1""")
def drift_between_halves(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    out = half_split_drift(orders, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return out.withColumn("drift", F.round("drift", 6))


@query("spike_days", B.with_views(LOAD_SQL + """,
    z AS (SELECT participant_id, date, coalesce(srpe_load, 0) AS load FROM day),
    b AS (SELECT participant_id, avg(load) AS m, stddev_samp(load) AS sd FROM z GROUP BY 1)
    SELECT participant_id, date, load FROM z JOIN b USING (participant_id) WHERE sd > 0 AND load > m + 2 * sd""", "spine", "srpe"))
def spike_days(spark, sf_dir):
    days = load_days(spark, sf_dir).select(*KEYS, F.coalesce("srpe_load", F.lit(0.0)).alias("load"))
    return W.spike_days(days, "load")


@query("presence_flags", B.with_views(READY_SQL + """
    SELECT participant_id, date, (n_wellness_rows > 0)::INTEGER AS has_wellness, 0 AS has_nutrition FROM day""", "spine", "wellness"))
def presence_flags(spark, sf_dir):
    return M.presence_flags(ready_days(spark, sf_dir)).select(*KEYS, "has_wellness", "has_nutrition")


@query("zero_or_unknown_policy", B.with_views("""
    a AS (SELECT participant_id, d AS date, count(*) AS n, sum(coalesce(glasses_of_fluid, 0)) AS fluids FROM reporting GROUP BY 1, 2),
    s AS (SELECT participant_id, d AS date, count(*) AS n FROM srpe GROUP BY 1, 2)
    SELECT participant_id, date, CAST(coalesce(a.n, 0) AS INTEGER) AS n_reporting_rows, a.fluids AS fluids_glasses,
        CAST(coalesce(s.n, 0) AS INTEGER) AS srpe_n_sessions
    FROM spine LEFT JOIN a USING (participant_id, date) LEFT JOIN s USING (participant_id, date)""", "spine", "reporting", "srpe"))
def zero_or_unknown_policy(spark, sf_dir):
    out = (B.spine(spark, sf_dir).join(daily.reporting_daily(B.reporting(spark, sf_dir)), KEYS, "left")
           .join(daily.srpe_daily(B.srpe(spark, sf_dir)), KEYS, "left"))
    return M.apply_defaults(out).select(*KEYS, "n_reporting_rows", "fluids_glasses", "srpe_n_sessions")


@query("source_absent_flag", B.with_views("""
    big AS (SELECT DISTINCT participant_id FROM ev WHERE value > 200)
    SELECT participant_id, date, (big.participant_id IS NULL)::INTEGER AS nonwear_is_upper_bound
    FROM spine LEFT JOIN big USING (participant_id)""", "spine"))
def source_absent_flag(spark, sf_dir):
    strong = B.events(spark, sf_dir).where(F.col("value") > 200)
    return M.source_absent_flag(B.spine(spark, sf_dir), strong)


@query("column_coverage", B.with_views(WEIGHT_SQL + f"""
    SELECT 'weight_raw' AS "column", {rnd('(count(weight_raw) / count(*)::DOUBLE)', 9)} AS coverage FROM day
    UNION ALL SELECT 'date', 1.0 FROM (SELECT 1)""", "spine", "reporting"))
def column_coverage(spark, sf_dir):
    out = M.coverage(weight_days(spark, sf_dir), ["date", "weight_raw"])
    return out.withColumn("coverage", F.round("coverage", 9))


@query("complete_cases", B.with_views("""
    SELECT fatigue, mood FROM wellness WHERE fatigue IS NOT NULL AND mood IS NOT NULL""", "wellness"))
def complete_cases(spark, sf_dir):
    return M.complete_cases(B.wellness(spark, sf_dir), ["fatigue", "sleep_quality", "mood"], 0.95)


@query("median_imputation", B.with_views("""
    SELECT seq, coalesce(sleep_quality, (SELECT median(sleep_quality) FROM wellness)) AS sleep_quality, stress FROM wellness""", "wellness"))
def median_imputation(spark, sf_dir):
    return M.median_impute(B.wellness(spark, sf_dir), ["sleep_quality", "stress"]).select("seq", "sleep_quality", "stress")


def feature_table(spark, sf_dir):
    return P.build_feature_table(B.sources(spark, sf_dir), B.participants(spark, sf_dir), B.START, B.END)


@query("daily_feature_table", B.with_views(LOAD_SQL.replace("day AS", "load_day AS") + f""",
    one AS (SELECT participant_id, metric, ts, d, arg_min(value, seq) AS value, count(*) AS n FROM minute GROUP BY 1, 2, 3, 4),
    act AS (SELECT participant_id, d AS date, sum(value) FILTER (metric = 'steps') AS steps, count(*) FILTER (metric = 'steps') AS cov,
        sum(n - 1) FILTER (metric IN ('steps', 'distance')) AS dup FROM one GROUP BY 1, 2),
    wel AS (SELECT participant_id, d AS date, count(*) AS n, arg_max_null(CASE WHEN readiness BETWEEN 1 AND 10 THEN readiness END, seq)
        AS ready FROM wellness GROUP BY 1, 2),
    rep AS (SELECT participant_id, d AS date, arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight_raw FROM reporting GROUP BY 1, 2),
    inj AS (SELECT participant_id, d AS date, max((foot IS NOT NULL)::INTEGER) AS hurt FROM injury GROUP BY 1, 2),
    j AS (SELECT participant_id, date, coalesce(steps, 0) AS total_steps, CAST(coalesce(cov, 0) AS INTEGER) AS steps_cov_min,
        CAST(coalesce(dup, 0) AS INTEGER) AS n_deduped_min, CAST(coalesce(wel.n, 0) AS INTEGER) AS n_wellness_rows,
        ready AS readiness_same_day, weight_raw, srpe_load, coalesce(hurt, 0) AS is_injured_day
        FROM spine LEFT JOIN act USING (participant_id, date) LEFT JOIN wel USING (participant_id, date)
        LEFT JOIN rep USING (participant_id, date) LEFT JOIN inj USING (participant_id, date)
        LEFT JOIN load_day USING (participant_id, date)),
    w AS (SELECT *, median(weight_raw) {W7} AS med, {rnd(f'(median(weight_raw) {W7})', 2)} AS med2,
        lead(readiness_same_day) OVER (PARTITION BY participant_id ORDER BY date) AS nxt,
        {rnd(f'(sum(srpe_load) {W7})', 1)} AS load_7d_sum, max(is_injured_day) {W7} AS injured_last_7d,
        {rnd(f'(avg((n_wellness_rows = 0)::INTEGER) {W7})', 6)} AS missing_ratio_wellness_7d,
        {rnd(f'(median(total_steps) {W7})', 6)} AS total_steps_median_7d FROM j),
    f AS (SELECT *, last_value(med2 IGNORE NULLS) OVER (PARTITION BY participant_id ORDER BY date
        ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS carried FROM w)
    SELECT participant_id, date, CAST(isodow(date) - 1 AS INTEGER) AS dow, nxt AS readiness_next_day, (nxt IS NOT NULL)::INTEGER
        AS label_available, readiness_same_day, total_steps, steps_cov_min, n_deduped_min, srpe_load, load_7d_sum, weight_raw,
        coalesce(med2, carried) AS weight_7d_median, {rnd('(weight_raw - med)', 2)} AS weight_residual,
        (med2 IS NULL AND carried IS NOT NULL)::INTEGER AS was_imputed_weight_7d_median, injured_last_7d, missing_ratio_wellness_7d,
        total_steps_median_7d FROM f""", "spine", "minute", "wellness", "reporting", "injury", "srpe", split=True))
def daily_feature_table(spark, sf_dir):
    out = feature_table(spark, sf_dir)
    six = ("missing_ratio_wellness_7d", "total_steps_median_7d")
    return out.select(*KEYS, "dow", "readiness_next_day", "label_available", "readiness_same_day", "total_steps", "steps_cov_min",
                      "n_deduped_min", "srpe_load", "load_7d_sum", "weight_raw", "weight_7d_median", "weight_residual",
                      "was_imputed_weight_7d_median", "injured_last_7d", *[F.round(c, 6).alias(c) for c in six])


# The whole table: the twins of the daily folds on the spine, zeros where true, then the trailing windows.
DAY_TWINS = ("activity_by_day", "exercise_by_day", "zones_by_day", "heart_rate_by_day", "resting_hr_by_day", "sleep_scores_by_day",
             "training_load_three_state", "reporting_by_day", "injury_by_day", "photo_counts_by_day", "injury_onehots", "submission_timing")
ACTS = ("individual", "running", "endurance", "strength", "team", "soccer", "walk", "bike")
FLAGS = ("inj_head_neck__minor", "inj_left_foot__major", "inj_left_foot__minor")
NIGHT_SQL = f"""n0 AS (SELECT *, sleep_type = 'classic' AS classic FROM night),
    n1 AS (SELECT participant_id, date, CAST(n_nights AS INTEGER) AS n_nights, CAST(n_naps AS INTEGER) AS n_naps,
        (n_nights > 0)::INTEGER AS has_sleep_record, CASE WHEN n_nights > 0 THEN classic::INTEGER END AS is_classic, asleep_min,
        time_in_bed_min, efficiency_pct, {", ".join(f"CASE WHEN NOT classic THEN {x}_min END AS {x}_min" for x in ("deep", "light", "rem"))},
        CASE WHEN classic THEN awake_min ELSE wake_min END AS wake_min,
        {rnd("(hour(start_ts) + minute(start_ts) / 60.0::DOUBLE + floor(second(start_ts)) / 3600.0::DOUBLE)", 2)} AS onset_hour,
        {rnd("(hour(end_ts) + minute(end_ts) / 60.0::DOUBLE + floor(second(end_ts)) / 3600.0::DOUBLE)", 2)} AS offset_hour FROM n0),
    n2 AS (SELECT *, CASE WHEN is_classic = 0 AND deep_min + light_min + rem_min + wake_min > 0 THEN deep_min + light_min + rem_min + wake_min END
        AS total, CASE WHEN offset_hour < onset_hour THEN ((offset_hour - onset_hour) % 24 + 24) % 24 ELSE (offset_hour - onset_hour) % 24 END
        AS length FROM n1),
    nights AS (SELECT * EXCLUDE (total, length), {", ".join(f"{rnd(f'(100 * {x}_min / total)', 2)} AS {x}_pct" for x in ("deep", "light", "rem", "wake"))},
        {rnd("((onset_hour + length / 2) % 24)", 2)} AS midsleep_hour FROM n2)"""
WEAR_SQL = f"""moving AS (SELECT participant_id, ts AS m FROM (SELECT participant_id, ts, arg_min(value, seq) AS v FROM minute
        WHERE metric = 'steps' GROUP BY 1, 2) WHERE v > 0),
    live AS (SELECT participant_id, date_trunc('minute', ts) AS m FROM hr WHERE confidence IS DISTINCT FROM 0 GROUP BY 1, 2
        HAVING NOT (count(*) >= 2 AND min(least(greatest(bpm, 30), 220)) = max(least(greatest(bpm, 30), 220)))),
    points AS (SELECT participant_id, CAST(m AS DATE) AS date, CAST(hour(m) * 60 + minute(m) AS INTEGER) AS p
            FROM (SELECT * FROM moving UNION SELECT * FROM live)
        UNION ALL SELECT participant_id, date, -1 FROM spine UNION ALL SELECT participant_id, date, 1440 FROM spine),
    holes AS (SELECT participant_id, date, lead(p) OVER (PARTITION BY participant_id, date ORDER BY p) - p - 1 AS g FROM points),
    wear AS (SELECT participant_id, date, CAST(coalesce(sum(g) FILTER (g >= 60), 0) AS BIGINT) AS nonwear_min FROM holes GROUP BY 1, 2)"""


def whole_table_sql() -> str:
    # The table folds bursts at the default gap.
    days = ", ".join(f"d{i} AS ({B.split_twin(ORACLE_SQL[name]).replace("INTERVAL 2 HOUR", "INTERVAL 15 SECOND")})" for i, name in enumerate(DAY_TWINS))
    joins = " ".join(f"LEFT JOIN {t} USING (participant_id, date)" for t in (*[f"d{i}" for i in range(len(DAY_TWINS))], "sr", "nights", "wear"))
    session = ", ".join(f"max(list_contains(activity_names, '{a}')::INTEGER) AS sr_{a}" for a in ACTS)
    acts = ", ".join(f"greatest(coalesce(ex_{a}, 0), coalesce(sr_{a}, 0)) AS act_{a}" for a in ACTS)
    raw = ", ".join(f"{p}_{a}" for p in ("ex", "sr") for a in ACTS)
    zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*M.ZERO_WHEN_ABSENT, *FLAGS) if c != "nutrition_kcal_available")
    ratios = {"wellness": "n_wellness_rows = 0", "weight": "weight_raw IS NULL", "zones": "zones_available = 0", "sleep": "n_nights = 0",
              "srpe": "srpe_n_sessions = 0"}
    missing = ", ".join(f"{rnd(f'avg(({gone})::INTEGER) {W7}', 6)} AS missing_ratio_{c}_7d" for c, gone in ratios.items())
    stats = ", ".join(f"{rnd(f'({f}({c}) {W7})', 6)} AS {c}_{n}_7d" for c in P.WINDOWED
                      for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp")))
    medians = ", ".join(f"{rnd(f'(median({c}_raw) {W7})', 2)} AS {c}_m, {rnd(f'({c}_raw - median({c}_raw) {W7})', 2)} AS {c}_residual"
                        for c in ("weight", "rhr"))
    carry = ", ".join(f"last_value({c}_m IGNORE NULLS) OVER (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND "
                      f"1 PRECEDING) AS {c}_c" for c in ("weight", "rhr"))
    filled = ", ".join(f"coalesce({c}_m, {c}_c) AS {c}_7d_median, ({c}_m IS NULL AND {c}_c IS NOT NULL)::INTEGER AS was_imputed_{c}_7d_median"
                       for c in ("weight", "rhr"))
    presence = ", ".join(f"(coalesce({src}, 0) > 0)::INTEGER AS {flag}" for flag, src in M.PRESENCE.items() if flag != src)
    return B.with_views(f"""{days}, {MAIN_NIGHT}, {NIGHT_SQL}, {WEAR_SQL},
    sr AS (SELECT participant_id, d AS date, {session} FROM srpe GROUP BY 1, 2),
    j AS (SELECT * EXCLUDE (srpe_load, srpe_minutes, {raw}) REPLACE ({zeros}), {acts},
        CASE WHEN srpe_n_sessions IS NULL THEN 0 ELSE srpe_load END AS srpe_load FROM spine {joins}),
    w AS (SELECT *, {medians}, {stats}, {missing}, {MONO} AS mono, sum(srpe_load) {W7} AS s7, avg(srpe_load) {W7} AS m7,
        avg(srpe_load) {W28} AS m28, max(is_injured_day) {W7} AS injured_last_7d,
        lead(readiness_same_day) OVER (PARTITION BY participant_id ORDER BY date) AS readiness_next_day FROM j),
    f AS (SELECT *, {carry} FROM w)
    SELECT * EXCLUDE (mono, s7, m7, m28, weight_m, rhr_m, weight_c, rhr_c), {filled}, {presence},
        {rnd('s7', 1)} AS load_7d_sum, {rnd('m7', 1)} AS load_7d_mean, {rnd('mono', 2)} AS monotony_7d, {rnd('(s7 * mono)', 1)} AS strain_7d,
        {rnd('(m7 / nullif(m28, 0))', 2)} AS acwr_7_28, CAST(isodow(date) - 1 AS INTEGER) AS dow, (isodow(date) >= 5)::INTEGER AS weekend_bin,
        (readiness_next_day IS NOT NULL)::INTEGER AS label_available, {rnd('(nonwear_min / 60::DOUBLE)', 2)} AS nonwear_hours,
        (nonwear_min > 0)::INTEGER AS has_nonwear,
        (participant_id NOT IN (SELECT participant_id FROM hr))::INTEGER AS nonwear_is_upper_bound,
        NULL::DOUBLE AS estimated_kcal, NULL::DOUBLE AS protein_g, NULL::DOUBLE AS carbs_g, NULL::DOUBLE AS fat_g,
        0 AS nutrition_kcal_available
    FROM f""", "spine", "minute", "hr", "sleep", "srpe", split=True)


@query("feature_table_all_columns", whole_table_sql())
def feature_table_all_columns(spark, sf_dir):
    """Every column; the trailing statistics with six decimals."""
    out = feature_table(spark, sf_dir)
    six = [c for c in out.columns if c.startswith("missing_ratio_") or c.endswith(("_mean_7d", "_median_7d", "_std_7d"))]
    return out.withColumns({c: F.round(c, 6) for c in six})


@query("feature_table_refreshed", whole_table_sql())
def feature_table_refreshed(spark, sf_dir):
    """Built without its last day and one day's questionnaires, then brought up to date."""
    now, people = B.sources(spark, sf_dir), B.participants(spark, sf_dir)
    late = F.to_date("ts") == F.lit("2024-01-11")
    store = refresh.FeatureStore(spark, scratch_dir(spark, "features"), FLAGS, 64)
    before = now | {"wellness": now["wellness"].where(~late)}
    store.update(before, people, B.START, "2024-01-29", refresh.added_days(people, B.START, "2024-01-29"))
    changed = refresh.dirty_days({"wellness": now["wellness"].where(late)})
    store.update(now, people, B.START, B.END, changed.unionByName(refresh.added_days(people, B.END, B.END)))
    out = store.table()
    six = [c for c in out.columns if c.startswith("missing_ratio_") or c.endswith(("_mean_7d", "_median_7d", "_std_7d"))]
    return out.withColumns({c: F.round(c, 6) for c in six})
