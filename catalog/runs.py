"""Gaps, bursts, runs, non-wear and components."""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.joins import PAIRS_SQL, pairs
from catalog.registry import ORACLE_SQL, query
from daygrain.operators import runs as R
from daygrain.streaming import live as L

rnd = B.rnd
BURST = 7200

BURST_SQL = f"""lagged AS (SELECT *, ts - lag(ts) OVER (PARTITION BY participant_id ORDER BY ts, event_id) AS gap FROM ev),
    grouped AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > to_seconds({BURST}) THEN 1 ELSE 0 END)
        OVER (PARTITION BY participant_id ORDER BY ts, event_id) AS BIGINT) AS burst FROM lagged)"""


@query("burst_groups", B.with_views(BURST_SQL + " SELECT event_id, participant_id, burst FROM grouped"))
def burst_groups(spark, sf_dir):
    return R.burst_groups(B.events(spark, sf_dir), ["participant_id"], "ts", "event_id", BURST).select(
        "event_id", "participant_id", "burst")


@query("burst_representatives", B.with_views(BURST_SQL + """
    SELECT participant_id, burst, arg_min(event_id, (ts, event_id)) AS representative, min(ts) AS first_ts, max(ts) AS last_ts,
        count(*) AS n_events FROM grouped GROUP BY 1, 2"""))
def burst_representatives(spark, sf_dir):
    groups = R.burst_groups(B.events(spark, sf_dir), ["participant_id"], "ts", "event_id", BURST)
    return R.burst_representatives(groups, ["participant_id"], "ts", "event_id")


@query("live_bursts", B.with_views(BURST_SQL + """,
    b AS (SELECT participant_id, arg_min(event_id, (ts, event_id)) AS representative, min(ts) AS first_ts, max(ts) AS last_ts,
        count(*) AS n_events FROM grouped GROUP BY participant_id, burst)
    SELECT * FROM b WHERE epoch_us(last_ts) + """ + f"{BURST * 1_000_000 + 1}" + """ <= (SELECT max(epoch_ms(ts)) FROM ev) * 1000 - 3600000000"""))
def live_bursts(spark, sf_dir):
    """The events as a stream: bursts that an hour of lateness has closed."""
    live = B.live_events(spark, sf_dir)
    return L.run_to_end(L.live_bursts(live, ["participant_id"], "ts", "event_id", BURST))


@query("live_activity", B.with_views("""
    one AS (SELECT participant_id, metric, ts, d, arg_min(value, seq) AS value FROM minute GROUP BY 1, 2, 3, 4)
    SELECT participant_id, d AS date, coalesce(sum(value) FILTER (metric = 'steps'), 0) AS total_steps,
        CAST(count(*) FILTER (metric = 'steps') AS INTEGER) AS steps_cov_min, coalesce(sum(value) FILTER (metric = 'calories'), 0) AS total_kcal
    FROM one GROUP BY 1, 2 HAVING epoch_ms(CAST(d AS TIMESTAMP)) + 86400000 <= (SELECT max(epoch_ms(ts)) FROM minute) - 3600000""", "minute"))
def live_activity(spark, sf_dir):
    """The minutes as a stream: days that an hour of lateness has closed."""
    live = B.live_events(spark, sf_dir).select(
        "participant_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.expr("CASE k % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'distance' ELSE 'calories' END").alias("metric"),
        F.expr("CAST(floor(value * 10) AS DOUBLE)").alias("value"), F.col("event_id").alias("seq"))
    return L.run_to_end(L.live_activity(live)).select("participant_id", "date", "total_steps", "steps_cov_min", "total_kcal")


# Pairs are confirmed when both events have the same parity of k.
CONFIRMED_SQL = PAIRS_SQL + """, confirmed AS (SELECT p.*, (a.k + b.k) % 2 = 0 AS same_meal FROM pairs p
    JOIN ev a ON a.event_id = event_id_1 JOIN ev b ON b.event_id = event_id_2)"""


def confirmed(spark, sf_dir):
    ks = B.events(spark, sf_dir).select("event_id", "k")
    a, b = (ks.withColumnsRenamed({"event_id": f"event_id_{i}", "k": f"k{i}"}) for i in (1, 2))
    return pairs(spark, sf_dir).join(a, "event_id_1").join(b, "event_id_2").withColumn(
        "same_meal", (F.col("k1") + F.col("k2")) % 2 == 0)


@query("confirmed_components", B.with_views(CONFIRMED_SQL + """,
    edges AS (SELECT event_id_1 AS a, event_id_2 AS b FROM confirmed WHERE same_meal
              UNION ALL SELECT event_id_2, event_id_1 FROM confirmed WHERE same_meal),
    reach AS (SELECT event_id AS node, event_id AS root FROM ev
              UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node AND r.root < e.b)
    SELECT node, min(root) AS component FROM reach GROUP BY 1""").replace("WITH ev", "WITH RECURSIVE ev", 1))
def confirmed_components(spark, sf_dir):
    edges = confirmed(spark, sf_dir).where("same_meal").select(
        F.col("event_id_1").alias("src"), F.col("event_id_2").alias("dst"))
    return R.components(edges, B.events(spark, sf_dir).select(F.col("event_id").alias("node")))


def dense_hr(spark, sf_dir):
    """Few levels on an hourly clock, so that minutes hold equal samples."""
    ev = B.events(spark, sf_dir)
    return ev.select("participant_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
                     (F.col("k") % 3 + 60).cast("double").alias("bpm"))


@query("hr_minute_state", B.with_views("""
    SELECT participant_id, date_trunc('hour', ts) AS minute, count(*) AS n_samples,
        CASE WHEN count(*) >= 2 AND stddev_samp(60 + k % 3) = 0 THEN 'flat' ELSE 'live' END AS state FROM ev GROUP BY 1, 2"""))
def hr_minute_state(spark, sf_dir):
    return R.hr_minute_state(dense_hr(spark, sf_dir))


WORN_SQL = """moving AS (SELECT participant_id, date_trunc('minute', ts) AS m FROM ev WHERE floor(value / 20) > 0),
    live AS (SELECT participant_id, date_trunc('minute', ts) AS m FROM ev GROUP BY 1, 2
             HAVING NOT (count(*) >= 2 AND min(value) = max(value))),
    worn AS (SELECT * FROM moving UNION SELECT * FROM live)"""


def wear_sources(spark, sf_dir):
    ev = B.events(spark, sf_dir)
    steps = ev.select("participant_id", "ts", F.floor(F.col("value") / 20).alias("value"))
    hr = ev.select("participant_id", "ts", F.col("value").alias("bpm"))
    return steps, hr


@query("nonwear_by_day", B.with_views(WORN_SQL + """,
    pts AS (SELECT participant_id, CAST(m AS DATE) AS date, CAST(hour(m) * 60 + minute(m) AS INTEGER) AS p FROM worn
        UNION ALL SELECT participant_id, date, -1 FROM spine UNION ALL SELECT participant_id, date, 1440 FROM spine),
    gaps AS (SELECT participant_id, date, lead(p) OVER (PARTITION BY participant_id, date ORDER BY p) - p - 1 AS g FROM pts),
    s AS (SELECT participant_id, date, CAST(coalesce(sum(g) FILTER (g >= 60), 0) AS BIGINT) AS nonwear_min FROM gaps GROUP BY 1, 2)
    SELECT *, """ + rnd("(nonwear_min / 60::DOUBLE)", 2) + """ AS nonwear_hours, (nonwear_min > 0)::INTEGER AS has_nonwear FROM s""",
    "spine"))
def nonwear_by_day(spark, sf_dir):
    return R.nonwear_daily(*wear_sources(spark, sf_dir), B.spine(spark, sf_dir))


HORIZON_SQL = WORN_SQL + """,
    pts AS (SELECT participant_id, CAST(date_diff('minute', TIMESTAMP '2024-01-01', m) AS BIGINT) AS p FROM worn
        UNION ALL SELECT participant_id, -1 FROM people UNION ALL SELECT participant_id, 43200 FROM people),
    gaps AS (SELECT participant_id, p + 1 AS a, lead(p) OVER (PARTITION BY participant_id ORDER BY p) - 1 AS b FROM pts),
    long AS (SELECT *, b - a + 1 AS n_min FROM gaps WHERE b - a + 1 >= 60),
    split AS (SELECT participant_id, a, b, unnest(range(a // 1440, b // 1440 + 1)) AS day FROM long)"""


@query("nonwear_runs", B.with_views(HORIZON_SQL + """
    SELECT participant_id, a AS run_from, b AS run_to, n_min FROM long""", "people"))
def nonwear_runs(spark, sf_dir):
    out = R.nonwear_runs(*wear_sources(spark, sf_dir), B.participants(spark, sf_dir), B.START, B.END)
    return out.select("participant_id", F.col("_from").alias("run_from"), F.col("_to").alias("run_to"), "n_min")


@query("nonwear_over_horizon", B.with_views(HORIZON_SQL + f""",
    s AS (SELECT participant_id, DATE '2024-01-01' + CAST(day AS INTEGER) AS date,
          CAST(sum(least(b, day * 1440 + 1439) - greatest(a, day * 1440) + 1) AS BIGINT) AS nonwear_min FROM split GROUP BY 1, 2)
    SELECT *, {rnd("(nonwear_min / 60::DOUBLE)", 2)} AS nonwear_hours FROM s""", "people"))
def nonwear_over_horizon(spark, sf_dir):
    return R.nonwear_horizon(*wear_sources(spark, sf_dir), B.participants(spark, sf_dir), B.START, B.END)


GAPS_SQL = """gaps AS (SELECT * FROM (SELECT participant_id, event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER
    (PARTITION BY participant_id ORDER BY ts, event_id))) / 1e6 AS gap_s FROM ev) WHERE gap_s IS NOT NULL)"""


@query("event_gaps", B.with_views(GAPS_SQL + " SELECT participant_id, event_id, gap_s FROM gaps"))
def event_gaps(spark, sf_dir):
    return R.gaps(B.events(spark, sf_dir), ["participant_id"], "ts", "event_id").select("participant_id", "event_id", "gap_s")


@query("gap_profile", B.with_views(GAPS_SQL + f"""
    SELECT participant_id, count(*) AS n_gaps, {rnd('100 * avg((gap_s <= 1800)::INTEGER)', 1)} AS pct_le_30min,
        {rnd('100 * avg((gap_s <= 3600)::INTEGER)', 1)} AS pct_le_60min, {rnd('100 * avg((gap_s > 21600)::INTEGER)', 1)} AS pct_gt_6h,
        {rnd('quantile_cont(gap_s, 0.5) / 3600', 2)} AS median_interval_h, {rnd('quantile_cont(gap_s, 0.25) / 3600', 2)} AS p25_interval_h,
        {rnd('quantile_cont(gap_s, 0.75) / 3600', 2)} AS p75_interval_h FROM gaps GROUP BY 1"""))
def gap_profile(spark, sf_dir):
    return R.gap_profile(R.gaps(B.events(spark, sf_dir), ["participant_id"], "ts", "event_id"), ["participant_id"])


@query("pair_threshold_sweep", B.with_views(CONFIRMED_SQL + f"""
    SELECT CAST(t AS INTEGER) AS threshold_s, count(*) FILTER (gap_s <= t) AS n_pairs,
        count(*) FILTER (gap_s <= t AND same_meal) AS n_confirmed,
        {rnd('100 * (count(*) FILTER (gap_s <= t AND same_meal)) / nullif(count(*) FILTER (gap_s <= t), 0)::DOUBLE', 1)} AS confirm_rate_pct
    FROM confirmed, (SELECT unnest([15, 60, 120, 300, 1800]) AS t) GROUP BY t"""))
def pair_threshold_sweep(spark, sf_dir):
    return R.threshold_sweep(confirmed(spark, sf_dir))


SWEEP_TWIN = ORACLE_SQL["pair_threshold_sweep"]


@query("pair_sweep_without_pairs", SWEEP_TWIN)
def pair_sweep_without_pairs(spark, sf_dir):
    """Two events agree where their k are both even or both odd."""
    return R.pair_sweep(B.events(spark, sf_dir), "participant_id", "ts", F.col("k") % 2)


@query("pair_sweep_by_participant", B.with_views(CONFIRMED_SQL + """
    SELECT participant_id, CAST(t AS INTEGER) AS threshold_s, count(*) FILTER (gap_s <= t) AS n_pairs,
        count(*) FILTER (gap_s <= t AND same_meal) AS n_confirmed FROM (SELECT participant_id FROM people)
        CROSS JOIN (SELECT unnest([15, 1800]) AS t) LEFT JOIN confirmed USING (participant_id) GROUP BY 1, 2""", "people"))
def pair_sweep_by_participant(spark, sf_dir):
    return R.pair_sweep(B.events(spark, sf_dir), "participant_id", "ts", F.col("k") % 2, [15, 1800], ["participant_id"]).drop("confirm_rate_pct")


@query("pair_threshold_by_participant", B.with_views(CONFIRMED_SQL + """
    SELECT participant_id, CAST(t AS INTEGER) AS threshold_s, count(*) FILTER (gap_s <= t) AS n_pairs,
        count(*) FILTER (gap_s <= t AND same_meal) AS n_confirmed FROM confirmed, (SELECT unnest([15, 1800]) AS t) GROUP BY 1, 2"""))
def pair_threshold_by_participant(spark, sf_dir):
    return R.threshold_sweep(confirmed(spark, sf_dir), [15, 1800], ["participant_id"]).drop("confirm_rate_pct")


@query("median_gap_by_verdict", B.with_views(CONFIRMED_SQL + f"""
    SELECT same_meal, {rnd('quantile_cont(gap_s, 0.5)', 6)} AS median_gap_s FROM confirmed GROUP BY 1"""))
def median_gap_by_verdict(spark, sf_dir):
    return R.median_gap_by_verdict(confirmed(spark, sf_dir)).withColumn("median_gap_s", F.round("median_gap_s", 6))


@query("run_length_encoding", B.with_views("""
    f AS (SELECT *, value > 50 AS flag, row_number() OVER (PARTITION BY participant_id ORDER BY ts, event_id) AS r,
          row_number() OVER (PARTITION BY participant_id, value > 50 ORDER BY ts, event_id) AS q FROM ev),
    g AS (SELECT participant_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n_rows FROM f WHERE flag GROUP BY participant_id, r - q)
    SELECT participant_id, CAST(row_number() OVER (PARTITION BY participant_id ORDER BY run_start) AS BIGINT) AS run, run_start, run_end,
        n_rows FROM g"""))
def run_length_encoding(spark, sf_dir):
    flagged = B.events(spark, sf_dir).withColumn("flag", F.col("value") > 50)
    return R.runs(flagged, ["participant_id"], "ts", "event_id", "flag")
