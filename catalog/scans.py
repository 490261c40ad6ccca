"""Source scans and sinks: the events are exported raw, then read back.

The export goes to the shared folder of the session (``spark.checkpoint.dir``)
and is the whole table, so the scans see as much as the table holds.
"""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.aggregates import MACRO_KEYS_SQL
from catalog.registry import query
from daygrain.functions import dates as D
from daygrain.operators import daily
from daygrain.session import scratch_dir
from daygrain.sources import dictionary, readers as R, sinks
from daygrain.sources.estimates import EstimateStore

RAW_VALUE = "CASE k % 9 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(value AS STRING) END"


def scratch(spark) -> str:
    """A new folder below the shared one."""
    return scratch_dir(spark, "export")


def export(df, file: str) -> str:
    """Write one combined source (JSON lines or CSV) and return its root."""
    root = scratch(df.sparkSession)
    writer = df.write.mode("errorifexists")
    if file.endswith(".json"):
        writer.json(f"{root}/{file}")
    else:
        (writer.option("header", True).option("escape", '"').option("nullValue", None)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{file}"))
    return root


def raw_events(spark, sf_dir):
    ev = B.events(spark, sf_dir)
    return ev.withColumn("participant_id", F.col("participant_id").cast("string"))


PID = "CAST(participant_id AS VARCHAR) AS participant_id"


def minute_export(spark, sf_dir):
    stamp = F.expr("CASE k % 2 WHEN 0 THEN date_format(ts, 'dd/MM/yy HH:mm:ss') ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END")
    return export(raw_events(spark, sf_dir).select("participant_id", stamp.alias("dateTime"), F.expr(RAW_VALUE).alias("value")),
                  "steps.json")


@query("scan_minutes", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, 'steps' AS metric, value FROM ev WHERE k % 9 > 1"""))
def scan_minutes(spark, sf_dir):
    return R.read_minute(spark, minute_export(spark, sf_dir), "steps").drop("seq")


@query("scan_minutes_in_window", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, value FROM ev WHERE k % 9 > 1 AND d BETWEEN '2024-01-10' AND '2024-01-12'"""))
def scan_minutes_in_window(spark, sf_dir):
    bounds = D.window_bounds("2024-01-10", "2024-01-12")
    return R.read_minute(spark, minute_export(spark, sf_dir), "steps", bounds).drop("seq", "metric")


def export_arrays(df, order: str, file: str) -> str:
    """Write a tree of files that are one JSON array each, a person's records in one of them in the given order; returns its root."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = df.select(F.pmod(F.xxhash64("participant_id"), F.lit(n)).alias("shard"), F.col(order).cast("long").alias("place"),
                        F.concat(F.lit(","), F.to_json(F.struct(*[c for c in df.columns if c != order]))).alias("value"))
    # An array opens with an empty record, so that every other record follows a comma.
    shards = spark.range(n)
    ends = shards.select("id", F.lit(-1).alias("place"), F.lit("[{}").alias("value")).unionAll(
        shards.select("id", F.lit((1 << 63) - 1), F.lit("]")))
    root = scratch(spark)
    (records.unionAll(ends).repartition(n, "shard").sortWithinPartitions("shard", "place").select("shard", "value")
     .write.partitionBy("shard").text(f"{root}/people/watch/{file}"))
    return root


def minute_arrays(spark, sf_dir):
    stamp = F.expr("CASE k % 2 WHEN 0 THEN date_format(ts, 'dd/MM/yy HH:mm:ss') ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END")
    return export_arrays(raw_events(spark, sf_dir).select("event_id", "participant_id", stamp.alias("dateTime"),
                                                          F.expr(RAW_VALUE).alias("value")), "event_id", "steps.json")


@query("scan_minute_arrays", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, 'steps' AS metric, value FROM ev WHERE k % 9 > 1"""))
def scan_minute_arrays(spark, sf_dir):
    return R.read_minute(spark, minute_arrays(spark, sf_dir), "steps").drop("seq")


@query("scan_minute_arrays_in_window", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, value FROM ev WHERE k % 9 > 1 AND d BETWEEN '2024-01-10' AND '2024-01-12'"""))
def scan_minute_arrays_in_window(spark, sf_dir):
    bounds = D.window_bounds("2024-01-10", "2024-01-12")
    return R.read_minute(spark, minute_arrays(spark, sf_dir), "steps", bounds).drop("seq", "metric")


@query("scan_absent_source", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, 0 AS n_distance, count(*) AS n_steps FROM ev WHERE k % 9 > 1 GROUP BY 1"""))
def scan_absent_source(spark, sf_dir):
    root = minute_export(spark, sf_dir)
    steps = R.read_minute(spark, root, "steps").groupBy("participant_id").agg(F.count("*").alias("n_steps"))
    gone = R.read_minute(spark, root, "distance").groupBy("participant_id").agg(F.count("*").alias("n"))
    return steps.join(gone, "participant_id", "left").select(
        "participant_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_distance"), "n_steps")


@query("scan_heart_rate", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, CAST(floor(value) + 20 AS DOUBLE) AS bpm,
        CASE WHEN k % 7 = 0 THEN NULL ELSE k % 4 END AS confidence FROM ev"""))
def scan_heart_rate(spark, sf_dir):
    raw = raw_events(spark, sf_dir).select(
        "participant_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dateTime"),
        F.expr("named_struct('bpm', CAST(floor(value) + 20 AS BIGINT), 'confidence', CASE WHEN k % 7 = 0 THEN NULL ELSE k % 4 END)")
        .alias("value"))
    return R.read_hr(spark, export(raw, "heart_rate.json")).drop("seq")


@query("scan_heart_rate_arrays", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, arg_max(CAST(floor(value) + 20 AS DOUBLE), event_id) AS bpm,
        CAST(arg_max(k % 4, event_id) AS INTEGER) AS confidence FROM ev GROUP BY participant_id, date_trunc('second', ts)"""))
def scan_heart_rate_arrays(spark, sf_dir):
    """Nested records with braces and quotes in their strings, the last record of a stamp wins."""
    raw = raw_events(spark, sf_dir).select(
        "event_id", "participant_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dateTime"),
        F.expr("""named_struct('note', '},{ \\" [', 'bpm', CAST(floor(value) + 20 AS BIGINT), 'confidence', k % 4)""").alias("value"))
    return R.read_hr(spark, export_arrays(raw, "event_id", "heart_rate.json")).drop("seq")


@query("scan_resting_hr", B.with_views(f"""
    SELECT {PID}, date_trunc('second', ts) AS ts, CASE WHEN k % 5 = 0 THEN NULL ELSE strftime(ts, '%m/%d/%y') END AS rhr_date,
        CASE WHEN k % 6 = 0 THEN 0 ELSE value END AS value FROM ev"""))
def scan_resting_hr(spark, sf_dir):
    raw = raw_events(spark, sf_dir).select(
        "participant_id", F.date_format("ts", "dd/MM/yy HH:mm:ss").alias("dateTime"),
        F.expr("""named_struct('date', CASE WHEN k % 5 = 0 THEN NULL ELSE date_format(ts, 'MM/dd/yy') END,
                  'value', CASE WHEN k % 6 = 0 THEN 0D ELSE value END, 'error', 1.5D)""").alias("value"))
    return R.read_rhr(spark, export(raw, "resting_heart_rate.json")).drop("seq", "error")


@query("scan_zone_minutes", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, date_trunc('second', ts) AS ts, z0, z1, z2, z3 FROM zones""", "zones"))
def scan_zone_minutes(spark, sf_dir):
    raw = B.zones(spark, sf_dir).select(
        F.col("participant_id").cast("string").alias("participant_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dateTime"),
        F.struct(F.col("zones").alias("valuesInZones")).alias("value"))
    from daygrain.functions.encoding import ZONE_KEYS
    out = R.read_zones(spark, export(raw, "time_in_heart_rate_zones.json"))
    return out.select("participant_id", "ts", *[F.try_element_at("zones", F.lit(z)).alias(f"z{i}") for i, z in enumerate(ZONE_KEYS)])


@query("scan_sleep", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, log_id, date_trunc('millisecond', start_ts) AS start_ts,
        date_trunc('millisecond', end_ts) AS end_ts, asleep_min, sleep_type, main_sleep,
        CASE WHEN sleep_type = 'classic' THEN NULL ELSE deep_min END AS deep_min, has_level_data FROM sleep""", "sleep"))
def scan_sleep(spark, sf_dir):
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    raw = B.sleep(spark, sf_dir).select(
        F.col("participant_id").cast("string").alias("participant_id"), F.col("log_id").alias("logId"),
        F.col("date_of_sleep").alias("dateOfSleep"), F.date_format("start_ts", stamp).alias("startTime"),
        F.date_format("end_ts", stamp).alias("endTime"), F.col("asleep_min").alias("minutesAsleep"),
        F.col("sleep_type").alias("type"), F.when(~F.col("main_sleep"), F.lit(False)).alias("mainSleep"),
        F.expr("""named_struct('summary', CASE WHEN sleep_type = 'classic'
            THEN map('awake', named_struct('minutes', awake_min)) ELSE map('deep', named_struct('minutes', deep_min)) END,
            'data', CASE WHEN has_level_data THEN array(named_struct('level', 'deep')) ELSE NULL END)""").alias("levels"))
    return R.read_sleep(spark, export(raw, "sleep.json")).select(
        "participant_id", "log_id", "start_ts", "end_ts", "asleep_min", "sleep_type", "main_sleep", "deep_min", "has_level_data")


@query("scan_exercise", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, log_id, activity_name, date_trunc('second', start_ts) AS start_ts,
        active_ms, duration_ms FROM exercise""", "exercise"))
def scan_exercise(spark, sf_dir):
    raw = B.exercise(spark, sf_dir).select(
        F.col("participant_id").cast("string").alias("participant_id"), F.col("log_id").alias("logId"),
        F.col("activity_name").alias("activityName"), F.date_format("start_ts", "dd/MM/yyyy HH:mm:ss").alias("startTime"),
        F.col("active_ms").alias("activeDuration"), F.col("duration_ms").alias("duration"))
    return R.read_exercise(spark, export(raw, "exercise.json")).drop("seq")


@query("scan_sleep_score", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, date_trunc('second', ts) AS ts, overall_score, revitalization_score,
        restlessness FROM sleep_score""", "sleep_score"))
def scan_sleep_score(spark, sf_dir):
    raw = B.sleep_score(spark, sf_dir).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("ts", "seq")
    return R.read_sleep_score(spark, export(raw, "sleep_score.csv")).select(
        "participant_id", "ts", "overall_score", "revitalization_score", "restlessness")


@query("scan_wellness", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, date_trunc('millisecond', ts) AS ts, readiness, sleep_quality,
        soreness_area FROM wellness""", "wellness"))
def scan_wellness(spark, sf_dir):
    raw = B.wellness(spark, sf_dir).withColumn(
        "effective_time_frame", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).drop("ts", "seq")
    return R.read_wellness(spark, export(raw, "wellness.csv")).select(
        "participant_id", "ts", "readiness", "sleep_quality", "soreness_area")


@query("scan_absent_columns", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, date_trunc('second', ts) AS ts, mood, CAST(NULL AS DOUBLE) AS readiness,
        CAST(NULL AS VARCHAR) AS soreness_area FROM wellness""", "wellness"))
def scan_absent_columns(spark, sf_dir):
    raw = B.wellness(spark, sf_dir).select(
        "participant_id", "mood", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("effective_time_frame"))
    return R.read_wellness(spark, export(raw, "wellness.csv")).select("participant_id", "ts", "mood", "readiness", "soreness_area")


@query("scan_training_sessions", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, date_trunc('second', ts) AS ts,
        array_to_string(activity_names, ',') AS activity_names, rpe, duration_min FROM srpe""", "srpe"))
def scan_training_sessions(spark, sf_dir):
    names = F.concat(F.lit("['"), F.array_join("activity_names", "', '"), F.lit("']"))
    raw = B.srpe(spark, sf_dir).select(
        "participant_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("end_date_time"),
        F.when(F.size("activity_names") > 0, names).otherwise("[]").alias("activity_names"),
        F.col("rpe").alias("perceived_exertion"), "duration_min")
    return R.read_srpe(spark, export(raw, "srpe.csv")).withColumn("activity_names", F.array_join("activity_names", ",")).drop("seq")


@query("scan_injury_reports", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, date_trunc('millisecond', ts) AS ts, foot AS left_foot, head AS head_neck
    FROM injury""", "injury"))
def scan_injury_reports(spark, sf_dir):
    raw = raw_events(spark, sf_dir).select(
        "participant_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("effective_time_frame"),
        F.expr(B.INJURY_LITERAL).alias("injuries"))
    out = R.read_injury(spark, export(raw, "injury.csv"))
    return out.select("participant_id", "ts", F.try_element_at("injuries", F.lit("left_foot")).alias("left_foot"),
                      F.try_element_at("injuries", F.lit("head_neck")).alias("head_neck"))


@query("scan_self_reports", B.with_views("""
    SELECT CAST(participant_id AS VARCHAR) AS participant_id, ts, submitted_ts, meals, weight, glasses_of_fluid, alcohol_consumed
        FROM reporting""", "reporting"))
def scan_self_reports(spark, sf_dir):
    raw = B.reporting(spark, sf_dir).select(
        "participant_id", F.date_format("ts", "dd/MM/yyyy").alias("date"),
        F.date_format("submitted_ts", "dd/MM/yyyy HH:mm:ss").alias("timestamp"), "meals", "weight", "glasses_of_fluid",
        "alcohol_consumed")
    return R.read_reporting(spark, export(raw, "reporting.csv")).drop("seq")


@query("scan_participants", """
    SELECT CAST(c_custkey AS VARCHAR) AS participant_id, CAST(c_nationkey AS DOUBLE) AS age, lower(c_mktsegment) AS gender,
        CASE WHEN c_nationkey * 2 >= 20 THEN CAST(c_nationkey * 2 AS DOUBLE) END AS stride_run_cm FROM customer""")
def scan_participants(spark, sf_dir):
    raw = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Participant ID"), F.col("c_nationkey").alias("Age"),
        F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("Gender"), (F.col("c_nationkey") * 2).alias("Stride run"))
    root = export(raw, "participants.csv")
    return R.read_participants(spark, f"{root}/participants.csv").select("participant_id", "age", "gender", "stride_run_cm")


@query("scan_photo_events", B.with_views("""
    SELECT CAST(p.participant_id AS VARCHAR) AS participant_id, file, date_trunc('second', p.ts) AS ts, is_food
    FROM photos p JOIN (SELECT event_id, k FROM ev) e ON e.event_id = p.seq WHERE k % 11 <> 0""", "photos"))
def scan_photo_events(spark, sf_dir):
    ev = B.events(spark, sf_dir).select(F.col("event_id").alias("seq"), "k")
    raw = B.photos(spark, sf_dir).join(ev, "seq").select(
        "participant_id", "file", F.when(F.col("k") % 11 == 0, "unknown").otherwise(
            F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("datetime"), F.lower("is_food").alias("is_food"))
    return R.read_photos(spark, export(raw, "photos.csv")).drop("seq")


@query("landed_table_pruned_to_window", B.with_views("""
    SELECT participant_id, ts, metric, value, d AS date FROM minute WHERE ts >= TIMESTAMP '2024-01-09 06:00:00'
    AND ts < TIMESTAMP '2024-01-11 12:00:00'""", "minute"))
def landed_table_pruned_to_window(spark, sf_dir):
    path = f"{scratch(spark)}/minute"
    sinks.land(B.minute(spark, sf_dir), path)
    return R.read_landed(spark, path, D.window_bounds("2024-01-09 06:00:00", "2024-01-11 12:00:00")).drop("seq")


@query("dataset_sink_round_trip", B.with_views("""
    SELECT participant_id, d AS date, max((foot IS NOT NULL)::INTEGER) AS is_injured_day,
        CAST(count(*) AS INTEGER) AS n_injury_reports FROM injury GROUP BY 1, 2""", "injury"))
def dataset_sink_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}/dataset"
    day = daily.injury_daily(B.injury(spark, sf_dir))
    sinks.write_dataset(day, path, "csv")
    return spark.read.schema(day.schema).option("header", True).csv(path)


@query("audit_sink_round_trip", B.with_views("SELECT participant_id, count(*) AS n FROM injury GROUP BY 1", "injury"))
def audit_sink_round_trip(spark, sf_dir):
    folder = scratch(spark)
    counts = B.injury(spark, sf_dir).groupBy("participant_id").agg(F.count("*").alias("n"))
    sinks.write_audit(counts, folder, "injury_counts")
    return spark.read.schema(counts.schema).option("header", True).csv(f"{folder}/injury_counts")


@query("report_files", B.with_views("""
    SELECT participant_id, 1 AS window_id, count(*) AS n_reports FROM people GROUP BY 1""", "people"))
def report_files(spark, sf_dir):
    from catalog.aggregates import report
    from daygrain.plans.report import report_lines
    path = f"{scratch(spark)}/reports"
    sinks.write_reports(report_lines(report(spark, sf_dir)), path)
    written = spark.read.text(path)
    heads = written.where(F.col("value").startswith("# Daily report") & (F.col("window_id") == 1))
    return heads.groupBy(F.col("participant_id").cast("long").alias("participant_id"), "window_id").agg(
        F.count("*").alias("n_reports"))


@query("estimate_table_upsert", B.with_views(MACRO_KEYS_SQL + """
    SELECT cache_key, CASE WHEN day(date) >= 16 THEN 200.0::DOUBLE ELSE 100.0::DOUBLE END AS calories FROM keys""", "photos"))
def estimate_table_upsert(spark, sf_dir):
    keys = daily.day_estimate_keys(daily.photo_meals(B.photos(spark, sf_dir), seconds=7200))

    def estimates(rows, calories):
        return rows.select("cache_key", F.lit(calories).alias("calories"), F.lit(1.0).alias("protein"),
                           F.lit(1.0).alias("carbohydrates"), F.lit(1.0).alias("fats"))

    root = scratch(spark)
    empty = sinks.load_estimates(spark, f"{root}/none")
    sinks.save_estimates(sinks.upsert_estimates(empty, estimates(keys.where(F.dayofmonth("date") <= 20), 100.0)), f"{root}/v1")
    second = sinks.upsert_estimates(sinks.load_estimates(spark, f"{root}/v1"),
                                    estimates(keys.where(F.dayofmonth("date") >= 16), 200.0))
    return second.select("cache_key", "calories")


@query("estimate_versions", B.with_views(MACRO_KEYS_SQL + """
    SELECT 1 AS version, cache_key, 100.0::DOUBLE AS calories FROM keys WHERE day(date) <= 20
    UNION ALL SELECT 2, cache_key, CASE WHEN day(date) >= 16 THEN 200.0 + day(date) ELSE 100.0 END::DOUBLE FROM keys""", "photos"))
def estimate_versions(spark, sf_dir):
    """Two upserts of a bucketed store, each key of the second given twice; both versions stay readable."""
    keys = daily.day_estimate_keys(daily.photo_meals(B.photos(spark, sf_dir), seconds=7200))

    def estimates(rows, calories, at):
        one = F.lit(1.0)
        return rows.select("cache_key", calories.alias("calories"), one.alias("protein"), one.alias("carbohydrates"), one.alias("fats"),
                           F.lit(at).alias("at"))

    store = EstimateStore(spark, scratch(spark), sinks.ESTIMATE_SCHEMA, buckets=16)
    store.upsert(estimates(keys.where(F.dayofmonth("date") <= 20), F.lit(100.0), 0))
    late = keys.where(F.dayofmonth("date") >= 16)
    store.upsert(estimates(late, F.lit(900.0), 1).unionByName(estimates(late, F.lit(200.0) + F.dayofmonth("date"), 2)), ["at"])
    return store.load(1).select(F.lit(1).alias("version"), "cache_key", "calories").unionByName(
        store.load().select(F.lit(2).alias("version"), "cache_key", "calories"))


@query("data_dictionary", B.with_views("""
    c AS (SELECT count(DISTINCT (participant_id, d)) AS n FROM sleep)
    SELECT unnest(['participant_id', 'date', 'n_nights', 'n_naps', 'has_sleep_record']) AS "column",
        unnest(['key', 'key', 'sleep', 'sleep', 'coverage']) AS source, unnest([0, 0, 1, 1, 1]) AS used_in_x,
        unnest([n, n, n, n, n]) AS non_missing_rows FROM c""", "sleep"))
def data_dictionary(spark, sf_dir):
    day = daily.sleep_daily(B.sleep(spark, sf_dir)).select("participant_id", "date", "n_nights", "n_naps", "has_sleep_record")
    counts = dictionary.final_dictionary(day).select("column", "non_missing_rows")
    return dictionary.data_dictionary(day).join(counts, "column").select("column", "source", "used_in_x", "non_missing_rows")


@query("final_dictionary_counts", B.with_views("""
    w AS (SELECT participant_id, d AS date, count(*) AS n, arg_max_null(CASE WHEN readiness BETWEEN 1 AND 10 THEN readiness END, seq) AS r
          FROM wellness GROUP BY 1, 2)
    SELECT 'participant_id' AS "column", 'key' AS role, count(*) AS non_missing_rows FROM w
    UNION ALL SELECT 'date', 'key', count(*) FROM w UNION ALL SELECT 'n_wellness_rows', 'feature', count(*) FROM w
    UNION ALL SELECT 'readiness_same_day', 'feature', count(r) FROM w""", "wellness"))
def final_dictionary_counts(spark, sf_dir):
    day = daily.wellness_daily(B.wellness(spark, sf_dir)).select("participant_id", "date", "n_wellness_rows", "readiness_same_day")
    return dictionary.final_dictionary(day).select("column", "role", "non_missing_rows")
