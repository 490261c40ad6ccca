"""Date and time functions over every event."""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.registry import query
from daygrain.functions import dates as D
from daygrain.operators.joins import day_spine, minute_grid

RAW_TEXT = """CASE k % 8 WHEN 0 THEN date_format(ts, 'dd/MM/yy HH:mm:ss')
    WHEN 1 THEN date_format(ts, 'd/M/yyyy HH:mm:ss') WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    WHEN 3 THEN date_format(ts, 'yyyy:MM:dd HH:mm:ss') WHEN 4 THEN date_format(ts, 'dd/MM/yyyy')
    WHEN 5 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '+02:00')
    WHEN 6 THEN 'november' ELSE '' END"""


@query("standardize_timestamps", B.with_views("""
    SELECT event_id, CASE k % 8
        WHEN 0 THEN strptime(strftime(ts, '%d/%m/%y %H:%M:%S'), '%d/%m/%y %H:%M:%S')
        WHEN 1 THEN strptime(strftime(ts, '%-d/%-m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S')
        WHEN 2 THEN date_trunc('millisecond', ts)
        WHEN 3 THEN strptime(strftime(ts, '%Y:%m:%d %H:%M:%S'), '%Y:%m:%d %H:%M:%S')
        WHEN 4 THEN strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y')
        WHEN 5 THEN date_trunc('millisecond', ts) ELSE NULL END AS parsed,
        strptime(strftime(ts, '%Y-%d-%m %H:%M:%S'), '%Y-%d-%m %H:%M:%S') AS parsed_by_format
    FROM ev"""))
def standardize_timestamps(spark, sf_dir):
    raw = B.events(spark, sf_dir).select("event_id", F.expr(RAW_TEXT).alias("raw"),
                                         F.date_format("ts", "yyyy-dd-MM HH:mm:ss").alias("swapped"))
    return raw.select("event_id", D.std_ts("raw").alias("parsed"),
                      D.std_ts("swapped", "yyyy-dd-MM HH:mm:ss").alias("parsed_by_format"))


RARE_TEXT = """CASE k % 10 WHEN 0 THEN date_format(ts, 'MMM d yyyy HH:mm:ss') WHEN 1 THEN date_format(ts, 'EEEE, d MMMM yyyy')
    WHEN 2 THEN date_format(ts, 'M.d.yyyy HH:mm') WHEN 3 THEN date_format(ts, 'yyyyMMdd') WHEN 4 THEN date_format(ts, "yyyyMMdd'T'HHmmss")
    WHEN 5 THEN date_format(ts, 'dd-MMM-yy') WHEN 6 THEN date_format(ts, 'yyyy.MM.dd h:mm a') WHEN 7 THEN concat('31.', date_format(ts, 'MM.yyyy'))
    WHEN 8 THEN date_format(ts, 'MMM yyyy') ELSE concat(date_format(ts, 'd/M/yyyy'), ', ', date_format(ts, 'HH:mm')) END"""


@query("standardize_rare_dates", B.with_views("""
    SELECT event_id, CASE k % 10 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(d AS TIMESTAMP) WHEN 2 THEN date_trunc('minute', ts)
        WHEN 3 THEN CAST(d AS TIMESTAMP) WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN CAST(d AS TIMESTAMP)
        WHEN 6 THEN date_trunc('minute', ts) WHEN 7 THEN try_strptime('31.' || strftime(ts, '%m.%Y'), '%d.%m.%Y')
        WHEN 8 THEN NULL ELSE date_trunc('minute', ts) END AS parsed FROM ev"""))
def standardize_rare_dates(spark, sf_dir):
    """Month names, dots, digits without separators, 12-hour clocks; a date without a day is not read."""
    return B.events(spark, sf_dir).select("event_id", D.std_ts(F.expr(RARE_TEXT)).alias("parsed"))


@query("canonical_timestamp_text", B.with_views("""
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text, strftime(ts, '%Y-%m-%d') AS day_text FROM ev"""))
def canonical_timestamp_text(spark, sf_dir):
    return B.events(spark, sf_dir).select("event_id", D.std_text("ts").alias("ts_text"),
                                          F.substring(D.std_text("ts"), 1, 10).alias("day_text"))


@query("date_only_detection", B.with_views("""
    SELECT event_id, k % 8 = 4 AS date_only, true AS iso_date_only FROM ev"""))
def date_only_detection(spark, sf_dir):
    raw = B.events(spark, sf_dir).select("event_id", F.expr(RAW_TEXT).alias("raw"),
                                         F.date_format("ts", "yyyy-MM-dd").alias("iso"))
    return raw.select("event_id", D.is_date_only("raw").alias("date_only"), D.is_date_only("iso").alias("iso_date_only"))


@query("window_bound_resolution", B.with_views("""
    SELECT event_id, CASE k % 2 WHEN 0 THEN CAST(d AS TIMESTAMP) ELSE date_trunc('second', ts) END AS lower,
        CASE k % 3 WHEN 0 THEN CAST(d AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59.999 seconds'
            WHEN 1 THEN CAST(d AS TIMESTAMP) + INTERVAL '2 days 23 hours 59 minutes 59.999 seconds'
            ELSE date_trunc('second', ts) + INTERVAL 5 DAY END AS upper, k % 3 <> 2 AS inclusive FROM ev"""))
def window_bound_resolution(spark, sf_dir):
    asked = B.events(spark, sf_dir).select("event_id", F.expr("""
        CASE k % 2 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END""").alias("start"),
        F.expr("""CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN date_format(ts + INTERVAL 2 DAY, 'dd/MM/yyyy')
                  ELSE date_format(ts + INTERVAL 5 DAY, 'yyyy-MM-dd HH:mm:ss') END""").alias("end"))
    return asked.select("event_id", *D.bound_columns("start", "end"))


@query("window_filter", B.with_views("""
    SELECT event_id, participant_id, ts FROM ev
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-20 23:59:59.999'"""))
def window_filter(spark, sf_dir):
    bounds = D.window_bounds("2024-01-05 06:00:00", "20/01/2024")
    return (B.table(spark, sf_dir, "events").where(D.in_window("ts", bounds))
            .select("event_id", F.col("user_id").alias("participant_id"), F.col("ts").cast("timestamp_ntz").alias("ts")))


@query("window_filter_exclusive_end", B.with_views("""
    SELECT participant_id, count(*) AS n FROM ev
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1"""))
def window_filter_exclusive_end(spark, sf_dir):
    bounds = D.window_bounds("2024-01-05", "2024-01-20 12:00:00")
    return B.events(spark, sf_dir).where(D.in_window("ts", bounds)).groupBy("participant_id").agg(
        F.count("*").alias("n"))


@query("day_key", B.with_views("SELECT event_id, d AS day, date_trunc('minute', ts) AS minute FROM ev"))
def day_key(spark, sf_dir):
    return B.events(spark, sf_dir).select("event_id", D.day("ts").alias("day"), D.minute("ts").alias("minute"))


@query("day_spine", B.with_views("SELECT participant_id, date FROM spine", "spine"))
def spine_days(spark, sf_dir):
    return B.spine(spark, sf_dir)


@query("own_span_spine", B.with_views("""
    spans AS (SELECT o_custkey AS participant_id, min(CAST(o_orderdate AS DATE)) AS a,
              max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)
    SELECT participant_id, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day
    FROM (SELECT participant_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM spans) GROUP BY 1"""))
def own_span_spine(spark, sf_dir):
    spans = (B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("participant_id"))
             .agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")))
    days = day_spine(spans, F.col("a"), F.col("b"))
    return days.groupBy("participant_id").agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"),
                                              F.max("date").alias("last_day"))


@query("minute_grid", B.with_views("""
    days AS (SELECT DISTINCT d AS date FROM ev)
    SELECT date, CAST(date AS TIMESTAMP) + to_minutes(CAST(m AS INTEGER)) AS minute FROM days, range(1440) t(m)"""))
def grid_of_minutes(spark, sf_dir):
    return minute_grid(B.events(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct())


@query("calendar_features", B.with_views("""
    SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(isodow(ts) >= 5 AS INTEGER) AS weekend_bin,
        dayname(ts) AS day_name FROM ev"""))
def calendar_features(spark, sf_dir):
    return B.events(spark, sf_dir).select("event_id", D.dow("ts").alias("dow"), D.weekend_bin("ts").alias("weekend_bin"),
                                          D.day_name("ts").alias("day_name"))


def hours_sql(ts):
    return B.rnd(f"(hour({ts}) + minute({ts}) / 60.0::DOUBLE + second({ts}) / 3600.0::DOUBLE)", 2)


@query("hour_of_day", B.with_views(f"SELECT event_id, {hours_sql('ts')} AS hour_of_day FROM ev"))
def hour_of_day(spark, sf_dir):
    return B.events(spark, sf_dir).select("event_id", D.hour_of_day("ts").alias("hour_of_day"))


@query("midsleep", B.with_views(f"""
    h AS (SELECT log_id, {hours_sql('start_ts')} AS a, {hours_sql('end_ts')} AS b FROM sleep),
    g AS (SELECT log_id, a, CASE WHEN (b - a) % 24 < 0 THEN ((b - a) % 24 + 24) % 24 ELSE (b - a) % 24 END AS len FROM h)
    SELECT log_id, {B.rnd('((a + len / 2) % 24)', 2)} AS midsleep_hour FROM g""", "sleep"))
def midsleep(spark, sf_dir):
    return B.sleep(spark, sf_dir).select("log_id", D.midsleep(
        D.hour_of_day("start_ts"), D.hour_of_day("end_ts")).alias("midsleep_hour"))


@query("recall_lag", B.with_views("""
    SELECT seq, """ + B.rnd("((epoch_us(submitted_ts) - epoch_us(ts)) / 1e6::DOUBLE / 86400.0::DOUBLE)", 2)
    + " AS lag_days FROM reporting", "reporting"))
def recall_lag(spark, sf_dir):
    return B.reporting(spark, sf_dir).select("seq", D.lag_days("ts", "submitted_ts").alias("lag_days"))
