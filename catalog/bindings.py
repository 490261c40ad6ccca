"""The given tables seen as the sources of the library.

``events`` is the sensor stream.  Each binding exists twice, as a DataFrame and
as a SQL view text, and both are plain projections of the whole table; only
where one job needs all sources at once (``sources``, ``split``) each source is
the events of one type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

START, END = "2024-01-01", "2024-01-30"
DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, participant_id, ts, event_type, value, k."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("participant_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as a stream of files."""
    stored = table(spark, sf_dir, "events")
    # A pattern, since a stream of files takes a folder or a pattern, and the table may be either one file or a folder.
    live = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parque[t]")
    return live.select("event_id", F.col("user_id").alias("participant_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                       "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("participant_id").distinct()


def _of(spark: SparkSession, sf_dir: str, kind: str | None) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev if kind is None else ev.where(F.col("event_type") == kind)


def minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute metrics on a clock that repeats within the hour, so stamps collide."""
    return _of(spark, sf_dir, None).select(
        "participant_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.expr("CASE k % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'distance' ELSE 'calories' END").alias("metric"),
        F.expr("CAST(floor(value * 10) AS DOUBLE)").alias("value"), F.col("event_id").alias("seq"))


def hr(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    return _of(spark, sf_dir, "view" if split else None).select(
        "participant_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
        F.expr("CAST(floor(value) + 20 AS DOUBLE)").alias("bpm"),
        F.expr("CASE WHEN k % 7 = 0 THEN NULL ELSE k % 4 END").alias("confidence"),
        F.col("event_id").alias("seq"))


def rhr(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    return _of(spark, sf_dir, "signup" if split else None).select(
        "participant_id", "ts",
        F.expr("CASE WHEN k % 6 = 0 THEN 0.0D ELSE CAST(40 + floor(value) AS DOUBLE) END").alias("value"),
        F.expr("CASE WHEN k % 5 = 0 THEN NULL ELSE date_format(ts, 'MM/dd/yy') END").alias("rhr_date"),
        F.col("event_id").alias("seq"))


def zones(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """A missing zone is an absent key."""
    return _of(spark, sf_dir, "click" if split else None).select("participant_id", "ts", F.expr("""
        map_filter(map('BELOW_DEFAULT_ZONE_1', CAST(floor(value) AS DOUBLE),
                       'IN_DEFAULT_ZONE_1', CAST(k AS DOUBLE),
                       'IN_DEFAULT_ZONE_2', CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE k % 10 END AS DOUBLE),
                       'IN_DEFAULT_ZONE_3', CAST(CASE WHEN k % 2 = 0 THEN NULL ELSE k % 7 END AS DOUBLE)),
                   (z, v) -> v IS NOT NULL)""").alias("zones"), F.col("event_id").alias("seq"))


def sleep(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    return _of(spark, sf_dir, "purchase" if split else None).select(
        "participant_id", F.col("event_id").alias("log_id"),
        F.expr("date_format(ts, 'yyyy-MM-dd')").alias("date_of_sleep"),
        F.expr("ts - make_dt_interval(0, 0, CAST(floor(value) AS INT), 0)").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        F.expr("CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(floor(value * 0.5) AS DOUBLE) END").alias("asleep_min"),
        F.expr("CAST(k % 17 AS DOUBLE)").alias("awake_total_min"),
        F.expr("CAST(floor(value) AS DOUBLE)").alias("time_in_bed_min"),
        F.expr("CAST(k AS DOUBLE)").alias("efficiency_pct"),
        F.expr("CASE WHEN k % 5 = 0 THEN 'classic' ELSE 'stages' END").alias("sleep_type"),
        F.expr("k % 6 <> 0").alias("main_sleep"),
        F.expr("CAST(k % 40 AS DOUBLE)").alias("deep_min"), F.expr("CAST(k % 60 + 10 AS DOUBLE)").alias("light_min"),
        F.expr("CAST(k % 30 AS DOUBLE)").alias("rem_min"),
        F.expr("CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END").alias("wake_min"),
        F.expr("CAST(k % 9 AS DOUBLE)").alias("restless_min"), F.expr("CAST(k % 25 AS DOUBLE)").alias("awake_min"),
        F.expr("k % 4 = 0").alias("has_level_data"), F.col("event_id").alias("seq"))


def exercise(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    return _of(spark, sf_dir, "click" if split else None).select(
        "participant_id", F.col("event_id").alias("log_id"),
        F.expr("element_at(array('Run', 'Outdoor Bike', 'Walk', 'Soccer', 'Sport'), k % 5 + 1)").alias("activity_name"),
        F.col("ts").alias("start_ts"),
        F.expr("CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(floor(value * 400) AS BIGINT) END").alias("active_ms"),
        F.expr("CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(floor(value * 600) AS BIGINT) END").alias("duration_ms"),
        F.col("event_id").alias("seq"))


def sleep_score(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    return _of(spark, sf_dir, "view" if split else None).select(
        "participant_id", "ts", F.expr("CAST(k AS DOUBLE)").alias("overall_score"),
        F.expr("CAST(k % 25 AS DOUBLE)").alias("composition_score"),
        F.expr("CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END").alias("revitalization_score"),
        F.expr("CAST(k % 50 AS DOUBLE)").alias("duration_score"),
        F.expr("CAST(floor(value) AS DOUBLE)").alias("deep_sleep_in_minutes"),
        F.expr("CAST(k AS DOUBLE) / 256").alias("restlessness"), F.col("event_id").alias("seq"))


def wellness(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """Answers with sentinels outside the scales."""
    return _of(spark, sf_dir, "signup" if split else None).select(
        "participant_id", "ts", F.expr("CAST(k % 7 AS DOUBLE)").alias("fatigue"),
        F.expr("CAST(k % 6 AS DOUBLE)").alias("mood"), F.expr("CAST(k % 12 AS DOUBLE)").alias("readiness"),
        F.expr("CAST(k % 9 AS DOUBLE) - 1").alias("sleep_duration_h"),
        F.expr("CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 5 AS DOUBLE) END").alias("sleep_quality"),
        F.expr("CAST(k % 4 AS DOUBLE)").alias("soreness"),
        F.expr("""CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[''knee'']'
                  WHEN 2 THEN '[''knee'', ''Back'']' ELSE 'none' END""").alias("soreness_area"),
        F.expr("CAST(k % 8 AS DOUBLE)").alias("stress"), F.col("event_id").alias("seq"))


def srpe(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    return _of(spark, sf_dir, "purchase" if split else None).select(
        "participant_id", "ts",
        F.expr("CASE k % 4 WHEN 0 THEN array('individual', 'running') WHEN 1 THEN array('team', 'soccer') "
               "WHEN 2 THEN array('strength') ELSE CAST(array() AS ARRAY<STRING>) END").alias("activity_names"),
        F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 11 AS DOUBLE) END").alias("rpe"),
        F.expr("CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END").alias("duration_min"),
        F.col("event_id").alias("seq"))


INJURY_LITERAL = """CASE WHEN k % 3 = 0 THEN '{}' WHEN k % 7 = 0 THEN 'not a dict'
    WHEN k % 2 = 0 THEN '{''left_foot'': ''minor''}'
    ELSE '{''left_foot'': ''major'', ''head_neck'': ''minor''}' END"""


def injury(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    from daygrain.functions.encoding import parse_map
    return _of(spark, sf_dir, "error" if split else None).select(
        "participant_id", "ts", parse_map(F.expr(INJURY_LITERAL)).alias("injuries"), F.col("event_id").alias("seq"))


def reporting(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """Submitted some hours from midnight of the logged day, also before it."""
    return _of(spark, sf_dir, "click" if split else None).select(
        "participant_id", F.expr("CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ)").alias("ts"),
        F.expr("CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) + make_dt_interval(0, k - 6, 0, 0)").alias("submitted_ts"),
        F.expr("CASE k % 4 WHEN 0 THEN 'Breakfast, Lunch' WHEN 1 THEN 'Dinner' WHEN 2 THEN 'Lunch,, Lunch ' "
               "ELSE NULL END").alias("meals"),
        F.expr("CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(60 + k % 16 AS DOUBLE) / 2 + 40 END").alias("weight"),
        F.expr("CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 10 AS DOUBLE) END").alias("glasses_of_fluid"),
        F.expr("CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no ' ELSE 'maybe' END").alias("alcohol_consumed"),
        F.col("event_id").alias("seq"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a shot."""
    return _of(spark, sf_dir, None).select(
        "participant_id", F.expr("concat('IMG_', lpad(CAST(event_id AS STRING), 9, '0'), '.jpg')").alias("file"),
        "ts", F.expr("CASE WHEN k % 5 = 0 THEN 'NO' ELSE 'YES' END").alias("is_food"),
        F.col("event_id").alias("seq"))


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All sources at once: one event type each where sources must be distinct."""
    makers = (hr, rhr, zones, sleep, exercise, sleep_score, wellness, srpe, injury, reporting)
    return {m.__name__: m(spark, sf_dir) for m in (minute, photos)} | {
        m.__name__: m(spark, sf_dir, split=True) for m in makers}


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daygrain.operators.joins import day_spine
    return day_spine(participants(spark, sf_dir), START, END)


VIEWS = {
    "ev": """SELECT event_id, user_id AS participant_id, ts, CAST(ts AS DATE) AS d, event_type, value,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "minute": """SELECT participant_id, date_trunc('hour', ts) AS ts, d,
        CASE k % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'distance' ELSE 'calories' END AS metric,
        floor(value * 10) AS value, event_id AS seq FROM ev""",
    "hr": """SELECT participant_id, date_trunc('second', ts) AS ts, d, floor(value) + 20 AS bpm,
        CASE WHEN k % 7 = 0 THEN NULL ELSE k % 4 END AS confidence, event_id AS seq
        FROM ev""",
    "rhr": """SELECT participant_id, ts, d, CASE WHEN k % 6 = 0 THEN 0.0::DOUBLE ELSE 40 + floor(value) END AS value,
        CASE WHEN k % 5 = 0 THEN NULL ELSE strftime(ts, '%m/%d/%y') END AS rhr_date, event_id AS seq
        FROM ev""",
    "zones": """SELECT participant_id, ts, d, floor(value) AS z0, CAST(k AS DOUBLE) AS z1,
        CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE k % 10 END AS DOUBLE) AS z2,
        CAST(CASE WHEN k % 2 = 0 THEN NULL ELSE k % 7 END AS DOUBLE) AS z3, event_id AS seq
        FROM ev""",
    "sleep": """SELECT participant_id, event_id AS log_id, d, strftime(ts, '%Y-%m-%d') AS date_of_sleep,
        ts - to_minutes(CAST(floor(value) AS INTEGER)) AS start_ts, ts AS end_ts,
        CASE WHEN k % 11 = 0 THEN NULL ELSE floor(value * 0.5) END AS asleep_min,
        CAST(k % 17 AS DOUBLE) AS awake_total_min, floor(value) AS time_in_bed_min,
        CAST(k AS DOUBLE) AS efficiency_pct, CASE WHEN k % 5 = 0 THEN 'classic' ELSE 'stages' END AS sleep_type,
        k % 6 <> 0 AS main_sleep, CAST(k % 40 AS DOUBLE) AS deep_min, CAST(k % 60 + 10 AS DOUBLE) AS light_min,
        CAST(k % 30 AS DOUBLE) AS rem_min, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END AS wake_min,
        CAST(k % 25 AS DOUBLE) AS awake_min, k % 4 = 0 AS has_level_data, event_id AS seq
        FROM ev""",
    "exercise": """SELECT participant_id, event_id AS log_id, d,
        ['Run', 'Outdoor Bike', 'Walk', 'Soccer', 'Sport'][k % 5 + 1] AS activity_name, ts AS start_ts,
        CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(floor(value * 400) AS BIGINT) END AS active_ms,
        CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(floor(value * 600) AS BIGINT) END AS duration_ms, event_id AS seq
        FROM ev""",
    "sleep_score": """SELECT participant_id, ts, d, CAST(k AS DOUBLE) AS overall_score,
        CAST(k % 25 AS DOUBLE) AS composition_score,
        CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END AS revitalization_score,
        CAST(k % 50 AS DOUBLE) AS duration_score, floor(value) AS deep_sleep_in_minutes,
        CAST(k AS DOUBLE) / 256 AS restlessness FROM ev""",
    "wellness": """SELECT participant_id, ts, d, CAST(k % 7 AS DOUBLE) AS fatigue, CAST(k % 6 AS DOUBLE) AS mood,
        CAST(k % 12 AS DOUBLE) AS readiness, CAST(k % 9 AS DOUBLE) - 1 AS sleep_duration_h,
        CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 5 AS DOUBLE) END AS sleep_quality,
        CAST(k % 4 AS DOUBLE) AS soreness,
        CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[''knee'']' WHEN 2 THEN '[''knee'', ''Back'']' ELSE 'none' END
            AS soreness_area,
        CAST(k % 8 AS DOUBLE) AS stress, event_id AS seq FROM ev""",
    "srpe": """SELECT participant_id, ts, d, CASE k % 4 WHEN 0 THEN ['individual', 'running']
        WHEN 1 THEN ['team', 'soccer'] WHEN 2 THEN ['strength'] ELSE []::VARCHAR[] END AS activity_names,
        CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 11 AS DOUBLE) END AS rpe,
        CASE WHEN k % 8 = 0 THEN NULL ELSE floor(value) END AS duration_min, event_id AS seq
        FROM ev""",
    # foot and head hold the severity of the two locations, NULL when not hurt.
    "injury": """SELECT participant_id, ts, d, CASE WHEN k % 3 = 0 OR k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 'minor'
        ELSE 'major' END AS foot, CASE WHEN k % 3 = 0 OR k % 7 = 0 OR k % 2 = 0 THEN NULL ELSE 'minor' END AS head,
        event_id AS seq FROM ev""",
    "reporting": """SELECT participant_id, CAST(d AS TIMESTAMP) AS ts, d,
        CAST(d AS TIMESTAMP) + to_hours(k - 6) AS submitted_ts,
        CASE k % 4 WHEN 0 THEN 'Breakfast, Lunch' WHEN 1 THEN 'Dinner' WHEN 2 THEN 'Lunch,, Lunch ' ELSE NULL END
            AS meals,
        CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(60 + k % 16 AS DOUBLE) / 2 + 40 END AS weight,
        CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 10 AS DOUBLE) END AS glasses_of_fluid,
        CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no ' ELSE 'maybe' END AS alcohol_consumed, event_id AS seq
        FROM ev""",
    "photos": """SELECT participant_id, 'IMG_' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.jpg' AS file, ts, d,
        CASE WHEN k % 5 = 0 THEN 'NO' ELSE 'YES' END AS is_food, event_id AS seq FROM ev""",
    "people": "SELECT DISTINCT participant_id FROM ev",
    "spine": """SELECT participant_id, CAST(g.day AS DATE) AS date FROM people,
        (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) g""",
}
_NEEDS = {"spine": ("people",)}
#: The event type of each source where one table must play several distinct sources.
KINDS = {"hr": "view", "rhr": "signup", "zones": "click", "sleep": "purchase", "exercise": "click", "sleep_score": "view", "wellness": "signup", "srpe": "purchase", "injury": "error", "reporting": "click"}


def rnd(expr: str, digits: int) -> str:
    """Round a double half up on its decimal text, as Spark does.

    The SQL engine would scale the binary value instead, which differs on ties.
    """
    return f"round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,20)), {digits})::DOUBLE"


def with_views(body: str, *names: str, split: bool = False) -> str:
    """``body`` behind the named views and the ones they build on; see ``sources`` for ``split``."""
    wanted: list[str] = ["ev"]
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    only = {n: f" WHERE event_type = '{KINDS[n]}'" for n in KINDS} if split else {}
    ctes = ", ".join(f"{n} AS ({VIEWS[n]}{only.get(n, '')})" for n in wanted)
    body = body.strip()
    return f"WITH {ctes}{',' if not body.upper().startswith('SELECT') else ''} {body}"


def split_twin(sql: str) -> str:
    """The SQL of a query on single sources, with every source on its own event type."""
    for view, kind in KINDS.items():
        sql = sql.replace(f"{view} AS ({VIEWS[view]})", f"{view} AS ({VIEWS[view]} WHERE event_type = '{kind}')")
    return sql
