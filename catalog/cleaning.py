"""Cleaning, parsing and encoding functions over whole tables."""

from pyspark.sql import functions as F, types as T

from catalog import bindings as B
from catalog.registry import query
from daygrain.functions import cleaning as C, encoding as E
from daygrain.functions.text import format_distance, format_value
from daygrain.operators import daily
from daygrain.operators.tables import onehot_values, ordered_columns
from daygrain.sources.dictionary import feature_columns, final_dictionary
from daygrain.sources.readers import clean_participants

RAW_NUMBER = """CASE k % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE CAST(value AS STRING) END"""


@query("safe_numeric_cast", B.with_views("""
    SELECT event_id, CASE WHEN k % 5 <= 2 THEN NULL ELSE value END AS v,
        CASE WHEN k % 5 <= 2 THEN -1.0 ELSE value END AS v_or_default FROM ev"""))
def safe_numeric_cast(spark, sf_dir):
    raw = B.events(spark, sf_dir).withColumn("raw", F.expr(RAW_NUMBER))
    return raw.select("event_id", C.safe_double("raw").alias("v"), C.safe_double("raw", -1.0).alias("v_or_default"))


@query("clean_likert", B.with_views("""
    SELECT seq, CASE WHEN fatigue BETWEEN 1 AND 5 THEN fatigue END AS fatigue,
        CASE WHEN mood BETWEEN 1 AND 5 THEN mood END AS mood,
        CASE WHEN sleep_quality BETWEEN 1 AND 5 THEN sleep_quality END AS sleep_quality,
        CASE WHEN soreness BETWEEN 1 AND 5 THEN soreness END AS soreness,
        CASE WHEN stress BETWEEN 1 AND 5 THEN stress END AS stress FROM wellness""", "wellness"))
def clean_likert(spark, sf_dir):
    return C.clean_likert(B.wellness(spark, sf_dir)).select("seq", *C.LIKERT_COLUMNS)


@query("clean_readiness", B.with_views("""
    SELECT seq, readiness, CASE WHEN readiness BETWEEN 1 AND 10 THEN readiness END AS readiness_clean FROM wellness""",
    "wellness"))
def clean_readiness(spark, sf_dir):
    return C.clean_readiness(B.wellness(spark, sf_dir)).select("seq", "readiness", "readiness_clean")


@query("clean_sleep_hours", B.with_views("""
    SELECT seq, CASE WHEN sleep_duration_h > 0 THEN sleep_duration_h END AS sleep_duration_h FROM wellness""", "wellness"))
def clean_sleep_hours(spark, sf_dir):
    return C.clean_sleep_hours(B.wellness(spark, sf_dir)).select("seq", "sleep_duration_h")


@query("clean_resting_hr", B.with_views("""
    SELECT seq, CASE WHEN rhr_date IS NOT NULL AND value > 0 THEN value END AS rhr FROM rhr""", "rhr"))
def clean_resting_hr(spark, sf_dir):
    return B.rhr(spark, sf_dir).select("seq", C.clean_rhr("value", "rhr_date").alias("rhr"))


@query("drop_low_confidence", B.with_views("""
    SELECT participant_id, count(*) FILTER (confidence IS NOT DISTINCT FROM 0) AS n_dropped,
        round(avg(confidence) FILTER (confidence <> 0), 3) AS mean_conf FROM hr GROUP BY 1""", "hr"))
def drop_low_confidence(spark, sf_dir):
    return daily.confidence_summary(B.hr(spark, sf_dir))


@query("clip_heart_rate", B.with_views("""
    SELECT seq, greatest(least(bpm, 220), 30) AS bpm, CAST(bpm < 30 OR bpm > 220 AS INTEGER) AS clipped FROM hr
    WHERE confidence IS DISTINCT FROM 0""", "hr"))
def clip_heart_rate(spark, sf_dir):
    return daily.clean_hr(B.hr(spark, sf_dir)).select("seq", "bpm", "clipped")


@query("clipped_samples_per_day", B.with_views("""
    SELECT participant_id, d AS date, count(*) FILTER (bpm < 30 OR bpm > 220) AS n_clipped_hr FROM hr GROUP BY 1, 2""", "hr"))
def clipped_samples_per_day(spark, sf_dir):
    return daily.clipped_per_day(B.hr(spark, sf_dir))


@query("clean_stride", "SELECT p_partkey, CASE WHEN p_size >= 20 THEN CAST(p_size AS DOUBLE) END AS stride_cm FROM part")
def clean_stride(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select("p_partkey", C.clean_stride("p_size").alias("stride_cm"))


@query("clip_restlessness", B.with_views("""
    SELECT event_id, greatest(least(k / 256.0::DOUBLE, 0.20::DOUBLE), 0.03::DOUBLE) AS restlessness FROM ev"""))
def clip_restlessness(spark, sf_dir):
    ev = B.events(spark, sf_dir).withColumn("r", F.col("k") / F.lit(256.0))
    return ev.select("event_id", C.clip("r", *C.RESTLESSNESS_RANGE).alias("restlessness"))


@query("dedupe_minutes_keep_first", B.with_views("""
    SELECT participant_id, metric, ts, arg_min(value, seq) AS value, count(*) AS n_raw FROM minute GROUP BY 1, 2, 3""",
    "minute"))
def dedupe_minutes_keep_first(spark, sf_dir):
    return daily.dedupe_minutes(B.minute(spark, sf_dir))


@query("dedupe_counts_per_day", B.with_views("""
    SELECT participant_id, d AS date, sum(n - u)::BIGINT AS n_deduped_min FROM (
        SELECT participant_id, metric, d, count(*) AS n, count(DISTINCT ts) AS u FROM minute
        WHERE metric IN ('steps', 'distance') GROUP BY 1, 2, 3) GROUP BY 1, 2""", "minute"))
def dedupe_counts_per_day(spark, sf_dir):
    return daily.dedupe_counts_per_day(B.minute(spark, sf_dir))


@query("parse_dict_literal", B.with_views("""
    SELECT seq, foot AS left_foot, head AS head_neck,
        (foot IS NOT NULL)::INTEGER + (head IS NOT NULL)::INTEGER AS n_locations FROM injury""", "injury"))
def parse_dict_literal(spark, sf_dir):
    return B.injury(spark, sf_dir).select(
        "seq", F.try_element_at("injuries", F.lit("left_foot")).alias("left_foot"),
        F.try_element_at("injuries", F.lit("head_neck")).alias("head_neck"), F.size("injuries").alias("n_locations"))


@query("parse_list_literal", B.with_views("""
    SELECT event_id, CASE k % 4 WHEN 0 THEN 'individual,running' WHEN 1 THEN 'team' ELSE '' END AS names FROM ev"""))
def parse_list_literal(spark, sf_dir):
    raw = F.expr("""CASE k % 4 WHEN 0 THEN '[''Individual '', ''RUNNING'']' WHEN 1 THEN '[''team'', '' '']'
                    WHEN 2 THEN 'oops' ELSE NULL END""")
    return B.events(spark, sf_dir).withColumn("raw", raw).select(
        "event_id", F.array_join(E.parse_list("raw"), ",").alias("names"))


@query("parse_literal_grammar", B.with_views("""
    SELECT event_id, CASE k % 6 WHEN 0 THEN 'hip|none' WHEN 1 THEN 'true|1.5|xy' WHEN 2 THEN '(''a'', 1)|[]' WHEN 3 THEN 'it''s' || chr(10) || 'k='
        || k ELSE '' END AS names, CASE k % 6 WHEN 4 THEN 'None' END AS left_foot, CASE k % 6 WHEN 4 THEN CAST(k AS VARCHAR) END AS n,
        CASE k % 6 WHEN 4 THEN '{''a'': [1, ''b'']}' END AS nested FROM ev"""))
def parse_literal_grammar(spark, sf_dir):
    """Tuples, names, numbers, escapes, trailing commas and nesting; k % 6 = 5 is no literal."""
    raw = F.expr(r"""CASE k % 6 WHEN 0 THEN "('Hip', None, )" WHEN 1 THEN "[True, 1.50, 'x' \"y\"]" WHEN 2 THEN "[('a', 1), [], ]"
        WHEN 3 THEN concat("[\"it's\\nk=", k, "\",]") WHEN 4 THEN concat("{'left_foot': None, 'n': ", k, ", 'nested': {'a': [1, 'b',]}, }")
        ELSE "['hip', 'toe'" END""")
    rows = B.events(spark, sf_dir).select("event_id", raw.alias("raw")).withColumn("map", E.parse_map("raw"))
    return rows.select("event_id", F.array_join(E.parse_list("raw"), "|").alias("names"), *[
        F.try_element_at("map", F.lit(c)).alias(c) for c in ("left_foot", "n", "nested")])


@query("parse_soreness_area", B.with_views("""
    SELECT seq, CASE k4 WHEN 1 THEN 'knee' WHEN 2 THEN 'knee,Back' ELSE '' END AS areas, k4 IN (1, 2) AS any_sore,
        CASE k4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_zones
    FROM (SELECT event_id AS seq, k % 4 AS k4 FROM ev)"""))
def parse_soreness_area(spark, sf_dir):
    sore = B.wellness(spark, sf_dir).withColumn("s", E.soreness("soreness_area"))
    return sore.select("seq", F.array_join("s.areas", ",").alias("areas"), "s.any_sore", "s.n_zones")


@query("yes_no_flag", B.with_views("""
    SELECT seq, CASE lower(trim(alcohol_consumed)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS flag FROM reporting""",
    "reporting"))
def yes_no_flag(spark, sf_dir):
    return B.reporting(spark, sf_dir).select("seq", E.yes_no("alcohol_consumed").alias("flag"))


@query("split_comma_set", B.with_views("""
    SELECT seq, array_to_string(list_filter(list_transform(string_split(coalesce(meals, ''), ','), lambda x: trim(x)),
        lambda x: x <> ''), '|') AS names FROM reporting""", "reporting"))
def split_comma_set(spark, sf_dir):
    return B.reporting(spark, sf_dir).select("seq", F.array_join(E.split_set("meals"), "|").alias("names"))


@query("format_distance", """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a'
        WHEN cm < 100 THEN format('{:g}', cm) || ' cm'
        WHEN cm < 100000 THEN format('{:g}', cm / 100) || ' m' ELSE format('{:g}', cm / 100000) || ' km' END AS distance
    FROM (SELECT *, floor(o_totalprice) * CASE o_orderstatus WHEN 'F' THEN 0.001 ELSE 1 END AS cm FROM orders)""")
def distance_text(spark, sf_dir):
    cm = F.expr("""CASE WHEN o_orderpriority = '5-LOW' THEN NULL
        ELSE floor(o_totalprice) * CASE o_orderstatus WHEN 'F' THEN 0.001D ELSE 1D END END""")
    return B.table(spark, sf_dir, "orders").select("o_orderkey", format_distance(cm).alias("distance"))


@query("format_values", B.with_views("""
    SELECT seq, coalesce(format('{:.1f}', sleep_quality), 'n/a') AS as_number,
        CASE WHEN mood > 2 THEN 'Yes' ELSE 'No' END AS as_flag,
        CASE k4 WHEN 1 THEN 'knee' WHEN 2 THEN 'knee, Back' ELSE 'n/a' END AS as_list,
        'fatigue: ' || format('{:.1f}', fatigue) || ', mood: ' || format('{:.1f}', mood) AS as_record
    FROM (SELECT w.*, CAST(soreness AS INTEGER) AS k4 FROM wellness w)""", "wellness"))
def format_values(spark, sf_dir):
    w = B.wellness(spark, sf_dir)
    record = T.StructType([T.StructField("fatigue", T.DoubleType()), T.StructField("mood", T.DoubleType())])
    areas = E.soreness("soreness_area").getField("areas")
    return w.select("seq", format_value("sleep_quality", T.DoubleType()).alias("as_number"),
                    format_value(F.col("mood") > 2, T.BooleanType()).alias("as_flag"),
                    format_value(areas, T.ArrayType(T.StringType())).alias("as_list"),
                    format_value(F.struct("fatigue", "mood"), record).alias("as_record"))


RAW_PEOPLE = """SELECT CAST(c_custkey AS STRING) AS participant_id, CAST(c_nationkey + 20 AS STRING) AS age,
    CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_acctbal AS STRING) END AS height,
    concat(' ', c_mktsegment, ' ') AS gender, CASE WHEN c_nationkey < 12 THEN ' a ' ELSE '' END AS a_or_b_person,
    CAST(c_nationkey AS STRING) AS max_heart_rate, CAST(c_nationkey * 10 AS STRING) AS stride_walk,
    CAST(c_nationkey * 2 AS STRING) AS stride_run FROM {customer}"""


@query("clean_static_covariates", """
    SELECT CAST(c_custkey AS VARCHAR) AS participant_id, CAST(c_nationkey + 20 AS DOUBLE) AS age,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS height_cm, lower(c_mktsegment) AS gender,
        CASE WHEN c_nationkey < 12 THEN 'A' END AS chronotype, CAST(c_nationkey AS DOUBLE) AS max_hr,
        CAST(c_nationkey * 10 AS DOUBLE) AS stride_walk_cm,
        CASE WHEN c_nationkey * 2 >= 20 THEN CAST(c_nationkey * 2 AS DOUBLE) END AS stride_run_cm FROM customer""")
def clean_static_covariates(spark, sf_dir):
    return clean_participants(spark.sql(RAW_PEOPLE, customer=B.table(spark, sf_dir, "customer")))


@query("validate_macro_payload", B.with_views("""
    SELECT event_id, k % 3 = 0 AND k % 4 <> 1 AS usable, CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN value END AS calories FROM ev"""))
def validate_macro_payload(spark, sf_dir):
    payload = F.struct(F.col("value").cast("string").alias("calories"),
                       F.expr("CASE k % 3 WHEN 0 THEN '1.5' WHEN 1 THEN 'lots' ELSE '-1' END").alias("protein"),
                       F.expr("CASE WHEN k % 4 = 1 THEN NULL ELSE '2' END").alias("carbohydrates"),
                       F.lit("0").alias("fats"))
    checked = B.events(spark, sf_dir).withColumn("m", C.valid_macros(payload))
    return checked.select("event_id", F.col("m").isNotNull().alias("usable"), F.col("m.calories").alias("calories"))


@query("estimate_keys", B.with_views("""
    SELECT event_id, participant_id || '|' || d || '|a' || k || '.jpg,b.jpg' AS cache_key FROM ev"""))
def estimate_keys(spark, sf_dir):
    files = F.array(F.lit("/shots/b.jpg"), F.concat(F.lit("/x/a"), F.col("k").cast("string"), F.lit(".jpg")))
    return B.events(spark, sf_dir).select("event_id", E.estimate_key("participant_id", F.to_date("ts"), files).alias("cache_key"))


@query("injury_onehots", B.with_views("""
    one AS (SELECT participant_id, d, 'left_foot' AS loc, foot AS sev, seq FROM injury WHERE foot IS NOT NULL
            UNION ALL SELECT participant_id, d, 'head_neck', head, seq FROM injury WHERE head IS NOT NULL),
    last AS (SELECT participant_id, d, loc, arg_max(sev, seq) AS sev FROM one GROUP BY 1, 2, 3)
    SELECT participant_id, d AS date, max((loc = 'head_neck')::INTEGER) AS inj_head_neck__minor,
        max((loc = 'left_foot' AND sev = 'major')::INTEGER) AS inj_left_foot__major,
        max((loc = 'left_foot' AND sev = 'minor')::INTEGER) AS inj_left_foot__minor FROM last GROUP BY 1, 2""", "injury"))
def injury_onehots(spark, sf_dir):
    injury = B.injury(spark, sf_dir)
    return daily.injury_onehots(injury, onehot_values(daily.injury_state(injury)))


@query("activity_flags", B.with_views("SELECT log_id, " + ", ".join(
    f"CAST(contains(lower(activity_name), '{a}') AS INTEGER) AS act_{a}" for a in E.ACTIVITY_LABELS)
    + " FROM exercise", "exercise"))
def activity_flags(spark, sf_dir):
    bouts = B.exercise(spark, sf_dir).withColumn("names", F.array("activity_name"))
    return bouts.select("log_id", *E.activity_flags("names"))


@query("or_activity_flags", B.with_views("""
    SELECT participant_id, d AS date, max(CASE WHEN k % 5 = 3 THEN 1
        WHEN k % 4 = 1 THEN 1 ELSE 0 END) AS act_soccer
    FROM ev GROUP BY 1, 2"""))
def or_activity_flags(spark, sf_dir):
    a = daily.exercise_daily(B.exercise(spark, sf_dir), min_minutes=-1.0)
    b = daily.srpe_daily(B.srpe(spark, sf_dir))
    return a.join(b, ["participant_id", "date"], "full").select(
        "participant_id", "date", E.or_flags("ex_soccer", "sr_soccer").alias("act_soccer"))


@query("bout_minutes", B.with_views("""
    SELECT log_id, coalesce(active_ms, duration_ms, 0) / 60000.0::DOUBLE AS minutes,
        coalesce(active_ms, duration_ms, 0) / 60000.0::DOUBLE > 0.03 AS real_bout FROM exercise""", "exercise"))
def bout_minutes(spark, sf_dir):
    minutes = C.bout_minutes("active_ms", "duration_ms")
    return B.exercise(spark, sf_dir).select("log_id", minutes.alias("minutes"), C.real_bout(minutes).alias("real_bout"))


@query("suspicious_file_names", """
    SELECT page_id, regexp_matches(md5(url), '^[0-9a-f-]{30,}') AND page_id IS NOT NULL AS hash_name,
        url LIKE '%.png' OR regexp_matches(url, '^[0-9a-f-]{30,}') AS odd_url FROM pages""")
def suspicious_file_names(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select(
        "page_id", C.suspicious_name(F.md5("url")).alias("hash_name"), C.suspicious_name("url").alias("odd_url"))


@query("stable_column_order", B.with_views("""
    hurt AS (SELECT count(DISTINCT (participant_id, d)) AS n FROM injury WHERE foot IS NOT NULL)
    SELECT CAST(unnest(range(6)) AS INTEGER) AS position, unnest(['participant_id', 'date', 'inj_head_neck__minor',
        'inj_left_foot__major', 'inj_left_foot__minor', 'zz_extra']) AS "column", unnest([n, n, n, n, n, n]) AS non_missing_rows FROM hurt""",
    "injury"))
def stable_column_order(spark, sf_dir):
    injury = B.injury(spark, sf_dir)
    flags = daily.injury_onehots(injury, onehot_values(daily.injury_state(injury)))
    wide = flags.select(F.lit(1).alias("zz_extra"), *reversed(flags.columns))
    return final_dictionary(wide.select(*ordered_columns(wide))).select("position", "column", "non_missing_rows")


@query("model_columns", B.with_views("""
    r AS (SELECT participant_id, d, count(*) AS n, arg_max_null(CASE WHEN readiness BETWEEN 1 AND 10 THEN readiness END, seq) AS ready
          FROM wellness GROUP BY 1, 2)
    SELECT unnest(['readiness_same_day', 'n_wellness_rows', 'submission_hour', 'delayed_flag_ge12']) AS "column",
        unnest([count(ready), count(*), count(*), count(*)]) AS non_missing_rows FROM r""", "wellness"))
def model_columns(spark, sf_dir):
    day = daily.wellness_daily(B.wellness(spark, sf_dir))
    return final_dictionary(day.select(*feature_columns(day))).select("column", "non_missing_rows")


@query("unit_conversions", f"""
    SELECT l_orderkey, l_linenumber, {B.rnd('l_extendedprice / 100', 2)} AS metres,
        l_quantity / 60000.0::DOUBLE AS minutes, {B.rnd('l_quantity / 60.0::DOUBLE', 2)} AS hours FROM lineitem""")
def unit_conversions(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", C.cm_to_m("l_extendedprice").alias("metres"),
        C.ms_to_min("l_quantity").alias("minutes"), C.min_to_h("l_quantity").alias("hours"))
