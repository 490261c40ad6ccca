"""Unions, top-k, ordering and distinct text."""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.registry import query
from daygrain.operators import daily, tables as T

KEYS = ["participant_id", "date"]


@query("union_aligned_frames", B.with_views("""
    SELECT participant_id, d AS date, 1 AS inj_left_foot, 0 AS inj_head_neck, CAST(NULL AS DOUBLE) AS weight FROM injury
    UNION ALL SELECT participant_id, d, 0, 1, NULL FROM injury WHERE head IS NOT NULL
    UNION ALL SELECT participant_id, d, 0, 0, weight FROM reporting""", "injury", "reporting"))
def union_aligned_frames(spark, sf_dir):
    injury = B.injury(spark, sf_dir).withColumn("date", F.to_date("ts"))
    feet = injury.select(*KEYS, F.lit(1).alias("inj_left_foot"))
    heads = injury.where(F.try_element_at("injuries", F.lit("head_neck")).isNotNull()).select(*KEYS, F.lit(1).alias("inj_head_neck"))
    rest = B.reporting(spark, sf_dir).select("participant_id", F.to_date("ts").alias("date"), "weight")
    return T.union_aligned([feet, heads, rest])


@query("pooled_frames", B.with_views("""
    SELECT 'srpe' AS source, participant_id, duration_min AS minutes FROM srpe
    UNION ALL SELECT 'sleep', participant_id, time_in_bed_min FROM sleep""", "srpe", "sleep"))
def pooled_frames(spark, sf_dir):
    return T.pool({"srpe": B.srpe(spark, sf_dir).select("participant_id", F.col("duration_min").alias("minutes")),
                   "sleep": B.sleep(spark, sf_dir).select("participant_id", F.col("time_in_bed_min").alias("minutes"))})


@query("top_k_overall", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 3")
def top_k_overall(spark, sf_dir):
    return T.top_k(B.table(spark, sf_dir, "part"), ["p_brand"], 3)


@query("top_k_per_group", """
    SELECT p_type, p_brand, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r
    FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r <= 3""")
def top_k_per_group(spark, sf_dir):
    return T.top_k(B.table(spark, sf_dir, "part"), ["p_brand"], 3, ["p_type"])


@query("sorted_by_magnitude", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC NULLS LAST")
def sorted_by_magnitude(spark, sf_dir):
    return T.sort_abs(B.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("distinct_sorted_text", """
    SELECT p_type, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS p_brand_names FROM part GROUP BY 1""")
def distinct_sorted_text(spark, sf_dir):
    return T.distinct_text(B.table(spark, sf_dir, "part"), ["p_type"], "p_brand")


@query("onehot_vocabulary", B.with_views("""
    SELECT DISTINCT 'inj_left_foot__' || foot AS name FROM injury WHERE foot IS NOT NULL
    UNION SELECT DISTINCT 'inj_head_neck__' || head FROM injury WHERE head IS NOT NULL""", "injury"))
def onehot_vocabulary(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in T.onehot_values(daily.injury_state(B.injury(spark, sf_dir)))], "name string")


@query("feature_column_order", B.with_views("""
    w AS (SELECT participant_id, d AS date, count(*) AS n FROM wellness GROUP BY 1, 2)
    SELECT participant_id, date, CAST(n AS INTEGER) AS n_wellness_rows FROM w""", "wellness"))
def feature_column_order(spark, sf_dir):
    day = daily.wellness_daily(B.wellness(spark, sf_dir)).select("n_wellness_rows", "date", "participant_id")
    return day.select(*T.ordered_columns(day))
