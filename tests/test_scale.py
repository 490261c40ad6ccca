"""Plans and results under skew: no task that holds a hot key.

That no query multiplies rows is checked with the results in test_catalog.
"""

import re

import pytest
from pyspark.sql import functions as F

from catalog import ORACLE_SQL, QUERIES
from daygrain.operators import daily, joins as J, ordered, runs as R, stats as S
from daygrain.operators.tables import sorted_list

SF = "/root/testdata/sf0.001"
def hot(spark, n=30000):
    """Two thirds of the rows belong to one participant, a third to one time stamp."""
    base = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("participant_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 7).alias("s"), F.col("id").alias("seq"))
    ts = F.expr("TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, 0, 0, s)")
    return base.withColumn("ts", ts).withColumn("value", (F.col("seq") % 97).cast("double"))


def test_hot_stamp_folds_before_the_shuffle(spark):
    df = hot(spark).withColumn("metric", F.lit("steps"))
    out = daily.dedupe_minutes(df)
    assert out.agg(F.sum("n_raw")).first()[0] == 30000
    assert out.where("participant_id = 'hot'").agg(F.max("n_raw")).first()[0] == 10000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_hot_key_gaps_are_complete(spark):
    df = hot(spark)
    out = R.gaps(df, ["participant_id"], "ts", "seq")
    people = df.select("participant_id").distinct().count()
    assert out.count() == 30000 - people
    assert out.where("participant_id = 'hot'").agg(F.sum("gap_s")).first()[0] == pytest.approx(
        df.where("participant_id = 'hot'").agg(F.max("s")).first()[0])
    plan = out._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Window [lag(" in line]
    assert any("_chunk" in line.split("], [")[-2] for line in sorts)


def test_hot_stamp_is_dealt_out(spark):
    """Two thirds of the rows share one stamp of one key; no chunk is far above the mean."""
    rows = spark.range(60_000).select(F.lit("hot").alias("participant_id"), F.col("id").alias("seq"), F.expr(
        "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, 0, 0, IF(id % 3 < 2, 0, id))").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        dealt = ordered.chunked(rows, ["participant_id"], ["ts", "seq"])
        sizes = [r["count"] for r in dealt.groupBy(ordered.CHUNK).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    placed = ordered.with_position(rows, ["participant_id"], "ts", ["ts", "seq"])
    assert placed.select(F.min("position"), F.max("position"), F.countDistinct("position")).first() == (1, 60_000, 60_000)
    assert R.gaps(rows, ["participant_id"], "ts", "seq").where("gap_s = 0").count() == 39_999
    assert R.burst_groups(rows, ["participant_id"], "ts", "seq", 1).select("burst").distinct().count() == 20_001
    flagged = R.runs(rows.withColumn("on", F.col("seq") % 3 < 2), ["participant_id"], "ts", "seq", "on")
    assert flagged.agg(F.sum("n_rows")).first()[0] == 40_000


def test_hot_stamp_pairs_are_counted_not_built(spark):
    got = {r["participant_id"]: r["n_pairs"] for r in R.pair_counts_within(hot(spark), "participant_id", "ts", 0).collect()}
    assert got["hot"] == 10000 * 9999 // 2


def test_hot_group_quantiles(spark):
    out = {r["participant_id"]: r["median"] for r in S.exact_quantiles(hot(spark), ["participant_id"], "value", {"median": 0.5}).collect()}
    assert out["hot"] == 48.0


def test_lists_come_back_whole(spark):
    rows = spark.range(50_000).select(F.lit("hot").alias("participant_id"), F.col("id").alias("seq"))
    out = sorted_list(rows, ["participant_id"], F.col("seq"), ["seq"], "items").collect()
    assert len(out) == 1 and out[0]["items"] == list(range(50_000))


def test_window_filter_reaches_the_scan(spark):
    plan = QUERIES["window_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>", plan)


def test_spine_join_shuffles_the_spine_once(spark):
    spine = J.day_spine(spark.range(100).select(F.col("id").cast("string").alias("participant_id")), "2020-01-01", "2020-01-31")
    days = hot(spark).groupBy("participant_id", F.to_date("ts").alias("date"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.join_spine(spine, {str(i): days.agg(F.sum("value").alias(f"v{i}")) for i in range(4)})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 5


def test_every_twin_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(set(QUERIES) - set(ORACLE_SQL)) <= 12
