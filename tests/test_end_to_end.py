"""Raw export tree to typed sources, feature table and report."""

import datetime

import pytest
from pyspark.sql import functions as F

import fixture_tree
from daygrain.operators import windowed as W
from daygrain.operators.tables import COLUMN_ORDER
from daygrain.plans import feature_table as P, report as R
from daygrain.sources import dictionary, readers, sinks

DAY = datetime.date(2020, 2, 3)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    return str(fixture_tree.write_tree(tmp_path_factory.mktemp("export")))


@pytest.fixture(scope="module")
def sources(spark, tree):
    return R.read_sources(spark, tree)


def test_readers(sources):
    minute = sources["minute"]
    assert minute.where("metric = 'steps'").count() == 122
    assert minute.select("participant_id").distinct().count() == 2
    beats = {r["ts"].second + 60 * r["ts"].minute: (r["bpm"], r["confidence"]) for r in sources["hr"].collect()}
    assert beats == {0: (62.0, 2), 5: (250.0, 1), 10: (70.0, 0), 60: (64.0, None)}
    assert sources["sleep"].where("main_sleep").count() == 2
    assert [r["awake_min"] for r in sources["sleep"].where("log_id = 2").collect()] == [2.0]
    assert sources["photos"].count() == 4
    assert sources["srpe"].orderBy("ts").first()["activity_names"] == ["individual", "running"]
    assert sources["rhr"].where("value > 0").count() == 1


def test_absent_source_is_empty(spark, tmp_path):
    assert readers.read_sleep(spark, str(tmp_path)).count() == 0
    assert readers.read_wellness(spark, str(tmp_path)).columns[0] == "participant_id"


def test_participants(spark, tree):
    row = readers.read_participants(spark, f"{tree}/participants.csv").first()
    assert (row["gender"], row["chronotype"], row["stride_walk_cm"], row["stride_run_cm"]) == ("male", "A", 80.5, None)


@pytest.fixture(scope="module")
def table(spark, tree, sources):
    static = readers.read_participants(spark, f"{tree}/participants.csv")
    people = spark.createDataFrame([("p01",), ("p03",)], "participant_id string")
    estimates = spark.createDataFrame([("p01|2020-02-03|b.jpg,c.jpg", 500.0, 20.0, 60.0, 10.0)], sinks.ESTIMATE_SCHEMA)
    return P.build_feature_table(sources, people, "2020-02-01", "2020-02-05", estimates, static).cache()


def test_feature_table_day(table):
    assert table.count() == 10
    row = table.where((F.col("participant_id") == "p01") & (F.col("date") == F.lit(DAY))).first().asDict()
    expected = dict(
        total_steps=600.0, peak_1min_steps=10.0, steps_cov_min=120, n_deduped_min=1, total_distance_m=3141.59, total_kcal=pytest.approx(6.95),
        exercise_min=25.5, n_exercise_sessions=1, act_running=1, act_individual=1, act_walk=0, hr_n_samples=3, hr_mean=pytest.approx(115.33),
        hr_peak=220.0, n_clipped_hr=1, mean_conf=1.5, hr_cov_min=2, rhr_raw=51.5, trimp_edwards=140.0, zones_available=1, n_nights=2, n_naps=1,
        is_classic=0, asleep_min=360.0, deep_pct=10.25, onset_hour=23.5, offset_hour=7.5, midsleep_hour=3.5, mean_restlessness=0.2,
        n_wellness_rows=2, readiness_same_day=7.0, readiness_next_day=5.0, submission_hour=13.25, delayed_flag_ge12=1, srpe_load=210.0,
        is_injured_day=1, n_injury_reports=3, inj_left_foot__major=1, inj_right_hand__minor=0, injured_last_7d=1,
        weight_raw=100.0, fluids_glasses=7.0, alcohol_bin=0, n_meals_logged=3, lag_days=1.0, n_photos=4, n_food_photos=3, n_photo_meals=2,
        estimated_kcal=500.0, nutrition_kcal_available=1, dow=0, nonwear_is_upper_bound=0, age=48.0, stride_run_cm=None)
    assert {k: row[k] for k in expected} == expected
    # Steps fill 09:00-09:59, the only other worn minutes have heart rate inside that hour.
    assert row["nonwear_min"] == 540 + 840


def test_feature_table_zero_or_unknown(table):
    rows = {(r["participant_id"], r["date"].day): r.asDict() for r in table.collect()}
    tomorrow = rows["p01", 4]
    assert tomorrow["srpe_load"] is None and tomorrow["srpe_n_sessions"] == 1 and tomorrow["weight_raw"] is None
    assert tomorrow["weight_7d_median"] == 100.0 and tomorrow["was_imputed_weight_7d_median"] == 0
    quiet = rows["p03", 3]
    assert quiet["srpe_load"] == 0.0 and quiet["exercise_min"] == 0.0 and quiet["hr_mean"] is None and quiet["trimp_edwards"] is None
    assert quiet["nonwear_is_upper_bound"] == 1 and quiet["total_steps"] == 7.0 and quiet["inj_left_foot__major"] == 0
    assert quiet["nonwear_min"] == 1439 and quiet["fluids_glasses"] is None and quiet["age"] is None


def test_column_order_and_dictionary(table):
    known = [c for c in COLUMN_ORDER if c in table.columns]
    assert table.columns[:len(known)] == known and set(COLUMN_ORDER) <= set(table.columns)
    assert table.columns[len(known):] == ["inj_left_foot__major", "inj_right_hand__minor"]
    words = dictionary.data_dictionary(table).collect()
    assert [r["column"] for r in words] == table.columns
    assert [r["column"] for r in words if not r["used_in_x"]] == [c for c in table.columns if c in dictionary.EXCLUDED]
    assert all(r["source"] != "derived" for r in words), [r["column"] for r in words if r["source"] == "derived"]
    final = {r["column"]: r for r in dictionary.final_dictionary(table.select("participant_id", "hr_mean", "readiness_next_day")).collect()}
    assert final["hr_mean"]["non_missing_rows"] == 1 and final["readiness_next_day"]["role"] == "label"


REPORT = """# Daily report — p01 — 2020-02-03

## Activity
- **Total steps**: 600.0
- **Peak 1-min steps**: 10.0
- **Total distance**: 3.14159 km
- **Calories burned**: 6.9
- **Exercise sessions**: 2 (25.5 min, Run, Walk)
- **Resting HR**: 51.5 bpm
- **HR zones (min)**: BELOW_DEFAULT_ZONE_1: 84.0, IN_DEFAULT_ZONE_1: 13.0, IN_DEFAULT_ZONE_2: 6.0, IN_DEFAULT_ZONE_3: 3.0

## Sleep
- **Nights recorded**: 1
- **Mean overall score**: 72.0
- **Night 2020-02-03**:
  - Asleep: 360 min (in bed 400 min, efficiency 90%)
  - **Sleep phases**:
    - Deep: 41 min
    - Light: 222 min
    - REM: 97 min
    - Wake: 40 min

## Questionnaire
- **Wellness rows**: 2
- **Latest wellness**: fatigue: 2, mood: 3, readiness: 7, sleep_duration_h: 5, sleep_quality: 3, soreness: 3, soreness_area: ['knee'], stress: 3
- **Training sessions**: 1, mean RPE 7.0, load 210.0
- **Weight**: 100.0 kg
- **Fluids**: 7.0 glasses
- **Alcohol**: No

## Injury status ⚠ **INJURED**
- **Injured in window**: Yes
- **Injuries**: 2020-02-03 07:00:00.000: left_foot: minor, 2020-02-03 08:00:00.000: left_foot: major
- **Last report**: 2020-02-03 08:00:00.000 (left_foot: major)

## Nutrition
- **Meals logged**: 3 (Breakfast, Dinner, Lunch)
- **Food photos**: 4 → 2 photo-meals
- **Estimated calories**: 700.0 kcal
- **Estimated macros (g)**: protein: 30.0, carbohydrates: 60.0, fats: 10.0

_Calories/macros estimated from meal photos._
"""


def windows(spark, *rows):
    return W.make_windows(spark.createDataFrame(rows, "participant_id string, window_id int, start string, end string"))


def test_report_text(spark, sources):
    one_night = {**sources, "sleep": sources["sleep"].where("log_id = 1")}
    macros = spark.createDataFrame([("p01", 1, 500.0, 20.0, 60.0, 10.0), ("p01", 1, 200.0, 10.0, None, None)],
                                   "participant_id string, window_id int, calories double, protein double, carbohydrates double, fats double")
    asked = windows(spark, ("p01", 1, "2020-02-03", None))
    text = R.render_report(R.window_report(one_night, asked, macros)).first()["text"]
    assert text == REPORT


def test_report_lines_equal_the_text(spark, sources, tmp_path):
    asked = windows(spark, ("p01", 1, "2020-02-01", "2020-02-05"), ("p03", 2, "03/02/2020", None))
    record = R.window_report(sources, asked)
    texts = {r["window_id"]: r["text"] for r in R.render_report(record).collect()}
    assert "- **Nights recorded**: 3" in texts[1] and texts[1].startswith("# Daily report — p01 — 2020-02-01 to 2020-02-05\n")
    assert "(0 min, n/a)" in texts[2] and "- **Last report**: n/a (n/a)" in texts[2] and "- **Latest wellness**: n/a" in texts[2]
    for lines in (R.report_lines(record), R.report_lines(record, W.window_nights(sources["sleep"], asked))):
        got = {}
        for r in lines.orderBy("window_id", "line_no", "sub_no").collect():
            got.setdefault(r["window_id"], []).append(r["line"])
        assert {k: "\n".join(v) + "\n" for k, v in got.items()} == texts
    sinks.write_reports(R.report_lines(record), str(tmp_path / "reports"))
    written = next((tmp_path / "reports").glob("participant_id=p03/window_id=2/*.txt")).read_text()
    assert written == texts[2]


def test_land_and_read_window(spark, sources, tmp_path):
    from daygrain.functions.dates import window_bounds
    path = str(tmp_path / "hr")
    sinks.land(sources["hr"], path)
    assert readers.read_landed(spark, path, window_bounds("2020-02-03 09:00:05")).count() == 3
    plan = readers.read_landed(spark, path, window_bounds("2020-02-03"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_estimates_upsert(spark, tmp_path):
    empty = sinks.load_estimates(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0)], sinks.ESTIMATE_SCHEMA)
    newer = spark.createDataFrame([("b", 2.0, 1.0, 1.0, 1.0), ("c", 2.0, 1.0, 1.0, 1.0)], sinks.ESTIMATE_SCHEMA)
    sinks.save_estimates(sinks.upsert_estimates(empty, rows), str(tmp_path / "v1"))
    out = sinks.upsert_estimates(sinks.load_estimates(spark, str(tmp_path / "v1")), newer)
    assert {r["cache_key"]: r["calories"] for r in out.collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}


def test_reports_are_written_by_several_tasks(spark, tmp_path):
    lines = spark.range(200).select(F.col("id").alias("participant_id"), F.lit(1).alias("window_id"), F.lit(0).alias("line_no"),
                                    F.lit(0).alias("sub_no"), F.lit("x").alias("line"))
    sinks.write_reports(lines, str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("participant_id=*/window_id=1/*.txt"))
    assert len(files) == 200 and len({f.name.split("-")[1] for f in files}) > 1
