"""Trailing windows, fills and labels on small daily tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daygrain.operators import missing as M, rolling as W

START = date(2020, 1, 1)


def days(spark, name, values, kind="double", who="a"):
    rows = [(who, START + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"participant_id string, date date, {name} {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("participant_id", "date").collect()]


def test_forward_fill_golden(spark):
    out = W.causal_ffill(days(spark, "w", [100.0, None, None, None, None, 101.0]), ["w"])
    assert column(out, "w") == [100.0, 100.0, 100.0, None, None, 101.0]
    assert column(out, "was_imputed_w") == [0, 1, 1, 0, 0, 0]


def test_forward_fill_never_uses_the_future_or_others(spark):
    df = days(spark, "w", [None, None, 5.0]).unionByName(days(spark, "w", [None, 7.0, None], who="b"))
    assert column(W.causal_ffill(df, ["w"]), "w") == [None, None, 5.0, None, 7.0, 7.0]


def test_missing_ratio_golden(spark):
    out = column(W.missing_ratios(days(spark, "n_wellness_rows", [1, 1, 0, 0, 1, 1, 1], "int")), "missing_ratio_wellness_7d")
    assert out[3] == 0.5 and out[6] == pytest.approx(2 / 7)


def test_next_day_label_golden(spark):
    out = W.next_day_label(days(spark, "readiness_same_day", [5.0, 6.0, 7.0]))
    assert column(out, "readiness_next_day") == [6.0, 7.0, None]
    assert column(out, "label_available") == [1, 1, 0]


def test_load_features(spark):
    load = [0.0, 300.0, None, 0.0, 450.0, 0.0, 0.0, 120.0]
    out = W.load_features(days(spark, "srpe_load", load)).orderBy("date").collect()
    assert out[0]["monotony_7d"] is None and out[0]["acwr_7_28"] is None
    last = [x for x in load[1:] if x is not None]
    mean = sum(last) / len(last)
    sd = (sum((x - mean) ** 2 for x in last) / (len(last) - 1)) ** 0.5
    assert out[7]["load_7d_sum"] == 870.0 and out[7]["load_7d_mean"] == round(mean, 1)
    assert out[7]["monotony_7d"] == round(mean / sd, 2) and out[7]["strain_7d"] == pytest.approx(870 * mean / sd, abs=0.06)


def test_monotony_of_constant_load_is_unknown(spark):
    out = W.load_features(days(spark, "srpe_load", [0.1] * 9))
    assert column(out, "monotony_7d") == [None] * 9 and column(out, "acwr_7_28") == [1.0] * 9


def test_median_residual_and_window_stats(spark):
    df = days(spark, "weight_raw", [80.0, None, 82.0, 90.0])
    out = W.rolling_median_residual(df, "weight_raw")
    assert column(out, "weight_7d_median") == [80.0, 80.0, 81.0, 82.0]
    assert column(out, "weight_residual") == [0.0, None, 1.0, 8.0]
    stats = W.window_stats(df, ["weight_raw", "absent"])
    assert column(stats, "weight_raw_std_7d")[:2] == [None, None] and column(stats, "weight_raw_mean_7d")[2] == 81.0


def test_injured_and_calendar(spark):
    df = days(spark, "is_injured_day", [0, 1, None, 0, 0, 0, 0, 0, 0], "int")
    assert column(W.rolling_max(df, "is_injured_day", 7, "x"), "x") == [0, 1, 1, 1, 1, 1, 1, 1, 0]
    out = W.calendar_features(df).orderBy("date").collect()
    assert [r["dow"] for r in out[:4]] == [2, 3, 4, 5] and [r["weekend_bin"] for r in out[:4]] == [0, 0, 1, 1]


def test_presence_flags_and_policy(spark):
    df = days(spark, "n_nights", [2, 0, None], "int")
    assert column(M.presence_flags(df), "has_sleep") == [1, 0, 0]
    assert column(M.presence_flags(df), "has_nutrition") == [0, 0, 0]
    both = df.withColumn("hr_mean", F.lit(None).cast("double"))
    out = M.apply_defaults(both)
    assert column(out, "n_nights") == [2, 0, 0] and column(out, "hr_mean") == [None] * 3


def test_spikes(spark):
    df = days(spark, "load", [0.0] * 20 + [500.0])
    assert [r["load"] for r in W.spike_days(df, "load").collect()] == [500.0]
    assert W.spike_days(days(spark, "load", [0.1] * 20), "load").count() == 0
