"""Column functions against values computed here, most of them by another way than the functions take."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from daygrain.functions import cleaning as C, dates as D, encoding as E
from daygrain.functions.text import format_distance, format_value


def column(spark, values, fn, dtype="string"):
    """``fn`` of each value, in order, in one job."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {dtype}")
    return [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def stamps(n, seed):
    rng = random.Random(seed)
    first = datetime(1998, 1, 1)
    return [first + timedelta(milliseconds=rng.randrange(10 ** 12)) for _ in range(n)]


def canonical(t):
    return t.strftime("%Y-%m-%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}"


SHAPES = {
    "iso": lambda t: t.isoformat(sep=" ", timespec="milliseconds"),
    "iso with T": lambda t: t.isoformat(timespec="milliseconds"),
    "utc mark": lambda t: t.isoformat(timespec="milliseconds") + "Z",
    "zone": lambda t: t.isoformat(sep=" ", timespec="milliseconds") + "-05:30",
    "microseconds": lambda t: t.isoformat(sep=" ", timespec="milliseconds") + "777",
    "camera": lambda t: t.strftime("%Y:%m:%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}",
    "year first": lambda t: t.strftime("%Y/%m/%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}",
    "day first": lambda t: t.strftime("%d/%m/%Y %H:%M:%S.") + f"{t.microsecond // 1000:03d}",
    "short day first": lambda t: f"  {t.day}/{t.month}/{t.year % 100:02d} " + t.strftime("%H:%M:%S.") + f"{t.microsecond // 1000:03d}",
    "half day": lambda t: t.strftime("%d/%m/%Y ") + f"{t.hour % 12 or 12}" + t.strftime(":%M:%S.") + f"{t.microsecond // 1000:03d}"
    + (" pm" if t.hour >= 12 else " AM"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_every_shape_reads_back(spark, shape):
    times = stamps(40, shape)
    if "short" in shape:  # two digits name a year of this century
        times = [t.replace(year=2000 + t.year % 100) for t in times if (t.month, t.day) != (2, 29)]
    texts = [SHAPES[shape](t) for t in times]
    assert column(spark, texts, lambda c: D.std_text(D.std_ts(c))) == [canonical(t) for t in times]
    assert [D.window_bounds(x).lower for x in texts[:10]] == [t.replace(microsecond=t.microsecond // 1000 * 1000) for t in times[:10]]


def test_month_first_only_where_day_first_is_no_date(spark):
    days = [(d, m) for d in (1, 12, 13, 28) for m in (1, 12)]
    got = column(spark, [f"{m:02d}/{d:02d}/2021" for d, m in days], lambda c: F.to_date(D.std_ts(c)).cast("string"))
    assert got == [f"2021-{m:02d}-{d:02d}" if d > 12 else f"2021-{d:02d}-{m:02d}" for d, m in days]


def test_explicit_pattern_overrides(spark):
    got = column(spark, ["03~2017~30", "31~2017~12"], lambda c: D.std_text(D.std_ts(c, "MM~yyyy~dd")))
    assert got == ["2017-03-30 00:00:00.000", None]


def test_no_date_is_null(spark):
    assert column(spark, ["", "   ", None, "soon", "2021-13-45", "99/99/2021", "13:00 pm", "1/2/2021 13:00 pm"], lambda c: D.std_ts(c)) == [None] * 8


def test_date_only(spark):
    t = datetime(2018, 7, 9, 5, 4)
    whole = [t.strftime(f) for f in ("%Y-%m-%d", "%d/%m/%Y", "%d/%m/%y", "%Y/%m/%d", "%Y:%m:%d", " %d/%m/%Y ")]
    timed = [t.strftime(f) for f in ("%Y-%m-%d %H:%M", "%d/%m/%Y %H", "%Y:%m:%d %H:%M:%S")] + ["", "July"]
    assert column(spark, whole + timed, D.is_date_only) == [True] * len(whole) + [False] * len(timed)


def test_window_bounds_and_columns_agree(spark):
    asked = [("2018-07-09", None), ("2018-07-09 06:15:00", None), ("2018:07:09 06:15:00", "2018/07/11"), ("9/7/18", "11/07/2018 04:30:00"),
             ("2018-07-09", "2018-07-10T00:00:00"), ("9/7/2018 6:15:00 pm", "10/7/2018")]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, a string, b string")
    got = [tuple(r)[1:] for r in rows.select("i", *D.bound_columns("a", "b")).orderBy("i").collect()]
    assert got == [tuple(D.window_bounds(*a)) for a in asked]
    last = timedelta(milliseconds=1)
    assert got[0] == (datetime(2018, 7, 9), datetime(2018, 7, 10) - last, True)
    assert got[2] == (datetime(2018, 7, 9, 6, 15), datetime(2018, 7, 12) - last, True)
    assert got[3] == (datetime(2018, 7, 9), datetime(2018, 7, 11, 4, 30), False)
    assert D.days_between_inclusive("2016-02-20", "2016-03-05") == 15  # over a leap day


def test_lag_is_the_difference_in_days(spark):
    pairs = list(zip(stamps(20, "a"), stamps(20, "b")))
    rows = spark.createDataFrame([(i, canonical(a), canonical(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", D.lag_days(D.std_ts("a"), D.std_ts("b")).alias("o")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        exact = (b.replace(microsecond=b.microsecond // 1000 * 1000) - a.replace(microsecond=a.microsecond // 1000 * 1000)) / timedelta(days=1)
        assert r["o"] == pytest.approx(exact, abs=0.0051)


def test_midsleep_is_halfway_on_the_clock(spark):
    nights = [(on / 4, length / 4) for on in range(0, 96, 7) for length in range(1, 60, 9)]
    rows = spark.createDataFrame([(i, on, (on + n) % 24) for i, (on, n) in enumerate(nights)], "i int, a double, b double")
    got = [r["o"] for r in rows.select("i", D.midsleep("a", "b").alias("o")).orderBy("i").collect()]
    for (on, n), o in zip(nights, got):
        angle = 2 * math.pi * ((on + n / 2) - o) / 24
        assert math.cos(angle) == pytest.approx(1, abs=1e-5) and 0 <= o <= 24


def test_scales_keep_what_lies_inside(spark):
    values = [None, "x", *map(str, range(-1, 13)), "2.5"]

    def inside(lo, hi):
        return [float(v) if v not in (None, "x") and lo <= float(v) <= hi else None for v in values]
    rows = spark.createDataFrame([(i, v, v, v) for i, v in enumerate(values)], "i int, mood string, readiness string, sleep_duration_h string")
    out = C.clean_wellness(rows).orderBy("i").collect()
    assert [r["mood"] for r in out] == inside(1, 5)
    assert [r["readiness_clean"] for r in out] == inside(1, 10)
    assert [r["sleep_duration_h"] for r in out] == inside(0.001, 99)
    assert C.clean_readiness(rows.drop("readiness")).first()["readiness_clean"] is None


def test_resting_rate_needs_a_date_and_a_value(spark):
    cases = [(d, v) for d in (None, "", "  ", "07/09/18") for v in (None, -2.0, 0.0, 48.25)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d string, v double")
    got = [r["o"] for r in rows.select("i", C.clean_rhr("v", "d").alias("o")).orderBy("i").collect()]
    assert got == [48.25 if d == "07/09/18" and v == 48.25 else None for d, v in cases]


def test_heart_rate_clip_and_trust(spark):
    beats = [None, 0.0, 29.9, 30.0, 133.0, 220.0, 220.5, 999.0]
    assert column(spark, beats, lambda c: C.clip(c, 30, 220), "double") == [None if b is None else min(max(b, 30.0), 220.0) for b in beats]
    assert column(spark, beats, C.out_of_hr_range, "double") == [b is not None and not 30 <= b <= 220 for b in beats]
    assert column(spark, [None, 0, 1, 3], C.trusted_sample, "int") == [True, False, True, True]


def test_strides_and_bouts(spark):
    strides = [None, 0.0, 19.99, 20.0, 77.5]
    assert column(spark, strides, C.clean_stride, "double") == [None, None, None, 20.0, 77.5]
    bouts = [(90_000, 5), (None, 150_000), (None, None), (0, 600_000), (1_799, None), (1_801, None)]
    rows = spark.createDataFrame([(i, *b) for i, b in enumerate(bouts)], "i int, a long, d long")
    out = rows.select("i", C.bout_minutes("a", "d").alias("m")).orderBy("i").collect()
    assert [r["m"] for r in out] == pytest.approx([1.5, 2.5, 0.0, 0.0, 1799 / 60000, 1801 / 60000])
    assert column(spark, [0.0, 0.0299, 0.0301, 2.0], C.real_bout, "double") == [False, False, True, True]


def test_literals(spark):
    maps = [{}, {"right_knee": "major"}, {"a b": "x", "c": "y"}]
    assert column(spark, [repr(m) for m in maps] + ["{", "7", None, "['z']"], E.parse_map) == maps + [{}] * 4
    lists = [[], ["Solo", " Long Run "], ["", " ", "x"]]
    assert column(spark, [repr(x) for x in lists] + ["[", None, "{}"], E.parse_list) == [[], ["solo", "long run"], ["x"], [], [], []]
    sore = column(spark, ["['hip', 'toe', 'arm']", "[]", None], E.soreness)
    assert [tuple(s) for s in sore] == [(["hip", "toe", "arm"], True, 3), ([], False, 0), ([], False, 0)]
    assert column(spark, ["YES", "no ", "y", "", None], E.yes_no) == [1, 0, None, None, None]
    assert column(spark, [" Snack ,,Supper,", "", None], E.split_set) == [["Snack", "Supper"], [], []]


def test_activity_flags(spark):
    names = [["Indoor Soccer", "WALK"], [], None, ["rest"]]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, names array<string>")
    for r, said in zip(rows.select("i", *E.activity_flags("names")).orderBy("i").collect(), names):
        want = {f"act_{label}": int(any(label in n.lower() for n in said or [])) for label in E.ACTIVITY_LABELS}
        assert {k: v for k, v in r.asDict().items() if k != "i"} == want


def test_training_impulse_is_weighted_minutes(spark):
    rng = random.Random(8)
    days = [{z: float(rng.randrange(200)) for z in E.ZONE_KEYS if rng.random() < 0.8} | {"UNKNOWN": 50.0} for _ in range(12)]
    got = column(spark, days + [None], E.trimp, "map<string,double>")
    assert got == [float(sum((1 + E.ZONE_KEYS.index(z)) * v for z, v in d.items() if z in E.ZONE_KEYS)) for d in days] + [None]


def test_macros_and_keys(spark):
    kind = "struct<calories:string,protein:string,carbohydrates:string,fats:string>"
    good, bad = ("0", "1.5", "2", "3"), [("0", "1", "2", None), ("0", "1", "-0.1", "3"), ("0", "1", "2", "NaN"), ("many", "1", "2", "3")]
    assert [x is not None for x in column(spark, [good, *bad], C.valid_macros, kind)] == [True] + [False] * 4
    files = [["/u/z.jpg", "/v/m.jpg", "a.jpg"], ["m.jpg", "a.jpg", "z.jpg"]]
    keys = column(spark, files, lambda c: E.estimate_key(F.lit("q7"), F.lit("2018-07-09"), c), "array<string>")
    assert keys == ["q7|2018-07-09|a.jpg,m.jpg,z.jpg"] * 2


def test_distance_text(spark):
    values = [0.5, 99.0, 100.0, 3456.0, 99_999.0, 100_000.0, 4_219_500.0]
    units = [(1, "cm")] * 2 + [(100, "m")] * 3 + [(100_000, "km")] * 2
    assert column(spark, values, format_distance, "double") == [f"{v / by:.6g} {unit}" for v, (by, unit) in zip(values, units)]
    assert column(spark, [None], format_distance, "double") == ["n/a"]


@pytest.mark.parametrize("values, dtype, expected", [
    ([0.25, -3.0, None], T.DoubleType(), ["0.3", "-3.0", "n/a"]), ([False, True, None], T.BooleanType(), ["No", "Yes", "n/a"]),
    ([0, 42], T.IntegerType(), ["0", "42"]), ([["q"], ["q", "r", "s"], [], None], T.ArrayType(T.StringType()), ["q", "q, r, s", "n/a", "n/a"]),
    ([{"hip": "sore"}, {}], T.MapType(T.StringType(), T.StringType()), ["hip: sore", "n/a"])])
def test_format_value(spark, values, dtype, expected):
    assert column(spark, values, lambda c: format_value(c, dtype), dtype.simpleString()) == expected


def test_suspicious_name(spark):
    names = ["ab" * 15, "ab" * 14 + "a", "deadbeef-" * 4 + ".jpg", "plate.PNG", "plate.jpeg", "G" * 40]
    assert column(spark, names, C.suspicious_name) == [True, False, True, True, False, False]
