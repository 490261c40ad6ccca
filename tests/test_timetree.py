"""Windows met through dyadic blocks against a loop over rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daygrain.operators import timetree as T, windowed as W
from daygrain.operators.joins import nights_ending_in

START = datetime(2020, 2, 27)
LAST_MS = timedelta(days=1) - timedelta(milliseconds=1)


def moments(draw, n):
    out = []
    for _ in range(n):
        day = START + timedelta(days=draw.randrange(40))
        out.append(day + draw.choice([timedelta(), LAST_MS, LAST_MS + timedelta(microseconds=draw.choice([1, 500, 999])), timedelta(days=1),
                                      timedelta(seconds=draw.randrange(86400)), timedelta(hours=draw.randrange(24)),
                                      timedelta(microseconds=draw.randrange(86400 * 10**6))]))
    return out


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(6)
    events = [(f"p{i % 3}", t, float(draw.randrange(100)), draw.choice("ab"), i) for i, t in enumerate(moments(draw, 900))]
    events += [(None, START, 1.0, "a", 1000), ("p1", None, 1.0, "a", 1001)]
    windows = []
    for i in range(250):
        a, b = moments(draw, 2)
        if i % 10:
            a, b = min(a, b), max(a, b)
        if i % 4 == 0:
            a, b = a.replace(hour=0, minute=0, second=0, microsecond=0), b.replace(hour=0, minute=0, second=0, microsecond=0) + LAST_MS
        if i % 25 == 1:
            b = a
        windows.append((f"p{i % 4}", i, a, b, bool(draw.randrange(2))))
    frame = spark.createDataFrame(events, "participant_id string, ts timestamp_ntz, value double, kind string, seq long")
    asked = spark.createDataFrame(windows, "participant_id string, window_id int, lower timestamp_ntz, upper timestamp_ntz, inclusive boolean")
    return events, windows, frame, asked


def inside(events, window):
    p, _, a, b, closed = window
    return [e for e in events if e[0] == p and e[1] is not None and a <= e[1] and (e[1] <= b if closed else e[1] < b)]


def aggregates():
    return {"n": T.count("n"), "s": T.total("value", "s"), "top": T.largest("value", "top"),
            "seen": T.known(F.when(F.col("value") > 50, 1), "seen"),
            "last": T.latest(F.col("value"), F.when(F.col("value") > 20, F.col("seq")), "last")}


@pytest.mark.parametrize("sent", [T.SENT_ROWS, 0])
def test_fold_matches_a_loop(data, monkeypatch, sent):
    monkeypatch.setattr(T, "SENT_ROWS", sent)
    events, windows, frame, asked = data
    got = {r["window_id"]: r for r in T.WindowTree(asked).fold(frame, "ts", aggregates()).collect()}
    for w in windows:
        rows = inside(events, w)
        if not rows:
            assert w[1] not in got, w
            continue
        r = got[w[1]]
        late = max(((e[4], e[2]) for e in rows if e[2] > 20), default=None)
        assert (r["n"], r["s"], r["top"], r["seen"]) == (len(rows), sum(e[2] for e in rows), max(e[2] for e in rows), sum(e[2] > 50 for e in rows)), w
        assert (r["last"] and tuple(r["last"])) == late, w


def test_fold_by_key_and_rows_match_a_loop(data):
    events, windows, frame, asked = data
    tree = T.WindowTree(asked)
    got = {(r["window_id"], r["kind"]): r["n"] for r in tree.fold(frame, "ts", {"n": T.count("n")}, ["kind"]).collect()}
    want, pairs = {}, set()
    for w in windows:
        for e in inside(events, w):
            want[w[1], e[3]] = want.get((w[1], e[3]), 0) + 1
            pairs.add((w[1], e[4]))
    assert got == want
    rows = tree.rows(frame, "ts")
    assert rows.columns[:2] == ["participant_id", "window_id"] and {"lower", "upper", "inclusive", "ts", "seq"} <= set(rows.columns)
    found = [(r["window_id"], r["seq"]) for r in rows.collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_whole_days_make_no_cuts_and_few_blocks(spark):
    asked = spark.range(3000).selectExpr("concat('p', id % 5) AS participant_id", "CAST(id AS INT) AS window_id",
                                         "date_add('2019-11-01', CAST(id % 40 AS INT)) AS a", "CAST(1 + id % 150 AS INT) AS days")
    asked = asked.select("participant_id", "window_id", F.col("a").cast("timestamp_ntz").alias("lower"), "days",
                         (F.date_add("a", F.col("days") - 1).cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")).alias("upper"),
                         F.lit(True).alias("inclusive"))
    tree = T.WindowTree(asked)
    assert tree.n_cuts == 0
    per_window = {r["window_id"]: r["count"] for r in tree.blocks.groupBy("window_id").count().collect()}
    for r in asked.select("window_id", "days").collect():
        assert per_window[r["window_id"]] <= 2 * math.ceil(math.log2(2 * r["days"])) + 1
    # Every (participant, slot) is one leaf, whatever the number of windows.
    events = spark.range(20000).selectExpr("concat('p', id % 5) AS participant_id", "1.0D AS value",
                                           "CAST(timestamp_micros(1572566400000000 + id * 700000000) AS TIMESTAMP_NTZ) AS ts")
    out = tree.fold(events, "ts", {"n": T.count("n")})
    assert "sequence(cast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["window_id"]: r["n"] for r in out.collect()}
    counted = asked.join(events, "participant_id").where("ts >= lower AND ts <= upper").groupBy("window_id").count().collect()
    assert got == {r["window_id"]: r["count"] for r in counted}


def test_no_windows_and_no_rows(data):
    _, _, frame, asked = data
    assert T.WindowTree(asked.where("false")).fold(frame, "ts", aggregates()).count() == 0
    assert T.WindowTree(asked).fold(frame.where("false"), "ts", aggregates()).count() == 0
    assert T.WindowTree(asked.where("false")).rows(frame, "ts").count() == 0
    assert W.activity_window(frame.withColumn("metric", F.lit("steps")), asked.where("false")).count() == 0


def test_nights_start_no_earlier_than_the_day_before(spark):
    asked = spark.createDataFrame([("a", 1, datetime(2020, 2, 3), datetime(2020, 2, 3, 23, 59, 59, 999000), True)],
                                  "participant_id string, window_id int, lower timestamp_ntz, upper timestamp_ntz, inclusive boolean")
    nights = spark.createDataFrame([("a", datetime(2020, 2, 2, 23), datetime(2020, 2, 3, 7), 1), ("a", datetime(2020, 2, 1, 23), datetime(2020, 2, 3, 1), 2),
                                    ("a", datetime(2020, 2, 3, 23), datetime(2020, 2, 4, 7), 3)],
                                   "participant_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, seq int")
    assert [r["seq"] for r in nights_ending_in(nights, asked).collect()] == [1]


def test_what_no_window_is_made_of_is_dropped_before_the_shuffle(data):
    _, _, frame, asked = data
    tree = T.WindowTree(asked.where("window_id = 4"))
    lower, upper = next(w for w in data[1] if w[1] == 4)[2:4]
    placed = tree._placed(frame, "ts")
    days = {r["ts"].date() for r in placed.select("ts").collect()}
    assert days and all(lower.date() <= d <= upper.date() for d in days) and placed.count() < frame.count()
    kept = tree._raised(placed).select("_axis", "_level", "_node").distinct()
    assert kept.join(tree.blocks, ["_axis", "_level", "_node"], "left_anti").count() == 0
