"""Runs, bursts, pairs and components against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daygrain.operators import joins as J, runs as R
from daygrain.operators.joins import day_spine
from daygrain.operators.ordered import with_position, with_previous

T0 = datetime(2020, 1, 1)
DAY = 1440


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def random_minutes(seed, days=3, share=0.02):
    rng = random.Random(seed)
    minutes = range(days * DAY)
    steps = {m: rng.choice([0, 0, 5]) for m in minutes if rng.random() < share}
    beats = {m: [rng.choice([60.0, 61.0]) for _ in range(rng.choice([1, 2, 3]))] for m in minutes if rng.random() < share}
    return steps, beats


def unworn(steps, beats, minutes):
    return [steps.get(m, 0) == 0 and (m not in beats or (len(beats[m]) >= 2 and len(set(beats[m])) == 1)) for m in minutes]


def long_runs(flags, least=60):
    out, start = [], None
    for i, flag in enumerate([*flags, False]):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            if i - start >= least:
                out.append((start, i - 1))
            start = None
    return out


def wear_frames(spark, people):
    steps = [(p, at(60 * m), float(v)) for p, (s, _) in people.items() for m, v in s.items()]
    beats = [(p, at(60 * m + 5 * i), b) for p, (_, h) in people.items() for m, bs in h.items() for i, b in enumerate(bs)]
    return (spark.createDataFrame(steps, "participant_id string, ts timestamp_ntz, value double"),
            spark.createDataFrame(beats, "participant_id string, ts timestamp_ntz, bpm double"))


@pytest.mark.parametrize("share", [0.002, 0.02])
def test_nonwear_equals_the_minute_grid(spark, share):
    people = {f"p{i}": random_minutes(i, share=share) for i in range(6)}
    steps, hr = wear_frames(spark, people)
    who = spark.createDataFrame([(p,) for p in people], "participant_id string")
    spine = day_spine(who, "2020-01-01", "2020-01-03")
    got = {(r["participant_id"], r["date"].day - 1): r["nonwear_min"] for r in R.nonwear_daily(steps, hr, spine).collect()}
    for p, (s, h) in people.items():
        for day in range(3):
            flags = unworn(s, h, range(day * DAY, (day + 1) * DAY))
            assert got[p, day] == sum(b - a + 1 for a, b in long_runs(flags))
    horizon = {(r["participant_id"], r["_from"], r["_to"]) for r in
               R.nonwear_runs(steps, hr, who, "2020-01-01", "2020-01-03").collect()}
    expected = {(p, a, b) for p, (s, h) in people.items() for a, b in long_runs(unworn(s, h, range(3 * DAY)))}
    assert horizon == expected
    per_day = R.nonwear_horizon(steps, hr, who, "2020-01-01", "2020-01-03").groupBy().sum("nonwear_min").first()[0]
    assert per_day == sum(b - a + 1 for _, a, b in expected)


@pytest.mark.parametrize("zeros, beats, expected", [(60, 0, 60), (59, 0, 0), (60, 1, 0), (60, 2, 60)])
def test_nonwear_golden(spark, zeros, beats, expected):
    steps = spark.createDataFrame([("a", at(60 * m), 0.0 if 600 <= m < 600 + zeros else 5.0) for m in range(DAY)],
                                  "participant_id string, ts timestamp_ntz, value double")
    samples = [("a", at(60 * m + i), 70.0) for m in range(600, 600 + zeros) for i in range(beats)]
    hr = spark.createDataFrame(samples or [("a", at(0), 70.0)], "participant_id string, ts timestamp_ntz, bpm double")
    spine = day_spine(spark.createDataFrame([("a",)], "participant_id string"), "2020-01-01", "2020-01-01")
    assert R.nonwear_daily(steps, hr, spine).first()["nonwear_min"] == expected


def stamps(spark, seconds, key="a"):
    return spark.createDataFrame([(key, i, at(s)) for i, s in enumerate(seconds)], "k string, id int, ts timestamp_ntz")


def test_burst_golden(spark):
    groups = R.burst_groups(stamps(spark, [0, 10, 20, 10820]), ["k"], "ts", "id", 15)
    assert sorted(r["burst"] for r in groups.collect()) == [1, 1, 1, 2]
    first = R.burst_representatives(groups, ["k"], "ts", "id").orderBy("burst").first()
    assert (first["representative"], first["n_events"]) == (0, 3)
    edge = R.burst_groups(stamps(spark, [0, 15, 31]), ["k"], "ts", "id", 15)
    assert sorted(r["burst"] for r in edge.collect()) == [1, 1, 2]


def test_ordered_helpers_cross_chunks_and_ties(spark):
    rng = random.Random(3)
    seconds = [rng.randrange(0, 5 * 3600) for _ in range(400)] + [3600] * 200
    df = stamps(spark, seconds)
    order = sorted(range(len(seconds)), key=lambda i: (seconds[i], i))
    prev = {r["id"]: r["p"] for r in with_previous(df, ["k"], "ts", ["ts", "id"], {"p": "id"}).collect()}
    pos = {r["id"]: r["position"] for r in with_position(df, ["k"], "ts", ["ts", "id"]).collect()}
    assert [prev[i] for i in order] == [None, *order[:-1]]
    assert [pos[i] for i in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("width", [15, 1800, 9000])
def test_pairs_equal_brute_force(spark, width):
    rng = random.Random(7)
    seconds = [rng.randrange(0, 20000) for _ in range(150)] + [500] * 4
    df = stamps(spark, seconds)
    want = {(a, b) for a in range(len(seconds)) for b in range(len(seconds))
            if 0 <= seconds[b] - seconds[a] <= width and (seconds[a], a) < (seconds[b], b)}
    got = {(r["id_1"], r["id_2"]) for r in J.pairs_within(df, "k", "ts", "id", width).collect()}
    assert got == want
    assert R.pair_counts_within(df, "k", "ts", width).first()["n_pairs"] == len(want)


def test_adjacency_golden(spark):
    pairs = J.pairs_within(stamps(spark, [0, 600]), "k", "ts", "id", 1800)
    assert {(r["node"], r["neighbour"]) for r in J.adjacency(pairs, "k", "id").collect()} == {(0, 1), (1, 0)}


def test_components_equal_union_find(spark):
    rng = random.Random(11)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(0, i) for i in range(600, 700)]
    nodes = list(range(n)) + list(range(400, 461)) + list(range(600, 700))
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    out = R.components(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(v,) for v in nodes], "node int"))
    assert {r["node"]: r["component"] for r in out.collect()} == {v: find(v) for v in nodes}


def test_run_length_encoding(spark):
    df = stamps(spark, [0, 60, 120, 180, 240]).withColumn("flag", F.col("id").isin(0, 1, 3))
    out = R.runs(df, ["k"], "ts", "id", "flag").orderBy("run").collect()
    assert [(r["run"], r["n_rows"]) for r in out] == [(1, 2), (2, 1)]


def test_threshold_sweep(spark):
    rows = [(5.0, True), (15.0, False), (100.0, True), (1700.0, False)]
    out = R.threshold_sweep(spark.createDataFrame(rows, "gap_s double, same_meal boolean")).orderBy("threshold_s").collect()
    assert [(r["n_pairs"], r["n_confirmed"]) for r in out] == [(2, 1), (2, 1), (3, 2), (3, 2), (4, 2)]


def test_sweep_without_pairs(spark):
    draw = random.Random(8)
    start = datetime(2020, 2, 3, 23, 30)
    events = [(draw.choice("ab"), start + timedelta(seconds=draw.choice([0, 0, 1, 15, 60, 61, 3600, 7200]) + draw.randrange(3) * 0.5 + 86400 * draw.randrange(2)),
               draw.choice([0, 1, None])) for _ in range(150)] + [("a", None, 1), (None, start, 1)]
    frame = spark.createDataFrame(events, "p string, ts timestamp_ntz, label int")
    for thresholds in ([15, 60, 1800, 7200], [1]):
        out = R.pair_sweep(frame, "p", "ts", F.col("label"), thresholds, ["p"]).collect()
        for r in out:
            mine = [e for e in events if e[0] == r["p"] and e[1] is not None]
            near = [(a, b) for i, a in enumerate(mine) for b in mine[:i] if abs((a[1] - b[1]).total_seconds()) <= r["threshold_s"]]
            assert r["n_pairs"] == len(near) and r["n_confirmed"] == sum(a[2] is not None and a[2] == b[2] for a, b in near)
        assert len(out) == 2 * len(thresholds)
    plan = R.pair_sweep(frame, "p", "ts", F.col("label"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    hot = spark.range(200_000).selectExpr("'a' AS p", "CASE WHEN id % 2 = 0 THEN TIMESTAMP_NTZ'2020-02-03 00:00:00' ELSE timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2020-02-03 00:00:00') END AS ts", "1 AS label")
    found = R.pair_sweep(hot, "p", "ts", F.col("label"), [15]).first()
    n = 100_000
    assert found["n_pairs"] == found["n_confirmed"] == n * (n - 1) // 2 + 8 * n + sum(min(7, n - 1 - i) for i in range(n))
