"""Streams in any order of arrival against the batch operators."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from daygrain.operators import daily, runs as R
from daygrain.streaming import live as L

START = datetime(2020, 2, 3, 22, 0)
SCHEMA = "p string, ts timestamp_ntz, file string"


def arrive(spark, folder, batches, schema):
    """A stream that gets one batch of rows at a time."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def batches_of(draw, rows, lateness, n):
    """Rows in an order that no row is later than ``lateness`` in, in n batches."""
    placed = sorted(rows, key=lambda r: (datetime.fromisoformat(r["ts"]) + timedelta(seconds=draw.random() * lateness), draw.random()))
    size = -(-len(placed) // n)
    return [placed[i:i + size] for i in range(0, len(placed), size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bursts_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [{"p": draw.choice("abc"), "ts": str(START + timedelta(seconds=draw.choice([15, 15.5, 40]) * draw.randrange(400))), "file": f"f{i % 70}"}
            for i in range(300)]
    batches = batches_of(draw, rows, 590, 9) + [[{"p": "z", "ts": "2020-02-09 00:00:00", "file": "end"}], [{"p": "a", "ts": None, "file": "x"}]]
    out = L.run_to_end(L.live_bursts(arrive(spark, tmp_path / "in", batches, SCHEMA), ["p"], "ts", "file", 15, "10 minutes"))
    frame = spark.createDataFrame([(r["p"], datetime.fromisoformat(r["ts"]), r["file"]) for r in rows], "p string, ts timestamp_ntz, file string")
    want = R.burst_representatives(R.burst_groups(frame, ["p"], "ts", "file", 15), ["p"], "ts", "file").drop("burst")
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_late_event_joins_two_bursts_and_a_later_one_is_left_out(spark, tmp_path):
    def at(minutes, name="f"):
        return {"p": "a", "ts": str(START + timedelta(minutes=minutes)), "file": name}

    batches = [[at(0), at(20)], [at(25)], [at(10, "late")], [at(120)], [at(121)], [at(1, "too late")], [at(300)]]
    out = L.run_to_end(L.live_bursts(arrive(spark, tmp_path / "in", batches, SCHEMA), ["p"], "ts", "file", 600, "30 minutes"))
    found = sorted((r["first_ts"], r["last_ts"], r["n_events"]) for r in out.collect())
    assert found == [(START, START + timedelta(minutes=25), 4), (START + timedelta(minutes=120), START + timedelta(minutes=121), 2)]


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    batches = [[{"p": "a", "ts": str(START + timedelta(hours=h, seconds=s)), "file": "f"} for s in range(0, 3000, 100)] for h in range(0, 12, 2)]
    stream = L.live_bursts(arrive(spark, tmp_path / "in", batches, SCHEMA), ["p"], "ts", "file", 15, "10 minutes")
    query = stream.writeStream.format("memory").queryName("dropped").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 6 and max(held) <= 2 * 30 and held[-1] <= 30


def test_days_in_any_order(spark, tmp_path):
    draw = random.Random(5)
    rows = [{"participant_id": draw.choice("ab"), "metric": draw.choice(["steps", "distance", "calories"]),
             "ts": str(START + timedelta(minutes=draw.randrange(3000))), "value": float(draw.randrange(100)), "seq": i} for i in range(1500)]
    schema = "participant_id string, metric string, ts timestamp_ntz, value double, seq long"
    batches = batches_of(draw, rows, 3500, 7) + [[rows[0] | {"participant_id": "z", "ts": "2020-02-20 00:00:00"}]]
    out = L.run_to_end(L.live_activity(arrive(spark, tmp_path / "in", batches, schema)))
    frame = spark.createDataFrame([(r["participant_id"], r["metric"], datetime.fromisoformat(r["ts"]), r["value"], r["seq"]) for r in rows],
                                  "participant_id string, metric string, ts timestamp_ntz, value double, seq long")
    want = daily.activity_daily(frame)
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
