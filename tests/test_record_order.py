"""First-wins and last-wins rules over several files, whatever their sizes; sessions without a shared folder."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daygrain.operators import daily
from daygrain.sources import readers

REPO = Path(__file__).resolve().parents[1]


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in records))


def minute(value, stamp="2020-02-03 08:00:00"):
    return {"participant_id": "a", "dateTime": stamp, "value": str(value)}


def test_order_is_by_file_and_record(spark, tmp_path):
    # The first record stands in the smallest file; Spark reads the largest file first.
    write(tmp_path / "steps.json" / "part-0.json", [minute(1)])
    write(tmp_path / "steps.json" / "part-1.json", [minute(2)] + [minute(9, f"2020-02-04 {h:02d}:{m:02d}:00") for h in range(24) for m in range(60)])
    write(tmp_path / "steps.json" / "part-2.json", [minute(3), minute(4)])
    raw = readers.read_minute(spark, str(tmp_path), "steps")
    at = raw.where(F.col("ts") == F.lit("2020-02-03 08:00:00").cast("timestamp_ntz"))
    assert [r["value"] for r in at.orderBy("seq").collect()] == [1.0, 2.0, 3.0, 4.0]
    kept = daily.dedupe_minutes(raw).where(F.to_date("ts") == "2020-02-03").first()
    assert kept["value"] == 1.0
    assert raw.select("seq").distinct().count() == raw.count()


def test_last_write_over_several_files(spark, tmp_path):
    beat = lambda bpm: {"participant_id": "a", "dateTime": "2020-02-03 08:00:00", "value": {"bpm": bpm, "confidence": 1}}
    write(tmp_path / "heart_rate.json" / "part-0.json", [beat(50 + i % 3) for i in range(500)])
    write(tmp_path / "heart_rate.json" / "part-1.json", [beat(77)])
    assert [r["bpm"] for r in readers.read_hr(spark, str(tmp_path)).collect()] == [77]


def test_small_blocks_keep_the_order(spark, tmp_path):
    write(tmp_path / "steps.json" / "part-0.json", [minute(i) for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = readers.read_minute(spark, str(tmp_path), "steps")
        rows = raw.orderBy("seq").collect()
        assert [r["value"] for r in rows] == [float(i) for i in range(3000)]
        assert len({int(r["seq"]) // 10 ** 11 for r in rows}) > 5  # many blocks of one file
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config(
    "spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from catalog import QUERIES
from daygrain.session import checkpoint_dir
try:
    checkpoint_dir(spark)
    print("NO ERROR")
except RuntimeError as error:
    print("ERROR", error)
spark.sparkContext.setCheckpointDir({folder!r})
for name in ("confirmed_components", "scan_minutes"):
    print("ROWS", name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_plain_session(tmp_path):
    """A session without the machine's defaults: a clear error without a folder, results with one, nothing left behind."""
    (tmp_path / "conf").mkdir()
    (tmp_path / "shared").mkdir()
    import os
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), folder=str(tmp_path / "shared"))], capture_output=True,
                          text=True, timeout=300, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")})
    lines = done.stdout.splitlines()
    assert any(x.startswith("ERROR set spark.checkpoint.dir") for x in lines), done.stderr[-2000:]
    assert sum(x.startswith("ROWS") for x in lines) == 2, done.stderr[-2000:]
    assert not list((tmp_path / "shared").glob("**/export-*"))


@pytest.mark.parametrize("layout", ["combined", "tree"])
def test_absent_source_has_the_same_type(spark, tmp_path, layout):
    if layout == "combined":
        write(tmp_path / "steps.json" / "part-0.json", [minute(1)])
    else:
        (tmp_path / "p" / "watch").mkdir(parents=True)
        (tmp_path / "p" / "watch" / "steps.json").write_text(json.dumps([minute(1)]))
    full, empty = readers.read_minute(spark, str(tmp_path), "steps"), readers.read_minute(spark, str(tmp_path), "distance")
    assert full.schema == empty.schema and full.count() == 1 and empty.count() == 0
