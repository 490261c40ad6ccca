"""Arrays cut at every place give the records of the whole file."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from daygrain.functions import dates as D
from daygrain.sources import json_arrays as J, readers as R

SCHEMA = T.StructType().add("dateTime", "string").add("value", T.StructType().add("bpm", "string").add("note", "string"))
HARD = ['plain', '}', '},{', '{"a": 1}', 'a "quoted" }, {', 'back\\slash', 'end\\', '\\"}', '[', ']', '"', '', 'ünï 漢字 }', '}}}', '\\\\"}{']


def records(n=40, seed=1):
    draw = random.Random(seed)
    return [{"dateTime": f"2020-02-{1 + i % 9:02d} 08:{i % 60:02d}:00", "value": {"bpm": str(i), "note": draw.choice(HARD) + draw.choice(HARD)}}
            for i in range(n)]


def layouts(rows):
    return {"one line": json.dumps(rows), "indented": json.dumps(rows, indent=2), "tight": json.dumps(rows, separators=(",", ":")),
            "escaped": json.dumps(rows, ensure_ascii=True), "mark": "﻿ \n" + json.dumps(rows, ensure_ascii=False),
            "lines": "\n".join(json.dumps(r) for r in rows)}


def put(folder, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.json").write_bytes(text.encode())
    return str(folder)


def plain(df):
    return [(r["dateTime"], r["bpm"], r["note"]) for r in df.orderBy("file", "block", "at").select("dateTime", "value.*").collect()]


def want(rows):
    return [(r["dateTime"], r["value"]["bpm"], r["value"]["note"]) for r in rows]


@pytest.fixture
def split(spark):
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("layout", layouts([]))
@pytest.mark.parametrize("size", [None, 700, 61])
def test_equal_rows_for_every_layout(spark, tmp_path, split, layout, size):
    rows = records()
    path = put(tmp_path / "a", layouts(rows)[layout])
    if size:
        split(size)
    out = J.read_array(spark, path, SCHEMA)
    assert plain(out) == want(rows)
    if size:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 3


def batches(blocks):
    """Blocks as the text reader gives them: a piece belongs to the block that its first byte, or the brace before it, is in."""
    for start, pieces in blocks:
        for at in range(0, len(pieces), 3):
            some = pieces[at:at + 3]
            yield pa.RecordBatch.from_arrays([pa.array([7] * len(some)), pa.array([start] * len(some)), pa.array(some, pa.string())],
                                             names=["file", "block", "value"])


def blocks_at(data, cuts):
    """(start, pieces) of the blocks between the cuts, by the rule of record readers."""
    edges, pieces, at = [0, *cuts, len(data)], [], 0
    for part in data.split(b"}"):
        pieces.append((at, part.decode()))
        at += len(part) + 1
    if not pieces[-1][1]:
        pieces.pop()
    owned = {start: [] for start in edges[:-1]}
    for start, text in pieces:
        # A block passes over what it starts in, and reads on until a separator lies behind its end.
        owner = max((e for e in edges[:-1] if e < start), default=0)
        owned[owner].append(text)
    return [(start, texts) for start, texts in owned.items() if texts]


def starts_of(spark, blocks):
    table = pa.Table.from_batches(J.summarise(batches(blocks))).to_pylist()
    quoted = depth = 0
    out = {}
    for row in table:
        out[row["file"], row["block"]] = (table[0]["base"], quoted % 2, depth)
        depth += row["inside"] if quoted % 2 else row["outside"]
        quoted += row["quotes"]
    return out


def cut_rows(spark, blocks):
    parts = pa.Table.from_batches(list(J.record_cutter(starts_of(spark, blocks))(batches(blocks)))).to_pylist()
    found, fragment = [], ""
    for p in sorted(parts, key=lambda p: (p["block"], p["kind"] == J.OPEN, p["at"])):
        if p["kind"] is None:
            found.append(json.loads(p["record"]))
        elif p["kind"] == J.OPEN:
            fragment = p["record"]
        else:
            fragment += "}" + p["record"]
            if p["kind"] == J.CLOSE:
                found.append(json.loads(fragment.lstrip(J.BETWEEN)))
    return found


@pytest.mark.parametrize("layout", ["one line", "indented", "lines"])
def test_every_cut_position(spark, layout):
    rows = records(6, seed=4)
    data = layouts(rows)[layout].encode()
    for cut in range(1, len(data)):
        assert cut_rows(spark, blocks_at(data, [cut])) == rows, cut


def test_many_cuts(spark):
    draw = random.Random(8)
    for seed in range(60):
        rows = records(9, seed)
        data = layouts(rows)[draw.choice(list(layouts([])))].removeprefix("﻿").encode()
        cuts = sorted(draw.sample(range(1, len(data)), draw.randrange(1, 40)))
        assert cut_rows(spark, blocks_at(data, cuts)) == rows, (seed, cuts)


def test_cut_positions_of_the_scan(spark, tmp_path, split):
    rows = records(8, seed=3)
    path = put(tmp_path / "a", layouts(rows)["tight"])
    for size in (23, 37, 52, 90, 133):
        split(size)
        assert plain(J.read_array(spark, path, SCHEMA)) == want(rows), size


def test_quotes_after_backslashes():
    texts = pa.array(["{", 'a"b', '"\\"', '"\\\\"', '"{\\\\\\"[', "]]", "", '"}"'.replace("}", "[")])
    quotes, outside, inside = J.structure(texts)
    assert quotes.tolist() == [0, 1, 1, 2, 1, 0, 0, 2]
    assert outside.tolist() == [1, 0, 0, 0, 0, -2, 0, 0]
    assert inside.tolist() == [0, 0, 0, 0, 2, 0, 0, 1]
    sliced = J.structure(texts.slice(3, 3))
    assert [x.tolist() for x in sliced] == [[2, 1, 0], [0, 0, -2], [0, 2, 0]]


def test_odd_files(spark, tmp_path):
    for name, text, n in (("none", "[]", 0), ("blank", " \n", 0), ("zero", "", 0), ("object", '{"dateTime": "2020-02-01", "value": {"bpm": "1"}}', 1),
                          ("scalars", '[1, {"dateTime": "x"}, 2, "}", null]', 1), ("cut off", '[{"dateTime": "x"}, {"dateTime": "y", "val', 1)):
        out = J.read_array(spark, put(tmp_path / name, text), SCHEMA).where("dateTime IS NOT NULL")
        assert out.count() == n, name


def tree(root, rows, person="p1"):
    folder = root / person / "watch"
    folder.mkdir(parents=True)
    (folder / "heart_rate.json").write_text(json.dumps(rows))
    (folder / "steps.json").write_text(json.dumps([{"dateTime": r["dateTime"], "value": r["value"]["bpm"]} for r in rows]))


def test_window_is_applied_before_parsing(spark, tmp_path, split):
    rows = records(300)
    for i, r in enumerate(rows):
        if i % 7 == 0:  # day first, month names, zones and nested namesakes
            r["dateTime"] = ["03/02/20 08:00:00", "2020:02:04 08:00:00", "Feb 3 2020", "2020-02-03T08:00:00Z", "", "31/31/2020"][i % 6]
        if i % 50 == 0:
            r["value"]["dateTime"] = "2020-02-09"
    tree(tmp_path, rows)
    bounds = D.window_bounds("2020-02-03", "2020-02-04 08:30:00")
    split(5000)
    whole = R.read_minute(spark, str(tmp_path), "steps")
    inside = R.read_minute(spark, str(tmp_path), "steps", bounds)
    assert sorted(map(str, inside.collect())) == sorted(map(str, whole.where(D.in_window("ts", bounds)).collect()))
    beats = R.read_hr(spark, str(tmp_path), bounds)
    assert beats.count() == R.read_hr(spark, str(tmp_path)).where(D.in_window("ts", bounds)).count() > 10
    plan = inside._sc._jvm.PythonSQLUtils.explainString(inside._jdf.queryExecution(), "formatted")
    assert "records_with_dateTime_from_2020_02_03_to_2020_02_04" in plan
    passed = J.read_array(spark, f"{tmp_path}/*/*/steps.json", SCHEMA, "dateTime", bounds).count()
    assert inside.count() <= passed < 0.5 * len(rows)


def test_records_keep_their_order(spark, tmp_path, split):
    rows = [{"dateTime": "2020-02-03 08:00:00", "value": {"bpm": str(i), "confidence": "1"}} for i in range(500)]
    tree(tmp_path, rows)
    tree(tmp_path, [{"dateTime": "2020-02-03 08:00:00", "value": {"bpm": "9"}}], "p2")
    split(900)
    assert {(r["participant_id"], r["bpm"]) for r in R.read_hr(spark, str(tmp_path)).collect()} == {("p1", 499.0), ("p2", 9.0)}
    steps = R.read_minute(spark, str(tmp_path), "steps").where("participant_id = 'p1'").orderBy("seq")
    assert [r["value"] for r in steps.collect()] == [float(i) for i in range(500)]


def test_tasks_follow_the_size_of_a_file(spark, tmp_path, split):
    tree(tmp_path, [{"dateTime": f"2020-02-03 08:{i % 60:02d}:00", "value": {"bpm": str(i), "note": "x" * 50}} for i in range(20_000)])
    split("256k")
    out = J.read_array(spark, f"{tmp_path}/*/*/heart_rate.json", SCHEMA)
    size = (tmp_path / "p1" / "watch" / "heart_rate.json").stat().st_size
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.count() == 20_000 and len([r for r in per_task if r["count"] > 1000]) >= size // (256 << 10)
