"""Typed scans of the raw exports.

Two layouts are understood under ``root``:

* a tree ``<participant>/<folder>/<file>`` as exported per person, where a
  JSON file is one array, cut into records by ``json_arrays``, and
* one data set ``<file>`` for all participants, with a ``participant_id``
  field in every record (JSON lines, CSV): the splittable form for volume.

An absent source gives an empty table of the right type.  Every reader takes
an optional ``Bounds`` window and adds ``seq``, the order of the records, which
the first-wins and last-wins rules need: files in path order, the combined
layout before the tree, and records as they stand in their file, however Spark
cuts and packs the files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from daygrain.functions.cleaning import clean_static_text, clean_stride, safe_double
from daygrain.functions.dates import Bounds, in_window, std_ts
from daygrain.functions.encoding import parse_list, parse_map
from daygrain.sources import schemas as S
from daygrain.sources.json_arrays import read_array

SEQ = "decimal(38,0)"
#: The two ways to ask for a path spell the scheme with one or three slashes.
SLASHES = (r"^(\w+):/+", r"\1:/")
Window = tuple[str, Bounds] | None
SPARK_LAYOUTS = (("{root}/{file}", False), ("{root}/*/*/{file}", True))


def _participant(file: str, path: str = "_metadata.file_path") -> Column:
    """The participant named in the record, else the folder two levels up."""
    folder = F.regexp_extract(F.col(path), rf"([^/]+)/[^/]+/{file.replace('.', '[.]')}", 1)
    return F.coalesce(F.col("participant_id"), F.nullif(folder, F.lit("")))


def _numbered(raw: DataFrame, layout: int) -> DataFrame:
    """``raw`` with ``seq`` = file (10 digits), start of the block in the file (16), record in the block (11).

    Blocks of one file follow each other by their start, and a record's running
    number grows inside its block; so the order needs no pass over the data.
    """
    record = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = raw.withColumn("_record", record).join(
        _ranks(raw, layout), F.regexp_replace("_metadata.file_path", SLASHES[0], "$1:/") == F.col("_file"), "left")
    return placed.withColumn("seq", _seq("_rank", "_metadata.file_block_start", "_record")).drop("_file", "_rank", "_record")


def _ranks(raw: DataFrame, layout: int) -> DataFrame:
    """(_file, _rank): the files of a scan in path order, behind those of an earlier layout."""
    paths = sorted(re.sub(*SLASHES, path) for path in raw.inputFiles())
    return raw.sparkSession.createDataFrame([(path, layout * 10 ** 9 + i) for i, path in enumerate(paths)], "_file string, _rank long")


def _seq(rank: str, block: str, record: str) -> Column:
    parts = [F.col(c).cast(SEQ) * F.lit(str(10 ** n)).cast(SEQ) for c, n in ((rank, 27), (block, 11), (record, 0))]
    return reduce(Column.__add__, parts).cast(SEQ)


def _arrays(spark: SparkSession, path: str, file: str, schema: T.StructType, layout: int, window: Window) -> DataFrame:
    """The records of JSON arrays, numbered like those of other files: the block is the one that a record ends in."""
    ranks = _ranks(spark.read.text(path), layout)
    records = read_array(spark, path, schema, *(window or ()))
    placed = records.join(ranks, F.col("file") == F.xxhash64("_file"), "left")
    return (placed.withColumn("participant_id", _participant(file, "_file"))
            .select(*schema.names, _seq("_rank", "block", "at").alias("seq")))


def _scan(spark: SparkSession, root: str, file: str, schema: T.StructType, window: Window = None) -> DataFrame:
    """Both layouts of one source, or the empty table when neither exists.

    ``window`` names the field that is in time order with its bounds; arrays
    leave out records of other days before they are parsed.
    """
    found = []
    for layout, (pattern, is_tree) in enumerate(SPARK_LAYOUTS):
        reader = spark.read.schema(schema)
        path = pattern.format(root=root.rstrip("/"), file=file)
        try:
            if file.endswith(".json") and is_tree:
                found.append(_arrays(spark, path, file, schema, layout, window))
                continue
            if file.endswith(".json"):
                raw = reader.json(path)
            else:
                raw = _read_csv(spark, path, schema, is_tree)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(_numbered(raw.withColumn("participant_id", _participant(file)).select(
            *schema.names, "_metadata"), layout).drop("_metadata"))
    if not found:
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(None).cast(SEQ))
    return reduce(DataFrame.unionByName, found)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, is_tree: bool) -> DataFrame:
    """CSV columns matched by header name; a column the files lack is NULL.

    Only small per-person files may break lines inside quotes; the combined
    layout stays splittable.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("escape", '"').option("multiLine", is_tree).csv(path))
    columns = [F.col(f"`{f.name}`") if f.name in raw.columns
               else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return raw.select(*columns, "_metadata")


def _csv_schema(names: Sequence[str]) -> T.StructType:
    unique = dict.fromkeys(["participant_id", *names])
    return T.StructType([T.StructField(n, T.StringType()) for n in unique])


def _window(field: str, bounds: Bounds | None) -> Window:
    return None if bounds is None else (field, bounds)


def _in(df: DataFrame, ts: str, bounds: Bounds | None) -> DataFrame:
    """Rows with a readable time inside the window."""
    df = df.where(F.col(ts).isNotNull())
    return df if bounds is None else df.where(in_window(ts, bounds))


def last_write(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the content of its last record at the place of its first.

    Column by column, so that numeric sources stay in a hash aggregate.
    """
    values = [c for c in df.columns if c not in keys and c != "seq"]
    folded = df.groupBy(*keys).agg(*[F.max_by(c, "seq").alias(c) for c in values],
                                   F.min("seq").alias("_first"))
    return folded.withColumnRenamed("_first", "seq")


def read_minute(spark: SparkSession, root: str, metric: str,
                bounds: Bounds | None = None) -> DataFrame:
    """Minute values of ``steps``, ``distance`` or ``calories``.

    Records without a number are dropped.
    """
    raw = _scan(spark, root, f"{metric}.json", S.MINUTE, _window("dateTime", bounds))
    out = raw.select("participant_id", std_ts("dateTime").alias("ts"), F.lit(metric).alias("metric"),
                     safe_double("value").alias("value"), "seq")
    return _in(out, "ts", bounds).where(F.col("value").isNotNull())


def read_hr(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Heart-rate samples; the last record of a time stamp wins."""
    raw = _scan(spark, root, "heart_rate.json", S.HEART_RATE, _window("dateTime", bounds))
    out = raw.select("participant_id", std_ts("dateTime").alias("ts"),
                     safe_double("value.bpm").alias("bpm"),
                     safe_double("value.confidence").cast("int").alias("confidence"), "seq")
    return last_write(_in(out, "ts", bounds), ["participant_id", "ts"])


def read_rhr(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Daily resting heart rate as exported, sentinels included."""
    raw = _scan(spark, root, "resting_heart_rate.json", S.RESTING_HR, _window("dateTime", bounds))
    out = raw.select("participant_id", std_ts("dateTime").alias("ts"),
                     F.col("value.date").alias("rhr_date"), safe_double("value.value").alias("value"),
                     safe_double("value.error").alias("error"), "seq")
    return last_write(_in(out, "ts", bounds), ["participant_id", "ts"])


def read_zones(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Daily minutes per heart-rate zone as a map."""
    raw = _scan(spark, root, "time_in_heart_rate_zones.json", S.ZONES, _window("dateTime", bounds))
    zones = F.coalesce("value.valuesInZones", F.from_json(F.lit("{}"), "map<string,double>"))
    out = raw.select("participant_id", std_ts("dateTime").alias("ts"), zones.alias("zones"), "seq")
    return last_write(_in(out, "ts", bounds), ["participant_id", "ts"])


def read_sleep(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Sleep logs, flattened; filtered on the start time, last record of a log wins."""
    raw = _scan(spark, root, "sleep.json", S.SLEEP, _window("startTime", bounds))

    def stage(name: str) -> Column:
        return F.try_element_at("levels.summary", F.lit(name)).getField("minutes").alias(f"{name}_min")

    out = raw.select(
        "participant_id", F.col("logId").alias("log_id"), F.col("dateOfSleep").alias("date_of_sleep"),
        std_ts("startTime").alias("start_ts"), std_ts("endTime").alias("end_ts"),
        F.col("minutesAsleep").alias("asleep_min"), F.col("minutesAwake").alias("awake_total_min"),
        F.col("timeInBed").alias("time_in_bed_min"), F.col("efficiency").alias("efficiency_pct"),
        F.col("type").alias("sleep_type"), F.coalesce("mainSleep", F.lit(True)).alias("main_sleep"),
        *[stage(s) for s in ("deep", "light", "rem", "wake", "restless", "awake")],
        (F.coalesce(F.size("levels.data"), F.lit(0)) > 0).alias("has_level_data"), "seq")
    return last_write(_in(out, "start_ts", bounds), ["participant_id", "log_id"])


def read_exercise(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Exercise bouts; filtered on the start time, last record of a log wins."""
    raw = _scan(spark, root, "exercise.json", S.EXERCISE, _window("startTime", bounds))
    out = raw.select("participant_id", F.col("logId").alias("log_id"),
                     F.col("activityName").alias("activity_name"), std_ts("startTime").alias("start_ts"),
                     F.col("activeDuration").alias("active_ms"), F.col("duration").alias("duration_ms"), "seq")
    return last_write(_in(out, "start_ts", bounds), ["participant_id", "log_id"])


def read_sleep_score(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Sleep-score rows by their time stamp."""
    raw = _scan(spark, root, "sleep_score.csv", _csv_schema(S.SLEEP_SCORE))
    out = raw.select("participant_id", std_ts("timestamp").alias("ts"), "sleep_log_entry_id",
                     *[safe_double(c).alias(c) for c in S.SLEEP_SCORE_VALUES], "seq")
    return _in(out, "ts", bounds)


def read_wellness(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Questionnaire rows as answered, sentinels included."""
    raw = _scan(spark, root, "wellness.csv", _csv_schema(S.WELLNESS))
    out = raw.select("participant_id", std_ts("effective_time_frame").alias("ts"),
                     *[safe_double(c).alias(c) for c in S.WELLNESS_VALUES], "soreness_area", "seq")
    return _in(out, "ts", bounds)


def read_srpe(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Training sessions, attributed to their end."""
    raw = _scan(spark, root, "srpe.csv", _csv_schema(S.SRPE))
    out = raw.select("participant_id", std_ts("end_date_time").alias("ts"),
                     parse_list("activity_names").alias("activity_names"),
                     safe_double("perceived_exertion").alias("rpe"),
                     safe_double("duration_min").alias("duration_min"), "seq")
    return _in(out, "ts", bounds)


def read_injury(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Injury reports as maps of location to severity; last record of a stamp wins."""
    raw = _scan(spark, root, "injury.csv", _csv_schema(S.INJURY))
    out = raw.select("participant_id", std_ts("effective_time_frame").alias("ts"),
                     F.coalesce("injuries", F.lit("{}")).alias("_raw"), "seq")
    newest = last_write(_in(out, "ts", bounds), ["participant_id", "ts"])
    return newest.withColumn("injuries", parse_map("_raw")).drop("_raw")


def read_reporting(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Self-report log by its day-first date."""
    raw = _scan(spark, root, "reporting.csv", _csv_schema(S.REPORTING))
    out = raw.select("participant_id", std_ts("date").alias("ts"),
                     std_ts("timestamp").alias("submitted_ts"), "meals",
                     safe_double("weight").alias("weight"),
                     safe_double("glasses_of_fluid").alias("glasses_of_fluid"), "alcohol_consumed", "seq")
    return _in(out, "ts", bounds)


def read_photos(spark: SparkSession, root: str, bounds: Bounds | None = None) -> DataFrame:
    """Audited photo events; rows without a readable time are dropped."""
    raw = _scan(spark, root, "photos.csv", _csv_schema(S.PHOTOS))
    out = raw.select("participant_id", "file", std_ts("datetime").alias("ts"),
                     F.upper("is_food").alias("is_food"), "seq")
    return _in(out, "ts", bounds)


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    """Static covariates from a CSV table; header names are normalised."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*["_".join(c.strip().lower().split()) for c in raw.columns])
    for c in S.PARTICIPANTS:
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    return clean_participants(named)


def clean_participants(named: DataFrame) -> DataFrame:
    """Types, trimmed text and implausible strides of the covariates."""
    return named.select(
        F.trim("participant_id").alias("participant_id"), safe_double("age").alias("age"),
        safe_double("height").alias("height_cm"), clean_static_text("gender").alias("gender"),
        clean_static_text("a_or_b_person", upper=True).alias("chronotype"),
        safe_double("max_heart_rate").alias("max_hr"), safe_double("stride_walk").alias("stride_walk_cm"),
        clean_stride("stride_run").alias("stride_run_cm"))


def read_landed(spark: SparkSession, path: str, bounds: Bounds | None = None, ts: str = "ts") -> DataFrame:
    """A landed table (see ``sinks.land``), pruned to the window.

    The day range prunes partitions and the time range is pushed to the
    row groups.
    """
    df = spark.read.parquet(path)
    if bounds is None:
        return df
    days = F.col("date").between(F.lit(bounds.lower.date()), F.lit(bounds.upper.date()))
    return df.where(days).where(in_window(ts, bounds))
