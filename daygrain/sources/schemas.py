"""Raw schemas: text first, so that malformed values never fail a scan."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _json(*fields: tuple[str, T.DataType]) -> T.StructType:
    """JSON records may name their participant; else it comes from the path."""
    return T.StructType([T.StructField("participant_id", T.StringType())]
                        + [T.StructField(n, t) for n, t in fields])


_STRING, _DOUBLE, _LONG = T.StringType(), T.DoubleType(), T.LongType()

MINUTE = _json(("dateTime", _STRING), ("value", _STRING))
HEART_RATE = _json(("dateTime", _STRING),
                   ("value", _text("bpm", "confidence")))
RESTING_HR = _json(("dateTime", _STRING), ("value", _text("date", "value", "error")))
ZONES = _json(("dateTime", _STRING), ("value", T.StructType([
    T.StructField("valuesInZones", T.MapType(_STRING, _DOUBLE))])))
STAGE = T.StructType([T.StructField("minutes", _DOUBLE)])
SLEEP = _json(
    ("logId", _LONG), ("dateOfSleep", _STRING), ("startTime", _STRING), ("endTime", _STRING),
    ("minutesAsleep", _DOUBLE), ("minutesAwake", _DOUBLE), ("timeInBed", _DOUBLE),
    ("efficiency", _DOUBLE), ("type", _STRING), ("mainSleep", T.BooleanType()),
    ("levels", T.StructType([
        T.StructField("summary", T.MapType(_STRING, STAGE)),
        T.StructField("data", T.ArrayType(_text("dateTime", "level", "seconds")))])))
EXERCISE = _json(("logId", _LONG), ("activityName", _STRING), ("startTime", _STRING),
                 ("activeDuration", _LONG), ("duration", _LONG))

SLEEP_SCORE_VALUES = ("overall_score", "composition_score", "revitalization_score",
                      "duration_score", "deep_sleep_in_minutes", "resting_heart_rate",
                      "restlessness")
WELLNESS_VALUES = ("fatigue", "mood", "readiness", "sleep_duration_h", "sleep_quality",
                   "soreness", "stress")
SLEEP_SCORE = ("timestamp", "sleep_log_entry_id", *SLEEP_SCORE_VALUES)
WELLNESS = ("effective_time_frame", *WELLNESS_VALUES, "soreness_area")
SRPE = ("end_date_time", "activity_names", "perceived_exertion", "duration_min")
INJURY = ("effective_time_frame", "injuries")
REPORTING = ("date", "timestamp", "meals", "weight", "glasses_of_fluid", "alcohol_consumed")
PHOTOS = ("file", "datetime", "is_food")
PARTICIPANTS = ("participant_id", "age", "height", "gender", "a_or_b_person", "max_heart_rate",
                "stride_walk", "stride_run")
STATIC_COLUMNS = ("age", "height_cm", "gender", "chronotype", "max_hr", "stride_walk_cm",
                  "stride_run_cm")
