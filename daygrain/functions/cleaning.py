"""Sentinel, range and unit cleaning as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Scales, physiological bounds and artefact limits.
LIKERT_COLUMNS = ("fatigue", "mood", "sleep_quality", "soreness", "stress")
LIKERT_RANGE = (1, 5)
READINESS_RANGE = (1, 10)
HR_RANGE = (30, 220)
RESTLESSNESS_RANGE = (0.03, 0.20)
MIN_STRIDE_CM = 20.0
MIN_BOUT_MINUTES = 0.03
LATE_SUBMISSION_HOUR = 12
MACRO_KEYS = ("calories", "protein", "carbohydrates", "fats")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c: Column | str, default: float | None = None) -> Column:
    """Double, or ``default`` for text that is no number and for NaN."""
    value = _col(c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def keep_between(c: Column | str, lo: float, hi: float) -> Column:
    """The value when inside ``[lo, hi]``, else NULL."""
    value = _col(c)
    return F.when(value.between(lo, hi), value)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bound a value to ``[lo, hi]``; NULL stays NULL (``least`` skips NULLs)."""
    value = _col(c)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(hi)), F.lit(lo)))


def clean_likert(df: DataFrame, cols=LIKERT_COLUMNS, lo: int = LIKERT_RANGE[0],
                 hi: int = LIKERT_RANGE[1]) -> DataFrame:
    """Null out answers outside the scale in the columns that are present."""
    return df.withColumns({c: keep_between(safe_double(c), lo, hi)
                           for c in cols if c in df.columns})


def clean_readiness(df: DataFrame, col: str = "readiness") -> DataFrame:
    """Add ``readiness_clean``: NULL outside the scale or without the column."""
    value = (keep_between(safe_double(col), *READINESS_RANGE) if col in df.columns
             else F.lit(None).cast("double"))
    return df.withColumn("readiness_clean", value)


def clean_sleep_hours(df: DataFrame, col: str = "sleep_duration_h") -> DataFrame:
    """Null out non-positive self-reported sleep."""
    if col not in df.columns:
        return df
    value = safe_double(col)
    return df.withColumn(col, F.when(value > 0, value))


def clean_wellness(df: DataFrame) -> DataFrame:
    """All wellness sentinels at once."""
    return clean_sleep_hours(clean_readiness(clean_likert(df)))


def clean_rhr(value: Column | str, date: Column | str) -> Column:
    """Resting heart rate; a blank date or a value <= 0 means no measurement."""
    v = safe_double(value)
    return F.when((F.trim(_col(date).cast("string")) != "") & (v > 0), v)


def trusted_sample(confidence: Column | str) -> Column:
    """Keep every sample but those of confidence 0; unknown confidence is kept."""
    return ~_col(confidence).eqNullSafe(F.lit(0))


def out_of_hr_range(bpm: Column | str, lo: int = HR_RANGE[0], hi: int = HR_RANGE[1]) -> Column:
    """True where clipping changes the sample."""
    bpm = _col(bpm)
    return F.coalesce((bpm < lo) | (bpm > hi), F.lit(False))


def clean_stride(c: Column | str, min_cm: float = MIN_STRIDE_CM) -> Column:
    """Stride length, NULL when implausibly short."""
    v = safe_double(c)
    return F.when(v >= min_cm, v)


def bout_ms(active_ms: Column | str, duration_ms: Column | str) -> Column:
    """Milliseconds of an exercise bout: active time, else total time, else 0."""
    return F.coalesce(_col(active_ms), _col(duration_ms), F.lit(0).cast("long"))


def bout_minutes(active_ms: Column | str, duration_ms: Column | str) -> Column:
    """Minutes of an exercise bout."""
    return ms_to_min(bout_ms(active_ms, duration_ms))


def total_minutes(active_ms: Column | str, duration_ms: Column | str) -> Column:
    """Minutes of all bouts of a group; whole milliseconds are summed, so the
    total does not depend on the order of the rows."""
    return ms_to_min(F.sum(bout_ms(active_ms, duration_ms)))


def real_bout(minutes: Column | str, min_minutes: float = MIN_BOUT_MINUTES) -> Column:
    """False for artefact bouts."""
    return _col(minutes) > min_minutes


def cm_to_m(c: Column | str) -> Column:
    """Metres, two decimals."""
    return F.round(_col(c) / 100, 2)


def ms_to_min(c: Column | str) -> Column:
    """Minutes."""
    return _col(c) / F.lit(60000.0)


def min_to_h(c: Column | str) -> Column:
    """Hours, two decimals."""
    return F.round(_col(c) / F.lit(60.0), 2)


def clean_static_text(c: Column | str, upper: bool = False) -> Column:
    """Trim (also non-breaking spaces) and fold case; blank gives NULL."""
    text = F.trim(F.translate(_col(c), "\u00a0", " "))
    text = F.upper(text) if upper else F.lower(text)
    return F.nullif(text, F.lit(""))


def valid_macros(payload: Column | str, keys=MACRO_KEYS) -> Column:
    """A struct of the four macro values, NULL unless all are numbers >= 0."""
    payload = _col(payload)
    fields = {k: safe_double(payload.getField(k)) for k in keys}
    usable = F.lit(True)
    for value in fields.values():
        usable = usable & F.coalesce(value >= 0, F.lit(False))
    return F.when(usable, F.struct(*[v.alias(k) for k, v in fields.items()]))


def suspicious_name(file: Column | str) -> Column:
    """File names that look like identifiers or screenshots."""
    name = _col(file)
    return name.rlike(r"^[0-9a-f-]{30,}") | F.lower(name).endswith(".png")
