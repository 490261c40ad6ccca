"""Data dictionaries: one row per column of a dataset."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

KEY_COLUMNS = ("participant_id", "date")
LABEL_COLUMNS = ("readiness_next_day", "label_available")
EXCLUDED = (*KEY_COLUMNS, *LABEL_COLUMNS, "total_distance_m")

# (pattern, source, what it is, how it is cleaned); the first match documents a column.
RULES = (
    (r"participant_id|date", "key", "row key", "as is"),
    (r"readiness_next_day", "label", "cleaned readiness of the following day", "sentinel removed, led one day"),
    (r"label_available", "audit", "whether the label is known", "label is not null"),
    (r"readiness_same_day", "wellness", "cleaned readiness of the day", "sentinel removed"),
    (r"dow|weekend_bin", "temporal", "calendar position", "derived from the date"),
    (r"act_.*", "activity", "activity of bouts or sessions", "substring match"),
    (r"inj_.*", "injury", "location and severity flag", "parsed literal"),
    (r"zone_min_.*|time_ge85_min", "cardiac", "minutes in a heart-rate zone", "unknown days stay null"),
    (r"missing_ratio_.*", "missingness", "share of missing days, trailing week", "causal window"),
    (r"was_imputed_.*", "missingness", "value was carried forward", "at most two days"),
    (r"injured_last_7d|is_injured_day|n_injury_reports", "injury", "reported injuries", "parsed literal"),
    (r"(rhr|weight)_(7d_median|residual)", "slow signal", "trailing median and distance from it", "causal window"),
    (r".*_(mean|median|std)_7d", "window", "trailing week statistic", "causal window"),
    (r"load_7d_.*|monotony_7d|strain_7d|acwr_7_28", "load", "trailing training load", "causal window"),
    (r"srpe_.*|mean_rpe|trimp_edwards", "load", "training load of the day", "invalid sessions stay null"),
    (r"age|height_cm|gender|chronotype|max_hr|stride_.*", "static", "participant covariate",
     "trimmed, implausible strides removed"),
    (r"total_.*|peak_1min_steps|exercise_min|n_exercise_sessions", "activity", "activity of the day",
     "duplicate minutes and artefact bouts removed"),
    (r"n_deduped_min|n_clipped_hr", "quality", "rows changed by cleaning", "counted"),
    (r"hr_(mean|sd|peak)", "cardiac", "heart rate of the day", "untrusted samples removed, clipped"),
    (r"rhr_raw", "cardiac", "resting heart rate of the day", "undated and non-positive values removed"),
    (r"submission_hour|delayed_flag_ge12|lag_days", "process", "when the log was submitted", "derived"),
    (r"steps_cov_min|hr_cov_min|hr_n_samples|mean_conf|zones_available|has_.*|nutrition_kcal_available|"
     r"n_wellness_rows|n_reporting_rows", "coverage", "how much of the day is known", "counted"),
    (r"nonwear_.*", "wear", "minutes without movement or live heart rate", "runs of an hour or more"),
    (r"n_nights|n_naps|is_classic|.*_min|.*_pct|.*_hour|mean_.*", "sleep", "main night ending that day",
     "naps apart, stages only where recorded"),
    (r"weight_raw|fluids_glasses|alcohol_bin", "reporting", "self report of the day", "as is"),
    (r"n_meals_logged|n_.*photo.*|estimated_kcal|protein_g|carbs_g|fat_g", "nutrition",
     "meals and their estimates", "bursts folded, invalid estimates removed"),
)


def feature_columns(df: DataFrame, excluded: Sequence[str] = EXCLUDED) -> list[str]:
    """Modelling columns: all but keys, label helpers and exact duplicates."""
    return [c for c in df.columns if c not in set(excluded)]


def _describe(column: str) -> tuple[str, str, str]:
    """Source, description and rule of the first pattern that names the column."""
    for pattern, source, text, rule in RULES:
        if re.fullmatch(pattern, column):
            return source, text, rule
    return "derived", "", ""


def data_dictionary(df: DataFrame, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """column, dtype, source, description, cleaning_rule, used_in_x."""
    used = set(feature_columns(df, excluded))
    rows = [(i, name, dtype, *_describe(name), int(name in used))
            for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, source string, description string, "
              "cleaning_rule string, used_in_x int")


def final_dictionary(df: DataFrame) -> DataFrame:
    """The dictionary with role and non-missing rows, counted in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot(
        [], list(df.columns), "column", "non_missing_rows")
    role = (F.when(F.col("column").isin(*KEY_COLUMNS), "key")
            .when(F.col("column").isin(*LABEL_COLUMNS), "label").otherwise("feature"))
    return (data_dictionary(df).join(counts, "column")
            .select("position", "column", "dtype", "source", "description",
                    F.col("cleaning_rule").alias("preprocessing"), "non_missing_rows", role.alias("role")))
