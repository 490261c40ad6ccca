"""Unions, ordering, top-k and distinct text over tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.functions.encoding import onehot_name

# The leading column order of the feature table.
COLUMN_ORDER = """
participant_id date dow weekend_bin readiness_next_day label_available readiness_same_day
age height_cm gender chronotype max_hr stride_walk_cm stride_run_cm
total_steps peak_1min_steps steps_cov_min n_deduped_min total_distance_cm total_distance_m total_kcal
exercise_min n_exercise_sessions
act_individual act_running act_endurance act_strength act_team act_soccer act_walk act_bike
srpe_n_sessions srpe_load mean_rpe load_7d_sum load_7d_mean monotony_7d strain_7d acwr_7_28 trimp_edwards
hr_mean hr_sd hr_peak hr_n_samples mean_conf hr_cov_min n_clipped_hr
nonwear_min nonwear_hours has_nonwear nonwear_is_upper_bound
rhr_raw rhr_7d_median rhr_residual was_imputed_rhr_7d_median
zone_min_BELOW_DEFAULT_ZONE_1 zone_min_IN_DEFAULT_ZONE_1 zone_min_IN_DEFAULT_ZONE_2 zone_min_IN_DEFAULT_ZONE_3
zones_available time_ge85_min
n_nights n_naps has_sleep_record is_classic asleep_min time_in_bed_min efficiency_pct
deep_min light_min rem_min wake_min deep_pct light_pct rem_pct wake_pct onset_hour offset_hour midsleep_hour
mean_overall_score mean_composition_score mean_revitalization_score mean_duration_score
mean_deep_sleep_in_minutes mean_restlessness
n_wellness_rows has_wellness submission_hour delayed_flag_ge12
n_reporting_rows weight_raw weight_7d_median weight_residual was_imputed_weight_7d_median
fluids_glasses alcohol_bin lag_days n_meals_logged
n_photos n_food_photos n_photo_meals has_nutrition estimated_kcal protein_g carbs_g fat_g nutrition_kcal_available
is_injured_day n_injury_reports injured_last_7d
missing_ratio_wellness_7d missing_ratio_weight_7d missing_ratio_zones_7d missing_ratio_sleep_7d missing_ratio_srpe_7d
has_steps has_hr has_zones has_sleep
total_steps_mean_7d total_steps_median_7d total_steps_std_7d
exercise_min_mean_7d exercise_min_median_7d exercise_min_std_7d
""".split()


def ordered_columns(df: DataFrame, preferred: Sequence[str] = COLUMN_ORDER) -> list[str]:
    """Known columns in their fixed order, then sorted ``inj_*``, then the rest."""
    present = set(df.columns)
    head = [c for c in preferred if c in present]
    flags = sorted(c for c in df.columns if c.startswith("inj_") and c not in head)
    return head + flags + [c for c in df.columns if c not in set(head) | set(flags)]


def union_aligned(frames: Sequence[DataFrame], zero_prefix: str = "inj_") -> DataFrame:
    """Union by name; one-hot columns a frame lacks are 0, other ones NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    flags = [c for c in out.columns if c.startswith(zero_prefix)]
    return out.fillna(0, subset=flags) if flags else out


def pool(frames: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Union of frames for pooled statistics, tagged with where a row came from."""
    tagged = [df.withColumn(name, F.lit(tag)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def top_k(df: DataFrame, value: Sequence[str], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k most frequent values, overall or per group; ties by value."""
    counts = df.groupBy(*keys, *value).agg(F.count("*").alias("n"))
    order = [F.desc("n"), *[F.asc(v) for v in value]]
    if not keys:
        return counts.orderBy(*order).limit(k)
    # Spark keeps only k rows per group and task before this shuffles.
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def sort_abs(df: DataFrame, col: str) -> DataFrame:
    """Largest magnitude first, NULLs last."""
    return df.orderBy(F.abs(col).desc_nulls_last())


def sorted_list(rows: DataFrame, keys: Sequence[str], item: Column, order: Sequence[str], out: str) -> DataFrame:
    """Sorted list of all rows of a group.

    The list is one cell of the result, so it is built in one row whatever its
    length; callers fold repeats first where they can.  Work on the rows
    themselves belongs before this step.
    """
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], item.alias("item"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    return listed.select(*keys, F.transform("_all", lambda e: e["item"]).alias(out))


def distinct_text(df: DataFrame, keys: Sequence[str], col: str, sep: str = "; ",
                  out: str | None = None) -> DataFrame:
    """Sorted distinct names of a group as one text (see ``sorted_list``)."""
    names = df.select(*keys, col).where(F.col(col).isNotNull()).distinct()
    listed = sorted_list(names, keys, F.col(col), [col], "_names")
    return listed.select(*keys, F.array_join("_names", sep).alias(out or f"{col}_names"))


def onehot_values(state: DataFrame) -> list[str]:
    """Sorted one-hot names present in ``daily.injury_state``: the pivot list.

    A pivot needs its columns by name before it runs, so the names are the one
    thing that comes to the driver; ``daily.injury_state`` is the same table in
    long form, without a column per name.
    """
    names = state.select(onehot_name("loc", "sev").alias("name")).distinct().collect()
    return sorted(r["name"] for r in names)
