"""Aggregates per participant and report window.

Windows come as a table (participant_id, window_id, lower, upper, inclusive),
so any number of participants and windows is reported in one job; rows meet
them through the blocks of ``timetree``, which callers of several functions build once.  This path
reports what was logged: no deduplication, no artefact or sentinel cleaning
other than the resting heart rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.functions import cleaning as C, dates as D, encoding as E
from daygrain.functions.text import format_distance
from daygrain.operators.daily import SCORE_COLUMNS
from daygrain.operators import timetree as T
from daygrain.operators.joins import last_known, nights_ending_in
from daygrain.operators.tables import sorted_list
from daygrain.operators.timetree import WINDOW, WindowTree
from daygrain.session import stored

Windows = DataFrame | WindowTree
WELLNESS_FIELDS = ("fatigue", "mood", "readiness", "sleep_duration_h", "sleep_quality", "soreness",
                   "soreness_area", "stress")
NIGHT_FIELDS = ("date_of_sleep", "asleep_min", "time_in_bed_min", "efficiency_pct", "deep_min",
                "light_min", "rem_min", "wake_min")


def make_windows(asked: DataFrame) -> DataFrame:
    """Resolve participant_id, window_id, start, end (text, end may be NULL)."""
    return asked.select(*WINDOW, *D.bound_columns("start", "end"),
                        F.to_date(D.std_ts("start")).alias("start_date"),
                        F.coalesce(F.to_date(D.std_ts("end")), F.to_date(D.std_ts("start"))).alias("end_date"))


def activity_window(minute: DataFrame, windows: Windows) -> DataFrame:
    """Totals and peak of the minute metrics as logged; 0 without data."""
    tree = WindowTree.of(windows)
    value, metric = F.col("value"), F.col("metric")
    totals = tree.fold(minute, "ts", {
        "total_steps": T.total(F.when(metric == "steps", value), "total_steps"),
        "peak_1min_steps": T.largest(F.when(metric == "steps", value), "peak_1min_steps"),
        "total_distance": T.total(F.when(metric == "distance", value), "total_distance"),
        "total_calories_burned": T.total(F.when(metric == "calories", value), "total_calories_burned")})
    out = tree.windows.select(*WINDOW).join(totals, WINDOW, "left").fillna(0.0)
    return out.withColumn("total_distance_display", format_distance("total_distance"))


def exercise_window(bouts: DataFrame, windows: Windows) -> DataFrame:
    """All bouts: count, minutes and distinct activity names."""
    tree = WindowTree.of(windows)
    by_name = tree.fold(bouts, "start_ts", {"n": T.count("n"), "ms": T.total(C.bout_ms("active_ms", "duration_ms"), "ms")}, ["activity_name"])
    totals = by_name.groupBy(*WINDOW).agg(
        F.sum("n").alias("n_exercise_sessions"), F.round(C.ms_to_min(F.sum("ms")), 1).alias("exercise_minutes"))
    listed = sorted_list(by_name.where(F.col("activity_name") != ""), WINDOW, F.col("activity_name"), ["activity_name"], "activities")
    return tree.windows.select(*WINDOW).join(totals, WINDOW, "left").join(listed, WINDOW, "left").withColumns({
        "n_exercise_sessions": F.coalesce("n_exercise_sessions", F.lit(0).cast("long")),
        "exercise_minutes": F.coalesce("exercise_minutes", F.lit(0.0)),
        "activities": F.coalesce("activities", F.array().cast("array<string>"))})


def _means(cols: dict[str, Column | str]) -> dict[str, tuple[Column, Column]]:
    """The sums and counts that means need, as ``s_<name>`` and ``n_<name>``."""
    return {f"{k}_{name}": (T.total if k == "s" else T.known)(c, f"{k}_{name}") for name, c in cols.items() for k in "sn"}


def _mean(name: str) -> Column:
    return F.col(f"s_{name}") / F.nullif(F.col(f"n_{name}"), F.lit(0))


def mean_rhr(rhr: DataFrame, windows: Windows) -> DataFrame:
    """Mean of the positive resting heart rates; NULL when there is none."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    sums = WindowTree.of(windows).fold(rhr, "ts", _means({"rhr": positive}))
    return sums.select(*WINDOW, F.round(_mean("rhr"), 2).alias("resting_hr_bpm"))


def zones_window(zones: DataFrame, windows: Windows) -> DataFrame:
    """Zone minutes added up over the window, as a map in fixed zone order."""
    long = zones.select("participant_id", "ts", F.explode("zones").alias("zone", "_minutes"))
    sums = WindowTree.of(windows).fold(long, "ts", {"v": T.total(F.coalesce("_minutes", F.lit(0.0)), "v")}, ["zone"])
    rank = F.coalesce(F.array_position(F.array(*[F.lit(z) for z in E.ZONE_KEYS]), F.col("zone")), F.lit(0))
    # One row per zone name of the window: the vocabulary bounds the list.
    entry = F.struct(F.when(rank == 0, 99).otherwise(rank).alias("o"), "zone", "v")
    return sums.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(entry)).alias("_z")).select(
        *WINDOW, F.map_from_entries(F.transform("_z", lambda e: F.struct(e["zone"], e["v"])))
        .alias("hr_zones_min"))


def window_nights(sleep: DataFrame, windows: Windows) -> DataFrame:
    """Long form: every night that ends in a window."""
    return nights_ending_in(sleep, windows).select(*WINDOW, "seq", "end_ts", *NIGHT_FIELDS)


def nights_array(sleep: DataFrame, windows: Windows) -> DataFrame:
    """Nights of a window as a list in file order, and their number."""
    rows = window_nights(sleep, windows)
    listed = sorted_list(rows, WINDOW, F.struct(*NIGHT_FIELDS), ["seq", "end_ts"], "nights")
    return listed.withColumn("n_nights", F.size("nights").cast("long"))


def scores_window(scores: DataFrame, windows: Windows) -> DataFrame:
    """Mean sleep scores as logged."""
    sums = WindowTree.of(windows).fold(scores, "ts", _means({c: c for c in SCORE_COLUMNS}))
    return sums.select(*WINDOW, *[F.round(_mean(c), 2).alias(f"mean_{c}") for c in SCORE_COLUMNS])


def wellness_window(wellness: DataFrame, windows: Windows) -> DataFrame:
    """Row count and the last questionnaire of the window."""
    found = WindowTree.of(windows).fold(wellness, "ts", {
        "n_wellness_rows": T.count("n_wellness_rows"), "last": T.latest(F.struct(*WELLNESS_FIELDS), "seq", "last")})
    return found.select(*WINDOW, "n_wellness_rows", F.col("last.value").alias("latest_wellness"))


def srpe_window(srpe: DataFrame, windows: Windows) -> DataFrame:
    """Sessions, mean exertion, minutes and load; missing parts count 0."""
    rpe, minutes = F.coalesce("rpe", F.lit(0.0)), F.coalesce("duration_min", F.lit(0.0))
    sums = WindowTree.of(windows).fold(srpe, "ts", {
        "n": T.count("n"), "minutes": T.total(minutes, "minutes"), "load": T.total(rpe * minutes, "load"), **_means({"rpe": "rpe"})})
    return sums.select(*WINDOW, F.col("n").alias("n_srpe_sessions"), F.round(_mean("rpe"), 2).alias("mean_rpe"),
                       F.col("minutes").cast("int").alias("srpe_total_duration_min"), F.round("load", 1).alias("training_load"))


def reporting_window(reporting: DataFrame, windows: Windows) -> DataFrame:
    """Last weight, fluids, any alcohol, and the meals logged."""
    tree = WindowTree.of(windows)
    known_weight = F.when(F.col("weight").isNotNull(), F.col("seq"))
    rows = reporting.withColumn("_meals", E.split_set("meals"))
    names = tree.fold(rows.select("participant_id", "ts", F.explode("_meals").alias("meal")), "ts", {"n": T.count("n")}, ["meal"])
    listed = sorted_list(names, WINDOW, F.col("meal"), ["meal"], "meal_names")
    drank = F.coalesce(F.lower("alcohol_consumed") == "yes", F.lit(False))
    found = tree.fold(rows, "ts", {
        "n_reporting_rows": T.count("n_reporting_rows"), "weight": T.latest(F.col("weight"), known_weight, "weight"),
        "fluid": T.total(F.coalesce("glasses_of_fluid", F.lit(0.0)), "fluid"), "drank": T.largest(drank, "drank"),
        "meals": T.total(F.size("_meals"), "meals")})
    return found.select(
        *WINDOW, "n_reporting_rows", F.col("weight.value").alias("weight_kg"), F.col("fluid").alias("total_glasses_of_fluid"),
        F.col("drank").alias("alcohol_consumed"), F.col("meals").alias("n_meals_logged")).join(listed, WINDOW, "left")


def window_injuries(injury: DataFrame, windows: Windows) -> DataFrame:
    """Long form: reports of a window that name an injury."""
    return WindowTree.of(windows).rows(injury.where(F.size("injuries") > 0), "ts").select(*WINDOW, "ts", "injuries")


def injury_window(injury: DataFrame, windows: Windows) -> DataFrame:
    """Reports in the window, the injuries they name and the last known state; reports are read, and their literals parsed, once."""
    tree, injury = WindowTree.of(windows), stored(injury, "injuries")
    counts = tree.fold(injury, "ts", {"reports_in_window": T.count("reports_in_window"),
                                      "is_injured": T.largest(F.size("injuries") > 0, "is_injured")})
    # Maps have no order, so they travel as entries through the sorted list.
    # Reports within one millisecond share a key; the last of them counts.
    reports = window_injuries(injury, tree).groupBy(*WINDOW, D.std_text("ts").alias("_key")).agg(
        F.max_by("ts", "ts").alias("ts"), F.max_by(F.map_entries("injuries"), "ts").alias("_entries"))
    entry = F.struct(F.col("_key").alias("key"), F.col("_entries").alias("value"))
    named = sorted_list(reports, WINDOW, entry, ["ts"], "_entries").select(
        *WINDOW, F.map_from_entries(F.transform("_entries", lambda e: F.struct(
            e["key"], F.map_from_entries(e["value"])))).alias("injuries"))
    state = last_known(injury, tree.windows, "ts", "injuries")
    return (tree.windows.select(*WINDOW).join(counts, WINDOW, "left").join(named, WINDOW, "left")
            .join(state, WINDOW, "left")
            .withColumns({"reports_in_window": F.coalesce("reports_in_window", F.lit(0).cast("long")),
                          "is_injured": F.coalesce("is_injured", F.lit(False)),
                          "has_report_in_window": F.coalesce(F.col("reports_in_window") > 0, F.lit(False))}))


def nutrition_totals(meal_macros: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """Sum of the meal estimates, one decimal; a missing part counts 0."""
    def total(c: str) -> Column:
        return F.round(F.sum(F.coalesce(F.col(c), F.lit(0.0))), 1)

    return meal_macros.groupBy(*keys).agg(
        F.count("*").alias("meals_from_photos"), total("calories").alias("estimated_calories_kcal"),
        *[total(c).alias(f"estimated_{c}_g") for c in ("protein", "carbohydrates", "fats")])
