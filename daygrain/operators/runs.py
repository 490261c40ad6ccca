"""Gaps, bursts, runs and non-wear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.functions.dates import epoch_us, minute, minute_of_day, seconds_between
from daygrain.operators.ordered import CHUNK, with_previous, with_running_sum
from daygrain.operators.stats import exact_quantiles
from daygrain.session import cut_lineage

BURST_SECONDS = 15
# Least width of the time chunks in which pairs are counted.
CHUNK_SECONDS = 3600
NONWEAR_MIN_RUN = 60
DAY_MINUTES = 1440
SWEEP_SECONDS = (15, 60, 120, 300, 1800)


def gaps(events: DataFrame, keys: Sequence[str], ts: str, ident: str) -> DataFrame:
    """Seconds since the previous event of the key; the first event is left out."""
    out = with_previous(events.where(F.col(ts).isNotNull()), keys, ts, [ts, ident], {"previous_ts": ts})
    return (out.where(F.col("previous_ts").isNotNull())
            .withColumn("gap_s", seconds_between("previous_ts", ts)))


def gap_profile(gap_table: DataFrame, keys: Sequence[str], col: str = "gap_s") -> DataFrame:
    """Quartiles in hours and the shares of short and long gaps in percent."""
    keys = list(keys)
    gap = F.col(col)

    def share(condition: Column) -> Column:
        return F.round(F.avg(condition.cast("double")) * 100, 1)

    shares = gap_table.groupBy(*keys).agg(
        F.count("*").alias("n_gaps"),
        share(gap <= 1800).alias("pct_le_30min"), share(gap <= 3600).alias("pct_le_60min"),
        share(gap > 21600).alias("pct_gt_6h"))
    quart = exact_quantiles(gap_table, keys, col, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    hours = quart.select(*keys, *[F.round(F.col(q) / 3600, 2).alias(f"{q}_interval_h")
                                  for q in ("median", "p25", "p75")])
    return shares.join(hours, keys, "left")


def burst_starts(events: DataFrame, keys: Sequence[str], ts: str, ident: str,
                 seconds: float = BURST_SECONDS) -> DataFrame:
    """Mark the first event of every burst (gap to the previous one > seconds)."""
    return _marked(events, keys, ts, ident, seconds).drop(CHUNK)


def _marked(events: DataFrame, keys: Sequence[str], ts: str, ident: str, seconds: float) -> DataFrame:
    out = with_previous(events.where(F.col(ts).isNotNull()), keys, ts, [ts, ident], {"_prev": ts},
                        keep_chunk=True)
    first = F.col("_prev").isNull() | (seconds_between("_prev", ts) > seconds)
    return out.withColumn("is_start", first.cast("int")).drop("_prev")


def burst_groups(events: DataFrame, keys: Sequence[str], ts: str, ident: str,
                 seconds: float = BURST_SECONDS) -> DataFrame:
    """Number the bursts of each key: events up to ``seconds`` apart share one.

    Put the day into ``keys`` to cut bursts at midnight.  Events without a
    timestamp belong to no burst and are left out.
    """
    marked = _marked(events, keys, ts, ident, seconds)
    return with_running_sum(marked, keys, ts, [ts, ident], F.col("is_start"), "burst").drop("is_start")


def burst_representatives(groups: DataFrame, keys: Sequence[str], ts: str, ident: str) -> DataFrame:
    """First shot, extent and size of each burst."""
    return groups.groupBy(*keys, "burst").agg(
        F.min_by(ident, F.struct(ts, ident)).alias("representative"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count("*").alias("n_events"))


def runs(df: DataFrame, keys: Sequence[str], ts: str, ident: str, flag: str) -> DataFrame:
    """Run-length encoding: start, end and length of each run of true flags."""
    keys, order = list(keys), [ts, ident]
    lagged = with_previous(df, keys, ts, order, {"_before": flag}, keep_chunk=True)
    begins = (F.col(flag) & ~F.coalesce("_before", F.lit(False))).cast("int")
    numbered = with_running_sum(lagged, keys, ts, order, begins, "run")
    return (numbered.where(F.col(flag)).groupBy(*keys, "run")
            .agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"),
                 F.count("*").alias("n_rows")))


def hr_minute_state(hr: DataFrame, ts: str = "ts", bpm: str = "bpm") -> DataFrame:
    """Per participant and minute: ``flat`` (>= 2 equal samples) or ``live``.

    Minutes without a row have no sample.
    """
    return (hr.where(F.col(bpm).isNotNull())
            .groupBy("participant_id", minute(ts).alias("minute"))
            .agg(F.count("*").alias("n_samples"),
                 F.when((F.count("*") >= 2) & (F.min(bpm) == F.max(bpm)), "flat")
                 .otherwise("live").alias("state")))


def _worn_minutes(steps: DataFrame, hr: DataFrame) -> DataFrame:
    """Distinct minutes that prove the device was worn."""
    moving = (steps.where(F.col("value") > 0)
              .select("participant_id", minute("ts").alias("minute")))
    live = hr_minute_state(hr).where(F.col("state") == "live").select("participant_id", "minute")
    return moving.unionByName(live).distinct()


def nonwear_daily(steps: DataFrame, hr: DataFrame, spine: DataFrame,
                  min_run: int = NONWEAR_MIN_RUN) -> DataFrame:
    """Minutes in runs of >= ``min_run`` unworn minutes, runs cut at midnight.

    A minute is unworn when it has no step and no live heart rate.  Only the
    worn minutes are stored: a run is the distance between two of them (the
    day edges count as worn), so no minute grid is built and a day holds at
    most 1440 rows.
    """
    worn = (_worn_minutes(steps, hr)
            .select("participant_id", F.to_date("minute").alias("date"), minute_of_day("minute").alias("_m")))
    # The day's edge comes from the spine, so days off the spine are the ones without it.
    edge = spine.select("participant_id", "date", F.lit(-1).alias("_m"))
    by_day = Window.partitionBy("participant_id", "date").orderBy("_m")
    run = F.lead("_m", 1, DAY_MINUTES).over(by_day) - F.col("_m") - 1
    unworn = (worn.unionByName(edge).withColumn("_run", run)
              .groupBy("participant_id", "date")
              .agg(F.min("_m").alias("_edge"),
                   F.coalesce(F.sum(F.when(F.col("_run") >= min_run, F.col("_run"))), F.lit(0))
                   .alias("nonwear_min")).where(F.col("_edge") == -1))
    return unworn.select("participant_id", "date", "nonwear_min",
                         F.round(F.col("nonwear_min") / 60, 2).alias("nonwear_hours"),
                         (F.col("nonwear_min") > 0).cast("int").alias("has_nonwear"))


def nonwear_runs(steps: DataFrame, hr: DataFrame, participants: DataFrame,
                 start: str, end: str, min_run: int = NONWEAR_MIN_RUN) -> DataFrame:
    """Unworn runs over the continuous horizon; they may cross midnight.

    Gaps inside a day are found per (participant, day); the gap over each
    midnight comes from the first and last worn minute of the days around it.
    """
    zero = F.lit(start).cast("date")
    horizon = F.datediff(F.lit(end).cast("date"), zero) + 1
    position = (F.datediff(F.to_date("minute"), zero) * DAY_MINUTES + minute_of_day("minute")).cast("long")
    worn = (_worn_minutes(steps, hr)
            .select("participant_id", F.to_date("minute").alias("_day"), position.alias("_p"))
            .where(F.col("_p").between(F.lit(0), horizon * DAY_MINUTES - 1)))
    by_day = Window.partitionBy("participant_id", "_day").orderBy("_p")
    inside = worn.withColumn("_next", F.lead("_p").over(by_day)).where(
        F.col("_next") - F.col("_p") - 1 >= min_run).select(
        "participant_id", (F.col("_p") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"))
    days = (worn.groupBy("participant_id", "_day")
            .agg(F.min("_p").alias("_first"), F.max("_p").alias("_last")))
    edge = participants.select("participant_id", F.lit(None).cast("date").alias("_day"),
                               F.lit(None).cast("long").alias("_first"), F.lit(-1).cast("long").alias("_last"))
    by_participant = Window.partitionBy("participant_id").orderBy(F.col("_last"))
    next_first = F.coalesce(F.lead("_first").over(by_participant), horizon * DAY_MINUTES)
    across = days.unionByName(edge).withColumn("_next", next_first).where(
        F.col("_next") - F.col("_last") - 1 >= min_run).select(
        "participant_id", (F.col("_last") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"))
    return inside.unionByName(across).withColumn("n_min", F.col("_to") - F.col("_from") + 1)


def nonwear_horizon(steps: DataFrame, hr: DataFrame, participants: DataFrame,
                    start: str, end: str, min_run: int = NONWEAR_MIN_RUN) -> DataFrame:
    """Minutes of horizon runs split to the days they touch."""
    long_runs = nonwear_runs(steps, hr, participants, start, end, min_run)
    first, last = (F.floor(F.col(c) / DAY_MINUTES) for c in ("_from", "_to"))
    spread = long_runs.withColumn("_d", F.explode(F.sequence(first, last)))
    minutes = (F.least(F.col("_to"), F.col("_d") * DAY_MINUTES + DAY_MINUTES - 1)
               - F.greatest(F.col("_from"), F.col("_d") * DAY_MINUTES) + 1)
    return (spread.groupBy("participant_id",
                           F.date_add(F.lit(start).cast("date"), F.col("_d").cast("int")).alias("date"))
            .agg(F.sum(minutes).alias("nonwear_min"))
            .withColumn("nonwear_hours", F.round(F.col("nonwear_min") / 60, 2)))


def threshold_sweep(pairs: DataFrame, thresholds: Sequence[int] = SWEEP_SECONDS,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Confirmed pairs under each gap threshold, in one aggregation.

    ``pairs`` has ``gap_s`` and a boolean ``same_meal``.
    """
    aggs = []
    for t in thresholds:
        near = F.col("gap_s") <= t
        aggs += [F.count_if(near).alias(f"n_{t}"), F.count_if(near & F.col("same_meal")).alias(f"c_{t}")]
    return _sweep_rows(pairs.groupBy(*keys).agg(*aggs), thresholds, keys)


def _sweep_rows(wide: DataFrame, thresholds: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """A row per threshold out of the columns ``n_<t>`` and ``c_<t>``."""
    rows = F.array(*[F.struct(F.lit(t).alias("threshold_s"), F.col(f"n_{t}").alias("n_pairs"),
                              F.col(f"c_{t}").alias("n_confirmed")) for t in thresholds])
    out = wide.select(*keys, F.inline(rows))
    return out.withColumn("confirm_rate_pct", F.round(
        100 * F.col("n_confirmed") / F.nullif(F.col("n_pairs"), F.lit(0)), 1))


def pair_sweep(events: DataFrame, key: str, ts: str, same: Column, thresholds: Sequence[int] = SWEEP_SECONDS,
               keys: Sequence[str] = ()) -> DataFrame:
    """``threshold_sweep`` without the pairs, for the verdict that both events agree in ``same``.

    Events of one key, stamp and ``same`` fold to one row with a count.  Each
    chunk of time also receives what follows within the longest threshold, so
    that one pass over it counts the partners of every row for all thresholds
    by range frames.  Rows meet in no join, and a stamp with half of the events
    is a few rows.
    """
    widths = {t: int(t * 1_000_000) for t in thresholds}
    longest = max(widths.values())
    chunk_us = max(CHUNK_SECONDS * 1_000_000, longest)
    ticks = (events.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
             .groupBy(key, epoch_us(ts).alias("_us"), F.struct(same.alias("label")).alias("_same")).agg(F.count("*").alias("_n")))
    own = F.floor(F.col("_us") / F.lit(chunk_us))
    reached = F.sequence(F.floor((F.col("_us") - longest) / F.lit(chunk_us)), own)
    spread = ticks.withColumn("_own", own).withColumn("_chunk", F.explode(reached))
    by_time = Window.partitionBy(key, "_chunk").orderBy("_us")
    by_same = Window.partitionBy(key, "_chunk", "_same").orderBy("_us")
    n, agrees = F.col("_n"), F.col("_same.label").isNotNull()
    at_once = F.sum("_n").over(by_time.rangeBetween(0, 0))
    counted = spread.withColumns({f"_p{t}": n * (F.coalesce(F.sum("_n").over(by_time.rangeBetween(1, w)), F.lit(0)) + (at_once - 1) / 2)
                                  for t, w in widths.items()})
    counted = counted.withColumns({f"_c{t}": n * (F.coalesce(F.sum("_n").over(by_same.rangeBetween(1, w)), F.lit(0)) + (n - 1) / 2)
                                   for t, w in widths.items()})
    sums = counted.where(F.col("_chunk") == F.col("_own")).groupBy(*keys).agg(*[
        F.round(F.sum(v)).cast("long").alias(name) for t in thresholds
        for v, name in ((F.col(f"_p{t}"), f"n_{t}"), (F.when(agrees, F.col(f"_c{t}")).otherwise(0.0), f"c_{t}"))])
    return _sweep_rows(sums, thresholds, keys)


def median_gap_by_verdict(pairs: DataFrame) -> DataFrame:
    """Median gap of confirmed and of rejected pairs."""
    return exact_quantiles(pairs, ["same_meal"], "gap_s", {"median_gap_s": 0.5})


def pair_counts_within(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Number of event pairs per key at most ``seconds`` apart, without the pairs.

    Equal stamps are folded to one row with a count first.  Each chunk also
    receives the rows up to ``seconds`` after its end, so a range frame inside
    the chunk sees all partners.
    """
    width = int(seconds * 1_000_000)
    chunk_us = max(CHUNK_SECONDS * 1_000_000, width)
    ticks = (events.where(F.col(ts).isNotNull()).groupBy(key, epoch_us(ts).alias("_us"))
             .agg(F.count("*").alias("_n")))
    own = F.floor(F.col("_us") / F.lit(chunk_us))
    first = F.floor((F.col("_us") - width) / F.lit(chunk_us))
    spread = ticks.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(first, own)))
    after = Window.partitionBy(key, "_chunk").orderBy("_us").rangeBetween(1, width)
    later = F.coalesce(F.sum("_n").over(after), F.lit(0))
    counted = spread.withColumn(
        "_pairs", F.col("_n") * later + F.floor(F.col("_n") * (F.col("_n") - 1) / 2))
    return (counted.where(F.col("_chunk") == F.col("_own"))
            .groupBy(key).agg(F.sum("_pairs").alias("n_pairs")))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Connected components; the smallest vertex is the root.

    ``edges``: src, dst; ``vertices``: node.  Alternates large-star and
    small-star rounds until nothing changes, which takes O(log n) rounds in
    practice even on long chains.  Each round is one min-aggregation (folded map-side) and one join;
    lineage is cut into the shared checkpoint folder.
    """
    hubs = (edges.where(F.col("src") != F.col("dst"))
            .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    hubs = cut_lineage(hubs)
    after, before = _signature(hubs), None
    while after != before:
        hubs = cut_lineage(_small_star(_large_star(hubs)))
        after, before = _signature(hubs), after
    roots = hubs.groupBy("u").agg(F.min("v").alias("_root"))
    return (vertices.select("node").distinct().join(roots, F.col("node") == F.col("u"), "left")
            .select("node", F.coalesce("_root", "node").alias("component")))


def _signature(hubs: DataFrame) -> tuple:
    row = hubs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(hubs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to its smallest neighbour."""
    both = hubs.select("u", "v").unionByName(hubs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(smallest, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())


def _small_star(hubs: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    down = hubs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(smallest, "u")
    return (linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(smallest.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())
