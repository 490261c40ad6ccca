"""Mutual information of columns with a label by nearest neighbours.

The estimate compares, for every row, the distance to its k-th neighbour in the
plane of (column, label) with the numbers of rows nearer than that along each
axis.  Nothing compares all pairs of rows:

* equal rows fold to one point with a count, and points are dealt to cells of
  ``cell`` to ``2 * cell`` points by exact positions (strips along the column,
  cells along the label inside a strip), however the values are spread or tied;
* a point's own cell bounds its distance, and only the cells whose box reaches
  inside that bound are visited after it;
* the counts along an axis are differences of running sums over the sorted
  values and interval ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.operators.correlation import finite
from daygrain.operators.ordered import with_position, with_running_sum
from daygrain.operators.stats import exact_quantiles
from daygrain.session import stored

NEIGHBOURS, CELL = 3, 256
#: Points that ask one cell in one task, and distances in one array of a task.
ASKERS, DISTANCES = 1 << 16, 1 << 20
#: Radii end this share before the k-th neighbour, so that rounding does not let it in.
INSIDE = 1.0 - 2.0 ** -30
_PLACE = ["column", "_strip", "_cell"]
_POINT = ["column", "_x", "_y"]
_NEAR = "column string, _x double, _y double, _near array<double>"


def digamma(n: Column) -> Column:
    """Digamma of a whole number of at least one: the asymptotic series ten steps up, and back down."""
    n = n.cast("double")
    up = n + 10
    series = F.ln(up) - 1 / (2 * up) - 1 / (12 * up ** 2) + 1 / (120 * up ** 4) - 1 / (252 * up ** 6) + 1 / (240 * up ** 8)
    return series - sum((1 / (n + i) for i in range(1, 10)), 1 / n)


def _nearest(qx: np.ndarray, qy: np.ndarray, own: np.ndarray | None, x: np.ndarray, y: np.ndarray,
             count: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each asking point its k least distances to rows of the cell; ``own`` is its place in the cell."""
    points = np.repeat(np.arange(len(x)), np.minimum(count, k))
    px, py = x[points], y[points]
    step = max(1, DISTANCES // max(1, len(points)))
    for start in range(0, len(qx), step):
        part = slice(start, start + step)
        d = np.maximum(np.abs(px - qx[part, None]), np.abs(py - qy[part, None]))
        if own is not None:
            # A point is no neighbour of itself, but its further copies are; beyond k of them all k are at zero.
            rows = np.flatnonzero(count[own[part]] <= k)
            d[rows, np.searchsorted(points, own[part][rows])] = np.inf
        least = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d
        yield from np.sort(least, axis=1)


def _scaled_points(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Distinct points (column, _x, _y) with counts: medians for what is unknown, deviations from the mean in units of sd."""
    known = finite(df, [*cols, label]).where(F.col(label).isNotNull())
    long = known.select(F.col(label).alias("_y"), *cols).unpivot(["_y"], list(cols), "column", "_x")
    median = exact_quantiles(long, ["column"], "_x", {"_median": 0.5})
    filled = long.join(median, "column").select("column", "_y", F.coalesce("_x", "_median").alias("_x"))
    moments = filled.groupBy("column").agg(F.count("*").alias("n"), *[
        f.alias(f"{c}_{name}") for c in ("_x", "_y") for name, f in (
            ("mean", F.avg(c)), ("sd", F.when(F.min(c) < F.max(c), F.stddev_pop(c)).otherwise(1.0)))])
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") + 0.0 for c in ("_x", "_y")}
    return (filled.join(moments, "column").select("column", "n", *[v.alias(c) for c, v in scaled.items()])
            .groupBy(*_POINT).agg(F.count("*").alias("_count"), F.max("n").alias("n")))


def _celled(points: DataFrame, cell: int) -> DataFrame:
    """Deal the points of every column to strips by (x, y) and the points of a strip to cells by (y, x)."""
    sizes = points.groupBy("column").agg(F.count("*").alias("_points"))
    placed = with_position(points, ["column"], "_x", ["_x", "_y"], "_at").join(sizes, "column")
    wide = F.ceil(F.sqrt(F.col("_points") * F.lit(float(cell))))

    def block(position: Column, total: Column, size: Column) -> Column:
        return F.least(F.floor((position - 1) / size), F.greatest(F.floor(total / size) - 1, F.lit(0)))

    strips = placed.withColumn("_strip", block(F.col("_at"), F.col("_points"), wide))
    inside = Window.partitionBy("column", "_strip")
    rank = F.row_number().over(inside.orderBy("_y", "_x"))
    return strips.select("*", rank.alias("_rank"), F.count("*").over(inside).alias("_size")).select(
        *_PLACE[:2], block(F.col("_rank"), F.col("_size"), F.lit(cell)).alias("_cell"), "_x", "_y", "_count", "n")


def _visits(celled: DataFrame, bounds: DataFrame) -> DataFrame:
    """A row per point and foreign cell whose box is nearer than the point's bound."""
    ends = [f(c).alias(f"{c}_{name}") for c in ("_x", "_y") for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = celled.groupBy(*_PLACE).agg(*ends)
    cells = boxes.groupBy("column", "_strip").agg(
        F.collect_list(F.struct("_cell", "_x_lo", "_x_hi", "_y_lo", "_y_hi")).alias("_cells"),
        F.min("_x_lo").alias("_x_lo"), F.max("_x_hi").alias("_x_hi"), F.min("_y_lo").alias("_y_lo"), F.max("_y_hi").alias("_y_hi"))
    strips = cells.groupBy("column").agg(F.collect_list(F.struct("_strip", "_x_lo", "_x_hi", "_y_lo", "_y_hi")).alias("_strips"))

    def reached(box: Column) -> Column:
        return F.greatest(*[gap for c in ("_x", "_y") for gap in (box[f"{c}_lo"] - F.col(c), F.col(c) - box[f"{c}_hi"])]) < F.col("_bound")

    met = (bounds.join(strips, "column")
           .select(*_POINT, "_bound", F.col("_strip").alias("_from_strip"), F.col("_cell").alias("_from_cell"),
                   F.explode(F.filter("_strips", reached)["_strip"]).alias("_strip"))
           .join(cells.select("column", "_strip", "_cells"), ["column", "_strip"])
           .select("column", "_strip", "_x", "_y", "_from_strip", "_from_cell",
                   F.explode(F.filter("_cells", reached)["_cell"]).alias("_cell")))
    return met.where((F.col("_strip") != F.col("_from_strip")) | (F.col("_cell") != F.col("_from_cell"))).drop("_from_strip", "_from_cell")


def neighbour_distances(celled: DataFrame, k: int) -> DataFrame:
    """Distance ``_d`` of every point to its k-th neighbouring row (larger coordinate difference); infinite below k others."""
    def own(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = cell["_x"].to_numpy(), cell["_y"].to_numpy()
        near = list(_nearest(x, y, np.arange(len(x)), x, y, cell["_count"].to_numpy(), k))
        return cell[[*_PLACE, "_x", "_y"]].assign(_near=near)

    # Stored: the visits and the merge read it.
    types = dict(celled.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*_PLACE, "_x", "_y")) + ", _near array<double>"
    first = stored(celled.select(*_PLACE, "_x", "_y", "_count").groupBy(*_PLACE).applyInPandas(own, schema), "nearest")
    bounds = first.withColumn("_bound", F.coalesce(F.get("_near", F.lit(k - 1)), F.lit(float("inf"))))
    visits = stored(_visits(celled, bounds.where(F.col("_bound") > 0)), "visits")
    # A cell that many points ask is copied to as many tasks as its askers fill.
    turns = visits.groupBy(*_PLACE).agg(F.ceil(F.count("*") / F.lit(float(ASKERS))).alias("_turns"))
    keys = [*_PLACE, "_turn"]
    asked = celled.join(turns, _PLACE).select(
        *_PLACE, "_x", "_y", "_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_turns") - 1)).alias("_turn"))
    askers = visits.join(turns.withColumnRenamed("_turns", "_of"), _PLACE).select(
        *_PLACE, "_x", "_y", F.pmod(F.xxhash64("_x", "_y"), F.col("_of")).alias("_turn"))

    def visit(cell: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        near = list(_nearest(points["_x"].to_numpy(), points["_y"].to_numpy(), None, cell["_x"].to_numpy(), cell["_y"].to_numpy(),
                             cell["_count"].to_numpy(), k))
        # Typed, since a turn may have no askers.
        return points[_POINT].assign(_near=pd.Series(near, index=points.index, dtype=object))

    visited = asked.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(visit, _NEAR)
    merged = first.select(*_POINT, "_near").unionByName(visited).groupBy(*_POINT).agg(F.flatten(F.collect_list("_near")).alias("_near"))
    return merged.select(*_POINT, F.coalesce(F.get(F.array_sort("_near"), F.lit(k - 1)), F.lit(float("inf"))).alias("_d"))


def _rows_within(points: DataFrame, distances: DataFrame) -> DataFrame:
    """Rows ``_rows`` nearer than ``_d`` (or equal, where that is zero) of every point along each axis, itself included."""
    radius = F.col("_d") * INSIDE
    ends = F.array(*[F.struct(F.lit(axis).alias("_axis"), value.alias("_v"), F.lit(kind).alias("_kind"))
                     for axis, c in enumerate(("_x", "_y")) for kind, value in ((0, F.col(c) - radius), (2, F.col(c) + radius))])
    asked = distances.select(*_POINT, F.inline(ends)).withColumn("_w", F.lit(0).cast("long"))
    values = F.array(*[F.struct(F.lit(axis).alias("_axis"), F.col(c).alias("_v")) for axis, c in enumerate(("_x", "_y"))])
    held = (points.select("column", "_count", F.inline(values)).groupBy("column", "_axis", "_v").agg(F.sum("_count").alias("_w"))
            .select("column", "_axis", "_v", F.lit(1).alias("_kind"), "_w"))
    events = asked.unionByName(held, allowMissingColumns=True)
    summed = with_running_sum(events, ["column", "_axis"], "_v", ["_v", "_kind", "_x", "_y"], F.col("_w"), "_sum")
    signed = F.when(F.col("_kind") == 2, F.col("_sum")).otherwise(-F.col("_sum"))
    return summed.where(F.col("_kind") != 1).groupBy(*_POINT, "_axis").agg(F.sum(signed).alias("_rows"))


def neighbour_mi(df: DataFrame, cols: Sequence[str], label: str, k: int = NEIGHBOURS, cell: int = CELL) -> DataFrame:
    """Mutual information ``mi`` (nats) of each column and the label over the ``n`` labelled rows.

    Unknown values take the median of the column's labelled rows; column and
    label are measured in standard deviations.  Per row, with ``d`` the larger
    coordinate difference to its k-th neighbour and ``a``, ``b`` the rows (it
    included) nearer than ``d`` along each axis:
    ``mi = psi(n) + mean(psi(k) - psi(a) - psi(b))``, never below zero.  Where
    more than ``k`` equal rows make ``d`` zero, their number stands for ``k``
    and equal values are counted; so ties need no random noise.  Fewer than
    ``k + 1`` labelled rows, or a column that is never known, give NULL.
    """
    if k < 1 or cell <= k:
        raise ValueError("k must be positive and below cell")
    cols = list(cols)
    if not cols:
        raise ValueError("no columns")
    spark = df.sparkSession
    # Stored: sums of doubles differ in the last digit between runs, and every later step must see the same points.
    points = stored(_scaled_points(df, cols, label), "points")
    celled = stored(_celled(points, cell), "cells")
    enough = stored(neighbour_distances(celled, k), "distances").where(F.col("_d") < float("inf"))
    within = _rows_within(points, enough)
    axes = within.groupBy(*_POINT).agg(F.sum(digamma(F.col("_rows"))).alias("_axes"))
    share = digamma(F.when(F.col("_count") > k, F.col("_count")).otherwise(k)) - F.col("_axes")
    found = points.join(axes, _POINT).groupBy("column").agg(F.sum(F.col("_count") * share).alias("_sum"), F.max("n").alias("_n"))
    labelled = finite(df, [label]).agg(F.count(label).alias("n"))
    names = spark.createDataFrame([(c,) for c in cols], "column string")
    raw = digamma(F.col("_n")) + F.col("_sum") / F.col("_n")
    return names.join(found, "column", "left").select(
        "column", F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0))).alias("mi"), labelled.scalar().alias("n"))
