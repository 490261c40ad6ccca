"""Ordered operations over event streams without one task per key.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, which
a key holding a third of the data breaks.  These helpers deal the rows out by
range of (key, order), so that chunks are about equal however many rows share a
key, an hour or a time stamp; they window inside ``(key, chunk)`` and carry the
boundary state from chunk to chunk through a summary with one row per key and
chunk.  Two rows of a key with equal order columns must not exist; callers add
a tie break to ``order``.

The dealt rows are stored in the shared folder: range bounds come from a
sample, and the summary and the rows must agree on them.  The chunk number
stays on the frame while several helpers run in a row (``keep_chunk``), so that
they share one chunking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.session import stored

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the chunk number, ascending within a key, unless an earlier helper left it there."""
    if CHUNK in df.columns:
        return df
    dealt = df.repartitionByRange(*keys, *order)
    return stored(dealt.withColumn(CHUNK, F.spark_partition_id().cast("long")), "chunks")


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                  values: dict[str, str], keep_chunk: bool = False) -> DataFrame:
    """Add columns of the preceding row of the same key (NULL on the first).

    ``values`` maps new column names to the source columns they lag.  Lagging
    only the time stamp needs just the latest stamp of each chunk, which stays
    in a hash aggregate.
    """
    by, order = [*keys, CHUNK], list(order)
    packed = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    rows = chunked(df, keys, order)
    if set(values.values()) == {ts}:
        latest = rows.groupBy(*by).agg(F.max(ts).alias("_ts"))
        tails = latest.select(*by, F.struct(*[F.col("_ts").alias(new) for new in values]).alias("_tail"))
    else:
        tails = rows.groupBy(*by).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carry = tails.select(
        *by, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carry"))
    inside = Window.partitionBy(*by).orderBy(*order)
    previous = F.coalesce(F.lag(packed).over(inside), F.col("_carry"))
    out = (rows.join(carry, by, "left").withColumn("_previous", previous)
           .withColumns({new: F.col("_previous").getField(new) for new in values})
           .drop("_carry", "_previous"))
    return out if keep_chunk else out.drop(CHUNK)


def with_running_sum(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                     value: Column, out: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` per key."""
    by = [*keys, CHUNK]
    rows = chunked(df, keys, order).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*by).agg(F.sum("_value").alias("_sum"))
               .select(*by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")))
    inside = (Window.partitionBy(*by).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.join(offsets, by, "left")
            .withColumn(out, F.col("_offset") + F.sum("_value").over(inside))
            .drop(CHUNK, "_value", "_offset"))


def with_position(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                  out: str = "position") -> DataFrame:
    """Add the 1-based row number per key."""
    return with_running_sum(df, keys, ts, order, F.lit(1).cast("long"), out)
