"""Aggregates over many windows by a dyadic tree over time.

A window is a half-open interval of microseconds.  Time is cut into slots, two
a day: all up to 23:59:59.999, where a window that ends with a day ends, and
the millisecond after it.

1. Rows fold to slots, once.  In a slot that a window begins or ends in, rows
   fold to the stretches between such cuts; the cuts of a slot are one row.
2. Slots fold to blocks of 2, 4, 8 ... slots, and the stretches of a cut slot
   to blocks of stretches.
3. A window is the sum of at most two blocks of every size, found by
   arithmetic, and of as few blocks of stretches in the slots it cuts.

So a window of n days takes about 2 log n rows instead of n, rows are read once
whatever the number of windows, and no sum is a difference of others.  Rows in slots
that no window touches, and blocks that no window is made of, are dropped before a shuffle.

``fold`` takes aggregates that can be merged: name -> (aggregate of rows,
aggregate that merges its results).  ``rows`` matches the rows themselves, for
results that list them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.functions.dates import epoch_us
from daygrain.session import stored

WINDOW = ["participant_id", "window_id"]
DAY_US = 86_400_000_000
#: Start of the second slot of a day, behind its last millisecond.
LATE_US = 86_399_999_001
#: The axis of the slots themselves; stretches have their slot as axis.
SLOTS = -(1 << 62)
#: Cut slots, or blocks of any participant, that are sent to every task: a million rows, some tens of megabytes.
SENT_ROWS = 1_000_000

Fold = Mapping[str, tuple[Column, Column]]


def total(value: Column | str, name: str) -> tuple[Column, Column]:
    """A sum; NULL without a value."""
    return F.sum(value), F.sum(name)


def count(name: str) -> tuple[Column, Column]:
    """The number of rows."""
    return F.count("*"), F.sum(name)


def known(value: Column | str, name: str) -> tuple[Column, Column]:
    """The number of rows with a value."""
    return F.count(value), F.sum(name)


def largest(value: Column | str, name: str) -> tuple[Column, Column]:
    """A maximum; NULL without a value."""
    return F.max(value), F.max(name)


def latest(value: Column, order: Column | str, name: str) -> tuple[Column, Column]:
    """(order, value) of the row that is last by ``order``; rows without an order do not count."""
    order = F.col(order) if isinstance(order, str) else order
    entry = F.struct(order.alias("order"), value.alias("value"))
    return F.max_by(entry, order), F.max_by(name, F.col(f"{name}.order"))


def slot_of(us: Column) -> Column:
    """The slot that holds a time in microseconds."""
    return 2 * F.floor(us / F.lit(DAY_US)) + F.when(F.pmod(us, F.lit(DAY_US)) >= LATE_US, 1).otherwise(0)


def slot_start(slot: Column) -> Column:
    """The first microsecond of a slot."""
    return F.floor(slot / 2) * DAY_US + F.pmod(slot, F.lit(2)) * LATE_US


def _ranged(windows: DataFrame) -> DataFrame:
    """Adds the interval, the slots wholly inside it, and the cuts that the rest of it makes."""
    lo, hi = F.col("_lo"), F.col("_hi")
    first = slot_of(lo) + F.when(lo > slot_start(slot_of(lo)), 1).otherwise(0)
    out = windows.withColumns({"_lo": epoch_us("lower"), "_hi": epoch_us("upper") + F.col("inclusive").cast("int")})
    out = out.withColumns({"_first": first, "_last": slot_of(hi)})
    # What is left of the window: [from, to) in one slot each; the ends of the slot itself are no cuts.
    head = F.struct(slot_of(lo).alias("slot"), lo.alias("from"), F.when(F.col("_first") <= F.col("_last"), None).otherwise(hi).alias("to"))
    tail = F.struct(F.col("_last").alias("slot"), F.lit(None).cast("long").alias("from"), hi.alias("to"))
    is_head = (lo < hi) & ((F.col("_first") > F.col("_last")) | (F.col("_first") > slot_of(lo)))
    is_tail = (lo < hi) & (F.col("_first") <= F.col("_last")) & (hi > slot_start(F.col("_last")))
    return out.withColumn("_rests", F.filter(F.array(F.when(is_head, head), F.when(is_tail, tail)), lambda r: r.isNotNull()))


def _dyadic(pieces: DataFrame, *keep: str) -> DataFrame:
    """(keep, _axis, _level, _node): at most two blocks of every size whose union is [_from, _to)."""
    level = F.col("_level")

    def shifted(expression: str) -> Column:
        return F.expr(f"shiftright({expression}, _level)")

    levelled = pieces.where("_from < _to").withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_to") - F.col("_from"))).cast("int") + 1)))
    cut = levelled.withColumns({"_l": shifted("_from + shiftleft(1L, _level) - 1"), "_r": shifted("_to")}).where("_l < _r")
    left = F.when(F.col("_l") % 2 != 0, F.col("_l"))
    right = F.when(F.col("_r") % 2 != 0, F.col("_r") - 1)
    nodes = F.explode(F.filter(F.array(left, right), lambda n: n.isNotNull()))
    return cut.select(*keep, "_axis", level.alias("_level"), nodes.alias("_node"))


class WindowTree:
    """Windows (participant_id, window_id, lower, upper, inclusive) ready to meet rows.

    The blocks of the windows and the cut slots are stored once, as many rows
    as there are windows times the logarithm of their length.
    """

    def __init__(self, windows: DataFrame):
        self.windows = windows
        ranged = stored(_ranged(windows.select(*WINDOW, "lower", "upper", "inclusive")), "windows")
        rests = ranged.select(*WINDOW, F.explode("_rests").alias("_rest")).select(*WINDOW, "_rest.*")
        cuts = rests.select("participant_id", F.col("slot").alias("_slot"), F.explode(F.array("from", "to")).alias("cut"))
        grouped = cuts.where("cut IS NOT NULL").groupBy("participant_id", "_slot").agg(F.array_sort(F.collect_set("cut")).alias("_cuts"))
        self.cuts = stored(grouped, "cuts")
        at = {c: F.array_position("_cuts", F.col(c)) for c in ("from", "to")}
        placed = rests.withColumnRenamed("slot", "_slot").join(self.cuts, ["participant_id", "_slot"]).select(
            *WINDOW, F.col("_slot").alias("_axis"), F.when(F.col("from").isNull(), 0).otherwise(at["from"]).cast("long").alias("_from"),
            F.when(F.col("to").isNull(), F.size("_cuts") + 1).otherwise(at["to"]).cast("long").alias("_to"))
        whole = ranged.select(*WINDOW, F.lit(SLOTS).alias("_axis"), F.col("_first").alias("_from"), F.col("_last").alias("_to"))
        self.blocks = stored(_dyadic(whole.unionAll(placed), *WINDOW), "blocks")
        self.height = self.blocks.agg(F.max("_level")).first()[0] or 0
        self.n_cuts = self.cuts.count()
        # What the windows of any participant are made of, and the slots that these blocks and the cuts cover.
        self.needed = stored(self.blocks.select("_axis", "_level", "_node").distinct(), "needed")
        self.n_needed = self.needed.count()
        whole = self.needed.where(F.col("_axis") == SLOTS).select(
            F.expr("shiftleft(_node, _level)").alias("_from"), F.expr("shiftleft(_node + 1, _level)").alias("_to"))
        self.n_covered = (whole.agg(F.sum(F.col("_to") - F.col("_from"))).first()[0] or 0) + self.n_cuts
        self.covered = (whole.select(F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_slot"))
                        .unionAll(self.cuts.select("_slot")).distinct())

    @classmethod
    def of(cls, windows: DataFrame | WindowTree) -> WindowTree:
        return windows if isinstance(windows, WindowTree) else cls(windows)

    def _placed(self, df: DataFrame, ts: str) -> DataFrame:
        """Adds the slot of a row and, where windows cut the slot, the stretch in it."""
        timed = df.where(F.col(ts).isNotNull()).withColumn("_us", epoch_us(ts))
        out = timed.withColumn("_slot", slot_of(F.col("_us")))
        if self.n_covered <= SENT_ROWS:
            out = out.join(F.broadcast(self.covered), "_slot", "left_semi")
        if not self.n_cuts:
            return out.withColumn("_stretch", F.lit(None).cast("int"))
        cuts = F.broadcast(self.cuts) if self.n_cuts <= SENT_ROWS else self.cuts
        inside = F.size(F.filter("_cuts", lambda c: c <= F.col("_us")))
        return out.join(cuts, ["participant_id", "_slot"], "left").withColumn(
            "_stretch", F.when(F.col("_cuts").isNotNull(), inside)).drop("_cuts")

    def _raised(self, placed: DataFrame) -> DataFrame:
        """Rows at every block that holds them."""
        slot = F.struct(F.lit(SLOTS).alias("_axis"), F.col("_slot").cast("long").alias("_at"))
        stretch = F.struct(F.col("_slot").cast("long").alias("_axis"), F.col("_stretch").cast("long").alias("_at"))
        places = F.when(F.col("_stretch").isNull(), F.array(slot)).otherwise(F.array(slot, stretch))
        levels = F.array(*[F.lit(i) for i in range(self.height + 1)])
        raised = (placed.withColumn("_place", F.explode(places)).withColumn("_level", F.explode(levels))
                  .withColumns({"_axis": F.col("_place._axis"), "_node": F.expr("shiftright(_place._at, _level)")})
                  .drop("_place", "_slot", "_stretch"))
        return raised.join(F.broadcast(self.needed), ["_axis", "_level", "_node"], "left_semi") if self.n_needed <= SENT_ROWS else raised

    def fold(self, df: DataFrame, ts: str, fold: Fold, keys: Sequence[str] = ()) -> DataFrame:
        """One row per window (and ``keys``) that holds rows, with the merged aggregates."""
        merged = [merge.alias(name) for name, (_, merge) in fold.items()]
        leaves = self._placed(df, ts).groupBy("participant_id", "_slot", "_stretch", *keys).agg(
            *[partial.alias(name) for name, (partial, _) in fold.items()])
        block = ["participant_id", "_axis", "_level", "_node"]
        nodes = self._raised(leaves).groupBy(*block, *keys).agg(*merged)
        return self.blocks.join(nodes, block).groupBy(*WINDOW, *keys).agg(*merged)

    def rows(self, df: DataFrame, ts: str) -> DataFrame:
        """Every row once for each window that holds it, with the columns of the window."""
        block = ["participant_id", "_axis", "_level", "_node"]
        raised = self._raised(self._placed(df, ts)).drop("_us")
        found = raised.join(self.blocks, block).drop("_axis", "_level", "_node")
        return found.join(self.windows, WINDOW)
