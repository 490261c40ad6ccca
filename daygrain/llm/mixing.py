"""Temperature mixing of sources, in DataFrame functions only.

A source with token share p gets the weight p^e / sum p^e.  The exponent e in
[0, 1] is found by bisection: the largest one whose mix reaches ``min_entropy``
(a share of the entropy of equal weights), raised until no document is repeated
more than ``max_repetition`` times.  e = 1 is the natural mix.

The weights are realised under a token budget (by default the smallest one that
keeps every source whole).  A source's quota is some whole epochs and a rest.
Its documents stand in the order of a hash, cut into at most ``BLOCKS`` blocks;
the rest is filled block by block, and inside the one block where the quota
ends document by document, so no source is over its quota.  Each epoch permutes
the blocks anew: ``mix_key`` orders all copies into one stream.

At volume: texts are read once to count words.  Totals fold map-side; bisection
steps are evaluated fifteen exponents at a time on the per-source totals.  No
window holds a source: one orders its at most ``BLOCKS`` block totals, one the
documents of a single block.  A document needs only its source's quota row, which
is small and joined by the optimizer's choice.

Defined cases: a null text has no words; rows without words follow their place
in the order and cost nothing; a null source is a source; a source without words
has weight 0 and its rows are kept once; repeated rows are repeated documents,
and rows with equal ids (null too) stand at the same place and are taken together
or not at all; clashing names ``epoch`` and ``mix_key`` are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.llm.common import SPACED_PATTERN
from daygrain.session import stored

BLOCKS = 4096
STEPS = 4  # bisection steps a job
ROUNDS = 9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_PATTERN)), F.lit(0)).cast("long")


def place(seed: int, *cols: Column) -> Column:
    """A hash spread evenly over [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def bisect(totals: DataFrame, holds: Callable[[dict], bool]) -> float:
    """The largest exponent in [0, 1] for which ``holds`` is true of the mix; 0 if for none.

    ``totals``: share.  ``holds`` gets the entropy and the highest repetition of a
    whole-source budget at an exponent; it must be true below and false above some exponent.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        exponents = [low + (high - low) * k / (1 << STEPS) for k in range(1, 1 << STEPS)]
        if high == 1.0:
            exponents.append(1.0)
        tried = totals.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("e")).withColumn(
            "raised", F.pow("share", "e"))
        mixes = {r["e"]: r.asDict() for r in tried.groupBy("e").agg(
            F.sum("raised").alias("z"), F.sum(F.col("raised") * F.col("e") * F.log("share")).alias("s"),
            F.max("share").alias("most"), F.min("share").alias("least"),
            (F.log(F.sum("raised")) - F.sum(F.col("raised") * F.col("e") * F.log("share")) / F.sum("raised")).alias("entropy"),
            F.pow(F.max("share") / F.min("share"), 1 - F.col("e")).alias("spread")).collect()}
        good = [e for e in exponents if holds(mixes[e])]
        if good and good[-1] == 1.0:
            return 1.0
        low = good[-1] if good else low
        high = min([e for e in exponents if e > low], default=high)
    return low


def quotas(counted: DataFrame, min_entropy: float | None = None, max_repetition: float | None = None,
           budget: float | None = None) -> DataFrame:
    """One row per source: tokens, share, weight, whole epochs, and the place up to which one more copy is taken.

    ``counted``: source, place (in [0, 1)), tokens.
    """
    by_source = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    total = by_source.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("k")).first()
    everything, k = float(total["t"] or 0), total["k"]
    shares = stored(by_source.withColumn("share", F.col("tokens") / F.lit(everything or 1.0)), "shares")
    live = shares.where("tokens > 0")
    exponent = 1.0
    if everything and min_entropy is not None and k > 1:
        goal = min_entropy * log(k)
        exponent = bisect(live, lambda mix: mix["entropy"] >= goal)
    if everything and max_repetition is not None:
        ratio = None if budget is None else budget / everything
        # Too much repetition below some exponent, little enough above it.
        too_much = bisect(live, lambda mix: (mix["spread"] if ratio is None else
                                             ratio * mix["least"] ** (mix["e"] - 1) / mix["z"]) > max_repetition * (1 + 1e-9))
        exponent = max(exponent, too_much + 2.0 ** -(STEPS * ROUNDS) if too_much > 0 else 0.0)
        exponent = min(exponent, 1.0)
    raised = live.withColumn("raised", F.pow("share", F.lit(exponent)))
    norm = raised.agg(F.sum("raised").alias("z"), F.max(F.col("tokens") / F.col("raised")).alias("x")).first()
    z = norm["z"] or 1.0
    tokens = budget if budget is not None else (norm["x"] or 0.0) * z
    weighed = shares.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / z).otherwise(0.0))
    epochs = F.col("weight") * tokens / F.col("tokens")
    ruled = weighed.select(
        "source", F.col("tokens").alias("source_tokens"), "n_docs", "weight", F.lit(exponent).alias("exponent"),
        F.when(F.col("tokens") > 0, F.floor(epochs + 1e-9)).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.col("tokens") * (epochs - F.floor(epochs + 1e-9))))
        .otherwise(0.0).alias("rest"))
    # Blocks in hash order: which is the one where the quota ends, and what is left for it.
    block = F.floor(F.col("place") * F.least(F.lit(BLOCKS), F.col("n_docs"))).alias("block")
    placed = counted.join(ruled, counted["source"].eqNullSafe(ruled["source"])).select(
        counted["source"], "place", "tokens", "rest", block)
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = (placed.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
            .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
            .select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("left")))
    inside = placed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    along = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    cuts = (inside.withColumn("along", F.sum("tokens").over(along)).where(F.col("along") > F.col("left"))
            .groupBy("source").agg(F.min("place").alias("cut")))
    return ruled.join(cuts, ruled["source"].eqNullSafe(cuts["source"]), "left").select(
        ruled["source"], "source_tokens", "n_docs", "weight", "exponent", "whole", F.coalesce("cut", F.lit(1.0)).alias("cut"),
        "rest")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: int = 1, **limits: float) -> tuple[DataFrame, DataFrame]:
    """(counted, quotas): id, source, place and tokens of every row; the row of every source."""
    counted = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("tokens"),
        place(seed, F.col(source_col), F.col(id_col)).alias("place")), "counted")
    return counted, stored(quotas(counted, **limits), "quotas")


def copies(place: Column) -> Column:
    """How often a document at ``place`` is taken: the whole epochs, and once more before the cut of its source."""
    return F.col("whole") + F.when((place < F.col("cut")) & (F.col("rest") > 0), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1,
        **limits: float) -> DataFrame:
    """``docs`` with one row per copy, and ``epoch`` and ``mix_key``; order by ``mix_key`` for the stream."""
    _, ruled = planned(docs, id_col, text_col, source_col, seed, **limits)
    return realised(docs, ruled, id_col, source_col, seed, weighted=False)


def realised(docs: DataFrame, ruled: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 1,
             weighted: bool = True) -> DataFrame:
    """The copies of ``mix`` for quotas that are known; if ``weighted``, with the ``_weight`` of their sources."""
    names = [c for c in docs.columns if c not in ("epoch", "mix_key")]
    rule = ruled.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"), "whole", "cut", "rest", "n_docs")
    held = docs.select(F.struct(*names).alias("_doc"), F.col(source_col).alias("_s"), F.col(id_col).alias("_id"),
                       place(seed, F.col(source_col), F.col(id_col)).alias("_place"))
    taken = (held.join(rule, F.col("_s").eqNullSafe(F.col("_source")))
             .withColumn("_copies", copies(F.col("_place"))).where("_copies > 0")
             .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
    block = F.floor(F.col("_place") * F.least(F.lit(BLOCKS), F.col("n_docs")))
    low = (1 << 20) - 1
    key = (F.xxhash64(F.lit(seed), "epoch", "_s", block).bitwiseAND(F.lit(~low))
           .bitwiseOR(F.xxhash64(F.lit(seed), "epoch", "_id").bitwiseAND(F.lit(low))))
    shown = [F.col("_weight")] if weighted else []
    return taken.select("_doc.*", F.col("epoch").cast("int").alias("epoch"), key.alias("mix_key"), *shown)
