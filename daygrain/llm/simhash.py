"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints: XXH64 (seed 42) of every three-word shingle of the whole text; a
bit is set if it is set in more than half of the hashes.  Fingerprints link at
``radius`` or fewer differing bits, and linked documents form components.

Search over the distinct fingerprints:

1. Bits that correlate are grouped into the same one of m partitions, from the
   64 x 64 bit counts over all fingerprints.
2. The size of every (partition, value) bucket is counted.  For each
   fingerprint a dynamic program allocates thresholds t_i >= -1 with
   sum t_i = radius - m + 1 that minimise probes plus estimated candidates.  If
   all partitions of a pair differed by more than t_i, the pair would differ in
   at least radius + 1 bits; so every link is found.  Full buckets are avoided
   by a threshold of -1 (no probe) there and a wider probe elsewhere.
3. Each fingerprint probes the buckets within t_i bits of its own value;
   candidates are verified on all 64 bits.

At volume: no row is a candidate pair.  Buckets are cut into chunks of at most
about ``CHUNK`` fingerprints (salted by a hash), the join meets chunk with
chunk, and a task compares two chunks in numpy and emits a spanning forest of
their links, which keeps components whole.  The number of partitions follows the
number of fingerprints: more than some ten million are cheaper with two wide
partitions than with three.

Defined cases: null counts as empty; a text without words has fingerprint zero
and links like any other; a text of fewer than three words is one shingle.
Repeated rows get the same result.  ``component_id`` is the smallest non-null id
of the component.  ``near_dedup`` keeps rows without an id, and rows that repeat
an id stay or go together.  Extra columns and clashing names are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import packed, ship, utf8
from daygrain.operators.runs import components
from daygrain.session import stored

SEED = 42
SHINGLE = 3
RADIUS = 2
CHUNK = 1024
#: Shingles hashed at a time.
STEP = 1 << 18
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_LANES = 256 * np.arange(8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        some = slice(at, min(at + STEP, n))
        slices = map(slice, starts[some].tolist(), last[some].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), "<u8",
                             some.stop - at)
        lanes = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
        counts += (lanes @ _BITS).ravel()
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per row of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return rows.mapInArrow(run, rows.select("id").schema.add("fp", "long"))


def partition_count(n: int, radius: int = RADIUS) -> int:
    """The number of partitions with the fewest probes and candidates for n random fingerprints."""
    def cost(m: int) -> float:
        width = 64 // m
        spare = radius - m + 1  # the sum of the thresholds; spread as evenly as possible
        per = [spare // m + (i < spare % m) for i in range(m)]
        probes = sum(comb(width, k) for t in per for k in range(t + 1))
        return probes * (1 + n / 2 ** width)
    return min(range(max(1, radius), radius + 2), key=cost)


def bit_groups(fps: DataFrame, m: int) -> list[list[int]]:
    """Bits in m groups of almost equal size, correlated bits together."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            ones = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
            total += ones.T @ ones
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(65 * 65)
    for row in rows:  # 65 x 65 counts, whatever the table holds
        total[row["at"]] = row["n"]
    total = total.reshape(65, 65)
    n = max(total[64, 64], 1)
    mean = total[64, :64] / n
    covariance = total[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    tie = np.abs(covariance / np.outer(sd, sd)).round(6)
    np.fill_diagonal(tie, 0)
    free, groups = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (tie[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(counts: np.ndarray, widths: list[int], n: int, radius: int = RADIUS) -> np.ndarray:
    """Thresholds per fingerprint and partition by dynamic programming.

    ``counts[r, i]`` is the size of the bucket of fingerprint r in partition i.
    A radius t around it is estimated to hold that many, plus the mean bucket
    for every further value.  State: the sum of the thresholds so far.
    """
    rows, m = counts.shape
    goal = radius - m + 1
    sums = range(-m, radius + m + 1)
    at = {s: k for k, s in enumerate(sums)}
    best = np.full((len(at), rows), np.inf)
    best[at[0]] = 0
    taken = np.full((m, len(at), rows), -1, np.int8)
    for i, width in enumerate(widths):
        after = np.full_like(best, np.inf)
        for t in range(-1, radius + 1):
            probes = sum(comb(width, k) for k in range(t + 1))
            cost = probes + (counts[:, i] + (probes - 1) * n / 2 ** width) if t >= 0 else 0.0
            for s in sums:
                if s + t in at:
                    total = best[at[s]] + cost
                    better = total < after[at[s + t]]
                    after[at[s + t]][better] = total[better]
                    taken[i, at[s + t]][better] = t
        best = after
    out = np.empty((rows, m), np.int8)
    state = np.full(rows, goal)
    for i in range(m - 1, -1, -1):
        out[:, i] = taken[i, state - sums[0], np.arange(rows)]
        state = state - out[:, i]
    return out


def _value(group: list[int]) -> Column:
    """The bits of a group as one number."""
    out = F.lit(0).cast("long")
    for place, bit in enumerate(group):
        out = out.bitwiseOR(F.shiftleft(F.shiftright("fp", bit).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def _salt(fp: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(fp), F.ceil(size / CHUNK)).cast("int")


def forest(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two chunks of fingerprints (unsigned)."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    far = np.uint64(0xFFFFFFFFFFFFFFFF)
    of_left, of_right = left.copy(), right.copy()
    while True:
        was_left, was_right = of_left, of_right
        of_left = np.minimum(of_left, np.where(near, of_right[None, :], far).min(1))
        of_right = np.minimum(of_right, np.where(near, of_left[:, None], far).min(0))
        if (of_left == was_left).all() and (of_right == was_right).all():
            break
    a, b = np.concatenate([left, right]), np.concatenate([of_left, of_right])
    return a[a != b], b[a != b]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column ``fp``), enough to connect all that link."""
    ship(fps.sparkSession)
    n = fps.count()
    m = partition_count(n, radius)
    groups = bit_groups(fps, m)
    widths = [len(g) for g in groups]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), _value(g).alias("value")) for i, g in enumerate(groups)])
    cells = fps.select("fp", F.inline(parts))
    sizes = cells.groupBy("part", "value").agg(F.count("*").alias("size"))
    sized = stored(cells.join(sizes, ["part", "value"]), "cells")
    wide = sized.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("part", "value", "size"))).alias("cells")).select(
        "fp", F.transform("cells", lambda c: c["value"]).alias("values"),
        F.transform("cells", lambda c: c["size"]).alias("sizes"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, m)
            counts = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, m)
            limits = allocate(counts, widths, n, radius)
            for i, width in enumerate(widths):
                for flips in range(radius + 1):
                    rows = (limits[:, i] >= flips) & ((counts[:, i] > 1) | (flips > 0))
                    for places in combinations(range(width), flips) if rows.any() else ():
                        mask = sum(1 << p for p in places)
                        k = int(rows.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, i, np.int32)), pa.array(values[rows, i] ^ mask),
                             pa.array(np.full(k, mask, np.int64)), pa.array(counts[rows, i]), pa.array(fp[rows])],
                            names=["part", "value", "mask", "size", "fp"])

    probes = (wide.mapInArrow(probe, "part int, value long, mask long, size long, fp long")
              .groupBy("part", "value", "mask", _salt(F.col("fp"), F.col("size")).alias("salt"))
              .agg(F.collect_list("fp").alias("asking")))
    index = (sized.groupBy("part", "value", _salt(F.col("fp"), F.col("size")).alias("slot"))
             .agg(F.collect_list("fp").alias("held")))
    met = probes.join(index, ["part", "value"]).select("asking", "held")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for asking, held in zip(batch.column(0), batch.column(1), strict=True):
                a, b = forest(asking.values.to_numpy().view(np.uint64), held.values.to_numpy().view(np.uint64), radius)
                src.append(a)
                dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src).view(np.int64)),
                                              pa.array(np.concatenate(dst).view(np.int64))], names=["src", "dst"])

    return met.mapInArrow(verify, "src long, dst long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    found = components(links(fps, radius), fps.select(F.col("fp").alias("node")))
    named = fps.join(found, F.col("fp") == F.col("node"))
    roots = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(roots, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    found = near_copies(docs, id_col, text_col, radius)
    gone = (found.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_gone"))
            .agg(F.max(F.col("id") == F.col("component_id")).alias("_stays")).where(~F.col("_stays")))
    return packed(docs, _id=F.col(id_col)).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
