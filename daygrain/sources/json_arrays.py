"""Splittable scan of JSON files that hold one array.

Spark's own reader takes such a file whole, in one task.  Here the text reader
cuts it at every closing brace (its record separator), so a file is dealt to as
many tasks as its size asks for, from any store that Spark reads.  What is left
to find out is which braces end a record:

* A brace ends a record if it stands outside of strings and brings the nesting
  back to the depth of the array.
* Whether a block starts inside a string, and how deep, depends on all text
  before it.  So each block is summarised for both cases: how many quotes it
  holds, and how much deeper the text goes if it starts outside or inside of a
  string.  Composing the summaries of a file's blocks in order, one row each,
  gives every block its start.  Files of one block need none of this.
* Records that go over a cut come as fragments, at most two a block, and are
  joined by file.

A window on a time field is applied while records are cut, before they are
parsed: a record whose day is readable and outside of the window is not passed
on.  The exact comparison stays with the caller.

Files are UTF-8; a byte order mark is passed over.  A file that holds an object
or objects one after the other, and no array, is read too.  Text that is no
record gives a row of NULLs or none, and does not spoil the records around it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from daygrain.functions.dates import Bounds, day_of
from daygrain.session import ship

#: What may stand in front of a record of an array: separators, numbers, ``true``, ``false`` and ``null``.
BETWEEN = "[, \r\n\t\ufeff0123456789.eE+-truefalsn"
QUOTE, BACKSLASH, OPENING, CLOSING = 34, 92, (91, 123), 93
PARTS = "file long, block long, at long, kind string, record string"
#: Fragments of a record that goes over cuts: where it starts, a block inside of it, where it ends.
OPEN, MIDDLE, CLOSE = "open", "middle", "close"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, length, value): the text between closing braces, in file order within a task."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(file_key("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"), "value")


def file_key(path: str):
    """A number for a file; the two ways to ask for a path spell the scheme with one or three slashes."""
    return F.xxhash64(F.regexp_replace(path, r"^(\w+):/+", "$1:/"))


def least_split(spark: SparkSession) -> int:
    """Files of no more bytes than this are never cut."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    sizes = [spark.conf.get(f"spark.sql.files.{name}").lower() for name in ("maxPartitionBytes", "openCostInBytes")]
    return min(int(re.match(r"\d+", s)[0]) * units.get(s.rstrip("b")[-1:], 1) for s in sizes)


def parts_of_cut_files(parts: DataFrame) -> DataFrame:
    """The text of files that went to several blocks; small files are not even opened."""
    return parts.where((F.col("size") > least_split(parts.sparkSession)) & (F.col("length") < F.col("size")))


def structure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its quotes, and how much deeper it goes if it starts outside, or inside, of a string."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    quotes = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH)
    if len(slashes):  # a quote after an odd run of backslashes is part of a string
        starts = np.flatnonzero(np.r_[True, np.diff(slashes) != 1])
        odd = np.diff(np.r_[starts, len(slashes)]) % 2 == 1
        after = slashes[np.r_[starts[1:], len(slashes)] - 1] + 1
        quotes = quotes[~np.isin(quotes, after[odd])]
    step = (data == OPENING[0]).astype(np.int8) + (data == OPENING[1]) - (data == CLOSING)
    places = np.flatnonzero(step)
    text = np.searchsorted(offsets, places, "right") - 1
    before = np.searchsorted(quotes, offsets)
    inside = (np.searchsorted(quotes, places) - before[text]) % 2 == 1
    deeper = [np.bincount(text[which], step[places[which]], len(texts)).astype(np.int64) for which in (~inside, inside)]
    return np.diff(before), deeper[0], deeper[1]


def filled(column: pa.Array) -> pa.Array:
    """The texts as one plain string array."""
    return pc.fill_null(column.cast(pa.string()), "")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, bool]]:
    """(file, block, texts, first): runs of rows of one block; ``first`` where the block begins."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(file)].tolist(), strict=True):
            key = int(file[start]), int(block[start])
            yield *key, filled(batch.column(batch.num_columns - 1).slice(start, end - start)), key != last
            last = key


def array_depth(first_text: str) -> int:
    """The depth at which records stand in a file that starts with this text."""
    return int(first_text.lstrip("\ufeff \r\n\t").startswith("["))


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: (file, block, base, quotes, deeper from outside, deeper from inside)."""
    rows: list[list[int]] = []
    for file, block, texts, first in blocks_of(batches):
        if first:
            rows.append([file, block, array_depth(texts[0].as_py()) if block == 0 else 0, 0, 0, 0])
        quotes, outside, inside = structure(texts)
        for start in (0, 1):
            parity = start + rows[-1][3] + np.cumsum(np.r_[0, quotes])
            # The brace after a text counts where it stands outside of a string.
            steps = np.where(parity[:-1] % 2 == 0, outside, inside) - (parity[1:] % 2 == 0)
            rows[-1][4 + start] += int(steps.sum())
        rows[-1][3] += int(quotes.sum())
    names = ["file", "block", "base", "quotes", "outside", "inside"]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def block_starts(parts: DataFrame) -> DataFrame:
    """(file, block, base, quoted, depth): the state in which each block of a file that was cut begins."""
    cut = parts_of_cut_files(parts).select("file", "block", "value")
    sums = cut.mapInArrow(summarise, "file long, block long, base long, quotes long, outside long, inside long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int")
    placed = sums.withColumns({"quoted": quoted, "base": F.max("base").over(Window.partitionBy("file"))})
    step = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    depth = F.coalesce(F.sum("_step").over(before), F.lit(0))
    return placed.withColumn("_step", step).select("file", "block", "base", "quoted", depth.alias("depth"))


@lru_cache(maxsize=100_000)
def _outside(text: str, lower, upper) -> bool:
    found = day_of(text)
    return found is not None and not lower <= found <= upper


def outside_window(records: pa.Array, field: str, bounds: Bounds) -> np.ndarray:
    """Records that hold ``field`` once, with a readable day outside of the window."""
    pattern = rf'"{field}"\s*:\s*"(?P<day>[0-9:/.\-]+)'
    days = pc.struct_field(pc.extract_regex(records, pattern), "day")
    once = pc.equal(pc.count_substring(records, f'"{field}"'), 1)
    coded = pc.if_else(once, days, None).dictionary_encode()
    verdicts = np.array([_outside(d, bounds.lower.date(), bounds.upper.date()) for d in coded.dictionary.to_pylist()] + [False])
    return verdicts[pc.fill_null(coded.indices, len(verdicts) - 1).to_numpy(zero_copy_only=False)]


def record_cutter(starts: Mapping[tuple[int, int], tuple[int, int, int]], field: str | None = None,
                  bounds: Bounds | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches of pieces that gives records and fragments.

    ``starts`` has (base, quoted, depth) of the blocks of files that were cut.
    Records are numbered in the block that they end in.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, number, whole, base, quoted, depth = (0, 0), [], 0, True, 0, 0, 0

        def rest() -> Iterator[pa.RecordBatch]:
            """What stands behind the last record of a block, where the file goes on."""
            text = "}".join(held)
            if held and here in starts and ("{" in text or not whole):
                yield batch_of(here, [-1], [OPEN if whole else MIDDLE], pa.array([text], pa.string()))

        for file, block, texts, first in blocks_of(batches):
            if first:
                yield from rest()
                here, held, number = (file, block), [], 0
                base, quoted, depth = starts.get(here) or (array_depth(texts[0].as_py()), 0, 0)
                # A block that starts before or between records has no end of an earlier one.
                whole = not quoted and depth <= base
            quotes, outside, inside = structure(texts)
            parity = (quoted + np.cumsum(np.r_[0, quotes])) % 2
            after = depth + np.cumsum(np.where(parity[:-1] == 0, outside, inside) - (parity[1:] == 0))
            quoted, depth = int(parity[-1]), int(after[-1])
            ends = np.flatnonzero((parity[1:] == 0) & (after == base)) + 1
            if not len(ends):
                held += texts.to_pylist()
                continue
            if held:
                texts = pa.concat_arrays([pa.array(["}".join([*held, texts[0].as_py()])], pa.string()), texts.slice(1)])
            held = texts.slice(int(ends[-1])).to_pylist()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), texts.slice(0, int(ends[-1])))
            found = pc.binary_join_element_wise(pc.binary_join(lists, "}"), "", "}")
            kinds = [None] * len(found)
            if not whole:
                # The text of a fragment keeps what stands in front of it.
                kinds[0] = CLOSE
                trimmed = pc.utf8_ltrim(found.slice(1), characters=BETWEEN)
                found = pa.concat_arrays([found.slice(0, 1), trimmed])
                whole = True
            else:
                found = pc.utf8_ltrim(found, characters=BETWEEN)
            at = np.arange(number, number + len(found))
            number += len(found)
            if field is not None and bounds is not None:
                kept = np.flatnonzero(~outside_window(found, field, bounds) | np.array([k is not None for k in kinds]))
                at, kinds, found = at[kept], [kinds[i] for i in kept.tolist()], found.take(pa.array(kept))
            yield batch_of(here, at, kinds, found)
        yield from rest()

    return cut


def batch_of(key: tuple[int, int], at, kinds: list[str | None], records: pa.Array) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(at, pa.int64()),
               pa.array(kinds, pa.string()), records]
    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "kind", "record"])


def joined(fragments: DataFrame) -> DataFrame:
    """Records out of the fragments of a file: what opens, what lies between and what closes."""
    opened = F.when(F.col("kind") == OPEN, 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("block", opened)
    turned = fragments.withColumn("_record", F.sum(opened).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", opened.alias("o"), "record")))
    return turned.groupBy("file", "_record").agg(
        F.max("block").alias("block"), F.max(F.when(F.col("kind") == CLOSE, F.col("at"))).alias("at"),
        F.ltrim(F.array_join(F.transform(parts, lambda p: p["record"]), "}"), F.lit(BETWEEN)).alias("record")).where(
        F.col("at").isNotNull()).select("file", "block", "at", F.lit(None).cast("string").alias("kind"), "record")


def read_array(spark: SparkSession, path: str, schema: T.StructType, field: str | None = None,
               bounds: Bounds | None = None) -> DataFrame:
    """The records of all arrays under ``path``: the fields of ``schema``, and (file, block, at) to order them by.

    With ``bounds``, records whose day in the top-level text ``field`` is
    outside of the window may be left out.
    """
    ship(spark)
    parts = pieces(spark, path)
    # A row per block of a file larger than a split: bounded by the size of the data over that of a split.
    starts = {(r["file"], r["block"]): (r["base"], r["quoted"], r["depth"]) for r in block_starts(parts).collect()}
    sent = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_cutter(sent.value, field, bounds)(batches)

    if field is not None and bounds is not None:  # the plan shows the function's name
        cut.__name__ = f"records_with_{field}_from_{bounds.lower:%Y_%m_%d}_to_{bounds.upper:%Y_%m_%d}"
    records = parts.select("file", "block", "value").mapInArrow(cut, PARTS).where(F.col("kind").isNull())
    if starts:
        fragments = parts_of_cut_files(parts).select("file", "block", "value").mapInArrow(cut, PARTS)
        records = records.unionByName(joined(fragments.where(F.col("kind").isNotNull())))
    return records.select("file", "block", "at", F.from_json("record", schema).alias("_r")).select("file", "block", "at", "_r.*")
