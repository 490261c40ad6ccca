"""Runs of periodically repeated words, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least max(``LEAST``, ``TIMES`` q) words that no
neighbouring word extends with period q.

1. A word of a run occurs at least ``TIMES`` times in it.  So within a segment a
   word with fewer occurrences belongs to no run and splits the segment; the
   parts are counted anew, until nothing splits.  Parts shorter than ``LEAST``
   words go.  All texts of a batch are split together in numpy.
2. A surviving segment is scanned lag by lag.  Within a run of period q the
   words q apart are equal at 3 q places in a row, three of which are multiples
   of q; so a lag looks at every q-th word only, n / q of them, and compares
   word by word only around three equal ones.  A segment of n words costs
   n log n instead of n^2.
3. A lag that is a multiple of the period of a run found before finds the same
   stretch again: places well inside that run are passed over, and a stretch
   known with a smaller period is not a run of the lag.

Work is one pass of Arrow batches without a shuffle; a text is one row.

Defined cases: null and empty texts have no words and no runs, their collapsed
text is empty.  Very long texts cost n log n.  Overlapping runs are all
returned.  Repeated rows, null ids and extra columns need no care: rows are
independent and only the id and the text are read.  Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from daygrain.llm.common import ship, utf8

#: Least words of a run, and least repetitions of its period.
LEAST, TIMES = 6, 4
#: Bytes of text whose words are numbered together.
GROUP = 1 << 22


def segments(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches that may hold runs; ``owner`` numbers the texts, words of which stand together."""
    place, segment = np.arange(len(codes)), owner.astype(np.int64)
    width = int(codes.max(initial=0)) + 1
    while len(place):
        _, which, counts = np.unique(segment * width + codes[place], return_inverse=True, return_counts=True)
        kept = counts[which] >= TIMES
        at, seg = place[kept], segment[kept]
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1])][:len(at)]
        part = np.cumsum(new) - 1
        long = (np.bincount(part) >= LEAST)[part] if len(part) else np.zeros(0, bool)
        settled = kept.all() and long.all() and len(np.unique(segment)) == (part[-1] + 1 if len(part) else 0)
        place, segment = at[long], part[long]
        if settled:
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            return list(zip(place[starts].tolist(), (place[np.r_[starts[1:] - 1, len(place) - 1]] + 1).tolist(), strict=True))
    return []


def stretch(words: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The maximal [start, end) around ``at`` in which a word equals the one ``lag`` further; ``at`` is such a place."""
    low, high, last = at, at + 1, len(words) - lag
    step = 64
    while low > 0:
        first = max(0, low - step)
        unequal = np.flatnonzero(words[first:low] != words[first + lag:low + lag])
        if len(unequal):
            low = first + int(unequal[-1]) + 1
            break
        low, step = first, 2 * step
    step = 64
    while high < last:
        end = min(last, high + step)
        unequal = np.flatnonzero(words[high:end] != words[high + lag:end + lag])
        if len(unequal):
            high += int(unequal[0])
            break
        high, step = end, 2 * step
    return low, high


def scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    for lag in range(1, len(words) // TIMES + 1):
        every = words[::lag]
        equal = every[1:] == every[:-1]
        three = equal[2:] & equal[1:-1] & equal[:-2]
        if not three.any():
            continue
        places = np.flatnonzero(three) * lag
        for first, size, period in runs:
            if lag % period == 0:
                places = places[(places < first) | (places + 3 * lag >= first + size)]
        while len(places):
            low, high = stretch(words, lag, int(places[0]))
            length = high - low + lag
            if length >= max(LEAST, TIMES * lag) and (low, length) not in seen:
                seen.add((low, length))
                runs.append((low, length, lag))
            places = places[places >= high]
    return runs


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start and period."""
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in segments(codes, owner):
        text = int(owner[start])
        found[text] += [(start - int(bounds[text]) + s, n, q) for s, n, q in scan(codes[start:end])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


RUN = StructType().add("start", "long").add("length", "long").add("period", "long")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed): all runs of every text and the text with each run reduced to its first period."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield group
                group, size = [], 0
        yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            runs, texts = [], []
            for group in groups(utf8(batch.column(1))):
                words = [t.split() for t in group]
                found = find_runs(words)
                runs += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
                texts += [collapsed(w, rs) for w, rs in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=["id", "runs", "collapsed"])

    return rows.mapInArrow(run, rows.select("id").schema.add("runs", ArrayType(RUN)).add("collapsed", "string"))
