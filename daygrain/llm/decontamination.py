"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of ``size`` consecutive words (an item of fewer
words is one window).  The training texts become an index that is stored in the
shared folder and sharded by document: for each document the postings (term,
position) of every term that the test items use, in position order.  The index
tells how often each term occurs in the training data; every window is then
looked up from its two rarest terms.  The postings of the rarest term, adjusted
by its offset in the window, are intersected with the adjusted postings of the
second rarest and, for what is left, of all other terms, rarest first.  What
remains is an exact phrase match.  With ``slop`` > 0 every place of a window's
rarest term around which each other term of the window stands within ``slop``
words of its expected position counts as a proximity match; exact matches are
among them, and the same posting lists are intersected, each widened by ``slop``.

Terms are told apart by a 64-bit hash of all their bytes.

At volume: the training texts are read once and never shuffled; building and
searching keep a batch of documents in memory.  The test items are the query
set: they go to the tasks in blocks of at most ``BLOCK_WORDS`` words, each block
searched against the whole index, so what is broadcast is bounded whatever the
number of items.  A document of any length is one batch of postings.

Defined cases: null and empty texts have no words; an item without words has no
window; repeated items and repeated windows count once per item id; items with
a null id are ignored; repeated documents get the same result; ``decontaminate``
keeps extra columns and clashing names; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from daygrain.llm.common import hashed_words, packed, plain_words, ship, utf8
from daygrain.session import stored

WINDOW = 10
#: Words of test items that go to the tasks at once.
BLOCK_WORDS = 2_000_000


@dataclass
class Windows:
    """A block of test items as term ids: ``terms[w, :length[w]]`` are the terms of window w."""

    vocabulary: list[bytes]
    terms: np.ndarray
    length: np.ndarray
    item: np.ndarray
    item_ids: list[int]


def windows_of(items: Sequence[Row], size: int = WINDOW) -> Windows:
    """Windows of (id, text) rows; equal windows of one item fold."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple, None] = {}
    item_ids: dict[int, int] = {}
    for item_id, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in plain_words((text or "").encode())]
        number = item_ids.setdefault(item_id, len(item_ids))
        for at in range(max(1, len(ids) - size + 1) if ids else 0):
            found[number, *ids[at:at + size]] = None
    terms = np.full((len(found), size), -1, np.int32)
    for row, window in zip(terms, found, strict=True):
        row[:len(window) - 1] = window[1:]
    return Windows(list(vocabulary), terms, (terms >= 0).sum(1), np.array([w[0] for w in found], np.int32),
                   list(item_ids))


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> Iterator[Windows]:
    """The test items as blocks of bounded size, in id order."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held, words = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        n = len(plain_words((row["text"] or "").encode()))
        if words + n > BLOCK_WORDS and held:
            yield windows_of(held, size)
            held, words = [], 0
        held.append(row)
        words += n
    yield windows_of(held, size)


def build_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, terms, places): the postings of the vocabulary in each document, stored."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        of_term = np.concatenate([w.hashes for w in hashed_words(words)]) if words else np.zeros(0, np.uint64)
        order = np.argsort(of_term)
        ranked = of_term[order]
        for batch in batches:
            texts = utf8(batch.column(1))
            n_words = np.zeros(len(texts), np.int64)
            terms = [np.zeros(0, np.int32)] * len(texts)
            places = list(terms)
            for found in hashed_words(texts):
                n_words += np.bincount(found.text, minlength=len(texts))
                if not len(ranked):
                    continue
                near = np.minimum(np.searchsorted(ranked, found.hashes), len(ranked) - 1)
                hit = np.flatnonzero(ranked[near] == found.hashes)
                whose, first = np.unique(found.text[hit], return_index=True)
                for i, some in zip(whose, np.split(hit, first[1:]), strict=False):
                    terms[i] = np.concatenate([terms[i], order[near[some]].astype(np.int32)])
                    places[i] = np.concatenate([places[i], found.place[some].astype(np.int32)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(places, pa.list_(pa.int32()))], names=["id", "n_words", "terms", "places"])

    schema = rows.select("id").schema.add("n_words", "long").add("terms", ArrayType(IntegerType())).add("places", ArrayType(IntegerType()))
    return stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "postings")


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """How often each of the ``size`` terms of the vocabulary occurs in the training data."""
    out = np.zeros(size, np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        out[row["term"]] = row["count"]  # one row per term of the test items
    return out


def search(index: DataFrame, windows: Windows, counts: np.ndarray, slop: int = 0) -> DataFrame:
    """(row, id, n_words, places, items, n_near): hit word positions and matched items of each document."""
    ship(index.sparkSession)
    size = windows.terms.shape[1]
    rarity = np.where(windows.terms >= 0, counts[windows.terms] if len(counts) else 0, np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable").astype(np.int32)
    pivot = np.take_along_axis(windows.terms, order[:, :1], 1)[:, 0]
    by_pivot = np.argsort(pivot, kind="stable").astype(np.int32)
    held = np.bincount(pivot, minlength=len(counts)) if len(pivot) else np.zeros(len(counts), np.int64)
    first = np.cumsum(held) - held
    sent = index.sparkSession.sparkContext.broadcast(
        (windows.terms, windows.length, windows.item, [str(i) for i in windows.item_ids], order, by_pivot, held, first))
    pad = size + slop

    def candidates(ids: np.ndarray, at: np.ndarray, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) for every posting of a rarest term, about a million at a time."""
        _, _, _, _, order, by_pivot, held, first = sent.value
        done = np.cumsum(held[terms])
        for cut in np.split(np.arange(len(terms)), np.searchsorted(done, np.arange(1 << 20, done[-1], 1 << 20))
                            if len(done) else []):
            n = held[terms[cut]]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = by_pivot[np.repeat(first[terms[cut]], n) + rank]
            yield window, np.repeat(at[cut], n) - order[window, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window_terms, length, item, names, order, _, held, _ = sent.value
        for batch in batches:
            n_words = batch.column(2).to_numpy()
            base = np.cumsum(n_words + pad) - n_words  # each document stands behind ``pad`` empty places
            ids = np.full(int((n_words + pad).sum()) + pad, -1, np.int32)
            terms, places = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            doc = np.repeat(np.arange(len(n_words)), batch.column(3).value_lengths().to_numpy())
            at = base[doc] + places
            ids[at] = terms
            rare = held[terms] > 0 if len(terms) else np.zeros(0, bool)
            hit = np.zeros(len(ids), bool)
            pairs = [np.zeros(0, np.int64)]
            near = np.zeros(len(n_words), np.int64)
            for window, start in candidates(ids, at[rare], terms[rare]):
                if slop:
                    wide, begin = window, start
                    for k in range(1, size):
                        offset = order[wide, k]
                        wanted = window_terms[wide, offset]
                        close = (length[wide] <= k) | np.any([ids[begin + offset + d] == wanted for d in range(-slop, slop + 1)], axis=0)
                        wide, begin = wide[close], begin[close]
                    owner = np.searchsorted(base, begin + order[wide, 0], "right") - 1
                    near += np.bincount(owner, minlength=len(near))
                for k in range(1, size):
                    offset = order[window, k]
                    fits = (length[window] <= k) | (ids[start + offset] == window_terms[window, offset])
                    window, start = window[fits], start[fits]
                for k in range(size):
                    hit[start[length[window] > k] + k] = True
                owner = np.searchsorted(base, start, "right") - 1
                pairs.append(np.unique(owner * len(names) + item[window]))
            found = np.flatnonzero(hit)
            whose = np.searchsorted(base, found, "right") - 1
            cuts = np.searchsorted(whose, np.arange(1, len(n_words)))
            spots = np.split((found - base[whose]).astype(np.int32), cuts)
            matched = np.unique(np.concatenate(pairs))
            cuts = np.searchsorted(matched, np.arange(1, len(n_words)) * max(len(names), 1))
            items = [[names[i % len(names)] for i in some] for some in np.split(matched, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(spots, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string())), pa.array(near)],
                names=["row", "id", "n_words", "places", "items", "n_near"])

    rows = index.select("row", "id", "n_words", "terms", "places")
    schema = index.select("row", "id", "n_words").schema.add("places", ArrayType(IntegerType())).add("items", ArrayType(StringType())).add(
        "n_near", "long")
    return rows.mapInArrow(run, schema)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (ids as sorted strings), n_near.

    ``n_near`` counts (window, place of its rarest term) within ``slop``; terms
    that occur equally often are taken in the order of the window.
    """
    found = []
    for windows in blocks(items, item_col, item_text_col, size):
        index = build_index(docs, windows.vocabulary, id_col, text_col)
        found.append(search(index, windows, term_counts(index, len(windows.vocabulary)), slop))
    if len(found) == 1:
        return found[0].select("id", "n_words", F.size("places").cast("long").alias("n_hit"),
                               F.array_sort("items").alias("items"), "n_near")
    whole = reduce(DataFrame.unionAll, found).groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    return whole.select("id", "n_words", F.size("places").cast("long").alias("n_hit"), "items", "n_near")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of a test item.

    A row is known by its id and a print of its text, so rows that share an id
    or have none are judged each by its own text.
    """
    key = F.struct(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("print"))
    found = matches(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), items, "_key", "_text", size=size)
    gone = found.where("n_hit > 0").select(F.col("id").alias("_gone")).distinct()
    return packed(docs, _key=key).join(gone, F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")
