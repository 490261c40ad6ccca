"""Ranked lexical search by dense blocked matrix multiplication.

A document's score for an item is the sum over the item's terms (repeats
included) of weight x impact, all integers:

    weight(term)      floor(1000 ln((2 N + 2) / (2 df + 1)))
    m(document)       100 - B + (B n N) div L
    impact(term, d)   (10^9 tf) div (1000 tf + K m)

N documents with a term, L terms in all, n terms of the document, df documents
with the term, tf its occurrences in the document.

1. Items are dealt into blocks of about ``BLOCK_ENTRIES`` (item, term) entries;
   a block's vocabulary is compact: term t is column t.  A block is what is
   broadcast, so its size does not grow with the documents, and more items mean
   more blocks.
2. One pass over the texts stores, for each document, n and the columns and
   counts of its terms that the block knows.  N, L and df are aggregates of it.
3. Tiles of ``TILE_DOCS`` documents become dense impact matrices over the
   columns that occur in them; item tile times impact tile is a BLAS product in
   float64.  Entries of an item tile are at most (2^53 - 1) / 10^6 / ``TILE_TERMS``
   (larger ones go into further products), so a product of ``TILE_TERMS``
   columns stays below 2^53 and is exact; products are added as int64.
4. Each tile keeps, for each item, all documents that reach its k-th score, so
   ties are not lost; a task keeps k of them by (score, id), and tasks meet in
   two steps, salted first.

Defined cases: null texts have no terms, such documents and items appear
nowhere and count nowhere.  Documents with an equal id are ranked each by
itself; equal scores go by ascending id, null ids last.  Items with an equal id
are one item that has all their terms.  Scores of zero are left out.  Very long
texts are cut into words one at a time.  Extra columns are not read.  Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from daygrain.llm.common import GAP_PATTERN, PLAIN_SPACES, ship, utf8
from daygrain.session import stored

K = 10
#: Entries of the score formula.
B, TF_SCALE, LENGTH_SCALE, IMPACT_SCALE = 75, 1000, 8, 1_000_000_000
#: No impact reaches this.
IMPACT_BOUND = IMPACT_SCALE // TF_SCALE
#: (item, term) entries of a block; documents, items and columns of a tile.
BLOCK_ENTRIES = 1 << 18
TILE_DOCS, TILE_ITEMS, TILE_TERMS = 512, 256, 2048
ENTRY_BOUND = ((1 << 53) - 1) // IMPACT_BOUND // TILE_TERMS
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times): the terms of every item."""
    words = F.split(F.translate(F.col(text_col), UPPER, LOWER), GAP_PATTERN)
    return (items.select(F.col(id_col).alias("item"), F.explode(words).alias("term")).where("term <> ''")
            .groupBy("item", "term").agg(F.count("*").alias("times")))


def postings(docs: DataFrame, columns: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, cols, tfs) of every document with a term: n counts all its terms, cols are the known ones in ascending order."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(columns)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            n, cols, tfs = [], [], []
            for text in utf8(batch.column(1)):
                words = text.translate(PLAIN_SPACES).split()
                n.append(len(words))
                known = np.array([c for w in words if (c := get(w)) is not None], np.int32)
                found, counts = np.unique(known, return_counts=True)
                cols.append(found)
                tfs.append(counts.astype(np.int32))
            some = pa.array(np.flatnonzero(n))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)], dtype=np.int32), np.concatenate(c)) for c in (cols, tfs)]
            yield pa.RecordBatch.from_arrays([x.take(some) for x in (batch.column(0), pa.array(n, pa.int64()), *lists)],
                                             names=["id", "n", "cols", "tfs"])

    return rows.mapInArrow(run, rows.select("id").schema.add("n", "long").add("cols", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType())))


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n_docs`` documents hold."""
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def products(entries: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Exact integer product of non-negative (items x columns) entries and (columns x documents) impacts below ``IMPACT_BOUND``."""
    total = np.zeros((entries.shape[0], impacts.shape[1]), np.int64)
    for at in range(0, entries.shape[1], TILE_TERMS):
        rest, tile = entries[:, at:at + TILE_TERMS], impacts[at:at + TILE_TERMS].astype(np.float64)
        while rest.any():
            part = np.minimum(rest, ENTRY_BOUND)
            total += (part.astype(np.float64) @ tile).astype(np.int64)
            rest = rest - part
    return total


def best_of(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of every item by (score descending, id ascending, null last)."""
    order = pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")],
                            null_placement="at_end")
    table = table.take(order)
    items = table.column("item").to_numpy()
    first = np.flatnonzero(np.r_[True, items[1:] != items[:-1]][:len(items)])
    place = np.arange(len(items)) - np.repeat(first, np.diff(np.r_[first, len(items)]))
    return table.filter(pa.array(place < k))


def tile_candidates(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the positive scores that are no less than the k-th of their row: ties are all kept."""
    least = np.ones(len(scores), np.int64)
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    return np.nonzero(scores >= least[:, None])


def block_candidates(posted: DataFrame, entries: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int],
                     n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, score, id): for every task and item of the block, k documents at most; ``entries`` are (row, column, weight x times)."""
    sent = posted.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, col, value = sent.value
        starts = np.searchsorted(row, np.arange(0, shape[0] + TILE_ITEMS, TILE_ITEMS))
        best = None
        for batch in (b.slice(at, 4 * TILE_DOCS) for b in batches for at in range(0, b.num_rows, 4 * TILE_DOCS)):
            found = []
            for at in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(at, TILE_DOCS)
                n = tile.column(1).to_numpy(zero_copy_only=False)
                sizes = pc.list_value_length(tile.column(2)).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(tile.num_rows), sizes)
                present, cols = np.unique(tile.column(2).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                if not len(present):
                    continue
                tf = tile.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 100 - B + (B * n * n_docs) // n_terms
                impacts = np.zeros((len(present), tile.num_rows), np.int64)
                impacts[cols, doc] = (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m[doc])
                place = np.full(shape[1], -1, np.int64)
                place[present] = np.arange(len(present))
                for first in range(len(starts) - 1):
                    some = slice(starts[first], starts[first + 1])
                    here = place[col[some]] >= 0
                    weights = np.zeros((min(TILE_ITEMS, shape[0] - first * TILE_ITEMS), len(present)), np.int64)
                    weights[row[some][here] - first * TILE_ITEMS, place[col[some][here]]] = value[some][here]
                    scores = products(weights, impacts)
                    i, d = tile_candidates(scores, k)
                    found.append((i + first * TILE_ITEMS, scores[i, d], d + at))
            if found:
                item, score, at = (np.concatenate(x) for x in zip(*found, strict=True))
                table = pa.table({"item": pa.array(item, pa.int32()), "score": pa.array(score), "id": batch.column(0).take(pa.array(at))})
                best = best_of(table if best is None else pa.concat_tables([best, table]), k)
        if best is not None:
            yield from best.to_batches()

    schema = "item int, score long, id " + posted.schema["id"].dataType.simpleString()
    return posted.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item, rank, id, score): the k best documents of every item, rank from 1."""
    spark = docs.sparkSession
    ship(spark)
    terms = stored(item_terms(items, item_col, item_text_col), "items")
    n_blocks = max(1, -(-terms.count() // block_entries))
    schema = StructType([StructField("item", terms.schema["item"].dataType), StructField("rank", IntegerType()),
                         StructField("id", docs.schema[id_col].dataType), StructField("score", LongType())])
    results = [spark.createDataFrame([], schema)]
    for block in range(n_blocks):
        # About ``block_entries`` rows, whatever the number of items.
        entries = terms.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        if not entries.num_rows:
            continue
        named = entries.column("item").chunk(0).dictionary_encode("encode")
        vocabulary = entries.column("term").chunk(0).dictionary_encode()
        row, col = (x.indices.to_numpy(zero_copy_only=False) for x in (named, vocabulary))
        columns = {t.encode(): c for c, t in enumerate(vocabulary.dictionary.to_pylist())}
        posted = stored(postings(docs, columns, id_col, text_col), "postings")
        n_docs, n_terms = posted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(columns), np.int64)
        for r in posted.select(F.explode("cols").alias("col")).groupBy("col").count().collect():  # a row per term of the block
            weights[r["col"]] = weight(n_docs, r["count"])
        order = np.argsort(row, kind="stable")
        values = weights[col] * entries.column("times").to_numpy()
        found = block_candidates(posted, (row[order], col[order], values[order]), (len(named.dictionary), len(columns)), n_docs, n_terms, k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(named.dictionary)), pa.int32()), "name": named.dictionary}))
        results.append(top(found, k).join(names, "item").select(F.col("name").alias("item"), "rank", "id", "score"))
    return reduce(DataFrame.unionAll, results)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every item, salted first, with their rank."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salted = Window.partitionBy("item", "salt").orderBy(*order)
    some = (found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(salted))
            .where(F.col("rank") <= k).drop("salt", "rank"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
