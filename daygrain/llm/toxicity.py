"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed ids of its words, the first letters
of its words, its adjacent word pairs and its pairs with one word skipped.
FTRL-proximal keeps one learning rate per coordinate and shrinks the weights
with L1, so that the fitted model is a short list of (id, weight) which is
broadcast for scoring.  Scoring reads whole texts and has no other input.

Fitting works on a bounded sample of the labelled rows (``max_rows``): its
features are extracted in parallel and the pass over them, which is sequential
by nature, runs in one task.  Scoring is one scan without a shuffle.

Defined cases: a null text counts as empty and scores the bias alone; a row
without a label is not learned from; a document labelled twice is toxic if one
of its labels says so; without any labelled row, or with one class only, the
model is the smoothed share of the toxic class.  Repeated rows, extra columns
and null ids pass through scoring untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daygrain.llm.common import Words, hashed_words, ship, utf8

BITS = 22
#: Rows of the fitting sample, taken in hash order over all labelled rows.
MAX_ROWS = 40_000
#: From this score on a document counts as toxic.
THRESHOLD = 0.7
STEM = 4
#: Odd multipliers that keep the families of features apart.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 3


@dataclass
class Model:
    """Sparse weights; ``ids`` is sorted."""

    bias: float = 0.0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def feature_ids(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed feature id) of every feature of consecutive texts, repeats included."""
    h, owner = words.hashes, words.text
    first, second, third = MULTIPLIERS
    near, skip = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    found = [h * first, words.stems * second, ((h[:-1] * second + h[1:]) * first)[near],
             ((h[:-2] * third + h[2:]) * second)[skip]]
    owners = [owner, owner, owner[1:][near], owner[2:][skip]]
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct feature ids of each text, sorted."""
    out = [np.zeros(0, np.int32)] * len(texts)
    for words in hashed_words(texts, STEM):
        owner, ids = feature_ids(words)
        keys = sorted_distinct(owner.astype(np.int64) << BITS | ids)
        whose, first = np.unique(keys >> BITS, return_index=True)
        for i, part in zip(whose, np.split((keys & ((1 << BITS) - 1)).astype(np.int32), first[1:]), strict=True):
            out[i] = sorted_distinct(np.concatenate([out[i], part])) if len(out[i]) else part
    return out


def fit_ftrl(examples: list[tuple[np.ndarray, int]], settings: Settings = Settings()) -> Model:
    """One pass per epoch over the examples, in the order given."""
    toxic = sum(y for _, y in examples)
    n_examples = len(examples)
    prior = float(np.log((toxic + 0.5) / (n_examples - toxic + 0.5)))
    if toxic in (0, n_examples):
        return Model(bias=prior)
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias, bias_n = prior, 0.0
    for _ in range(settings.epochs):
        for ids, y in examples:
            zi, ni = z[ids], n[ids]
            root = np.sqrt(ni)
            w = -np.sign(zi) * np.maximum(np.abs(zi) - settings.l1, 0) / (
                (settings.beta + root) / settings.alpha + settings.l2)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = np.float32(p - y)
            z[ids] = zi + g - (np.sqrt(ni + g * g) - root) / settings.alpha * w
            n[ids] = ni + g * g
            bias_n += float(g) * float(g)
            bias -= 0.1 * float(g) / (1 + bias_n ** 0.5)
    ids = np.flatnonzero(np.abs(z) > settings.l1).astype(np.int32)
    weights = -np.sign(z[ids]) * (np.abs(z[ids]) - settings.l1) / (
        (settings.beta + np.sqrt(n[ids])) / settings.alpha + settings.l2)
    return Model(bias, ids, weights.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, settings: Settings = Settings()) -> Model:
    """Fit on at most ``max_rows`` labelled documents.

    The sampled labels are bounded by ``max_rows``, so they are broadcast and
    only the texts of the sample leave the scan of ``docs``.
    """
    ship(docs.sparkSession)
    order = F.xxhash64(F.lit(17), F.col("_id"))
    sample = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
              .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(order, "_id").limit(max_rows))
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(sample), "_id").select("_id", "_text", "_y"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = distinct_features(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), batch.column(2)],
                names=["id", "features", "y"])

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [(f, int(y)) for pdf in batches for f, y in zip(pdf["features"], pdf["y"], strict=True)]
        if examples:
            model = fit_ftrl(examples, settings)
            yield pd.DataFrame({"bias": [model.bias], "ids": [model.ids], "weights": [model.weights]})

    rows = texts.mapInArrow(extract, "id long, features array<int>, y int")
    fitted = (rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(17), "id"), "id", F.hash("features"))
              .select("features", "y").mapInPandas(train, "bias double, ids array<int>, weights array<float>").first())
    if fitted is None:
        return Model()
    return Model(fitted["bias"], np.array(fitted["ids"], np.int32), np.array(fitted["weights"], np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity",
          keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the probability that a reader marks the text as toxic."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.ids, model.weights))
    kept = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    schema = docs.select(*kept).schema.add(out_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = sent.value[0], Model(*sent.value).dense()
        # A thousand rows at a time: whole rows go back to the JVM, and what both sides hold of them stays small.
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            sums = np.zeros(batch.num_rows)
            active = [np.zeros(0, np.int64)]
            for words in hashed_words(utf8(batch.column(0)), STEM):
                owner, ids = feature_ids(words)
                known = weights[ids] != 0
                active.append(owner[known].astype(np.int64) << BITS | ids[known])
            keys = sorted_distinct(np.concatenate(active))
            np.add.at(sums, keys >> BITS, weights[keys & ((1 << BITS) - 1)])
            p = 1 / (1 + np.exp(-np.clip(bias + sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names=[*kept, out_col])

    return docs.select(F.col(text_col).alias("_text_"), *kept).mapInArrow(run, schema)
