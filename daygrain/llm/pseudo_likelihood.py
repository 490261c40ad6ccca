"""LM scoring: masked pseudo-likelihood of a bidirectional window network.

Each word is predicted from the two words before and the two behind it, itself
masked: h = tanh(b + sum of an embedding per neighbour and offset).  The word is
predicted in two steps, its class and its place in the class, which are ranges of
the frequency order; so a normalised log-probability costs 2 * 64 outputs instead
of 4,096.  A network of more ids has three steps (class, group, place), so its outputs
grow with the cube root of the ids: 89 for 25,600.  A document's score is the sum of the
log-probabilities of its words.

Vocabulary: all words are counted over all documents.  The network's classes and
members grow with the fourth root of the number of distinct words, so its ids grow
with the square root, 64 x 64 at least.  The most frequent words get an id of their
own, the rest share hashed ids; their probability is that of the id times the
word's share of the id's count, joined from the table of all counts.

Training: numpy, one pass over all words of all documents in ``ROUNDS`` rounds; every
word is a neighbour, and every word is masked and predicted once.  In a round each task starts from the same weights and learns from its share of the
round's documents; the results are averaged by the number of words, in two steps
where there are more than ``FAN`` of them, so that no task meets the weights of all
others.  A round has ``TASKS`` tasks per core, whatever the number of files: each
hands its weights on once, so these do not grow with the splits of the input.
The scores depend on which documents a task meets, thus on the file layout.

At volume: texts are never shuffled.  Word counts fold map-side; the table of
all counts is stored and joined, never broadcast by force.  Weights grow with the
square root of the distinct words (3 MB at 100,000, 33 MB at ten million): these are
what is broadcast, and what each task hands on.

Defined cases: null and empty texts have no words, a sum of 0 and no mean; a
neighbour beyond the text is a mark of its own; a word that was not counted has
half an occurrence of its shared id; rows that repeat an id are scored
each; without any word in the corpus the weights stay at their start; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from daygrain.llm.common import hashed_words, ship, utf8
from daygrain.session import stored

CLASSES = MEMBERS = 64
WORDS = CLASSES * MEMBERS
#: Classes and members per fourth root of the number of distinct words.
GROWTH = 4
#: One id in so many is shared by words that are not frequent enough for one of their own.
SHARED_OF = 16
OUTSIDE = WORDS
#: Occurrences of a word that was not counted.
UNSEEN = 0.5
OFFSETS = (-2, -1, 1, 2)
WIDTH = 32
ROUNDS = 3
BATCH = 16384
#: Words whose class scores are held at a time, so that they stay in a core's cache.
BLOCK = 2048
#: Ranges of outputs with at most so many words of a batch are taken together.
SMALL = 64
RATE = 0.1
#: Rows of weights handed on together, and how many tasks' weights of such a part are averaged in one step.
PART, FAN = 256, 64
#: Bits of a word's hash behind those that it is first looked up by.
SLOT_SHIFT = np.uint64(44)
#: Training tasks per core.
TASKS = 2


def shapes_of(side: int) -> list[tuple[int, ...]]:
    """Shapes of the embeddings, classes, members and groups for ``side`` * ``side`` ids; two steps have no groups."""
    embed = (len(OFFSETS), side * side + 1, WIDTH)
    if side <= CLASSES:
        return [embed, (side, WIDTH + 1), (side, side, WIDTH + 1), (0, side, WIDTH + 1)]
    step = 8 * int(np.ceil((side * side) ** (1 / 3) / 8))
    classes = -(-side * side // (step * step))
    return [embed, (classes, WIDTH + 1), (classes * step, step, WIDTH + 1), (classes, step, WIDTH + 1)]


@dataclass
class Weights:
    """embed: (offset, word, width); classes: (class, width + 1); members: (class, member, width + 1); the last is a bias.

    With three steps groups: (class, group, width + 1) and members: (class and group, member, width + 1).
    """

    embed: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    groups: np.ndarray

    @staticmethod
    def start(seed: int = 7, side: int = CLASSES) -> Weights:
        rng = np.random.default_rng(seed)
        embed, *others = shapes_of(side)
        return Weights(rng.normal(0, 0.1, embed).astype(np.float32), *(np.zeros(shape, np.float32) for shape in others))

    @property
    def side(self) -> int:
        return isqrt(self.embed.shape[1])

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.classes, self.members, self.groups]

    def steps(self) -> list[tuple[np.ndarray, int]]:
        """(outputs of each range, ids of an output) of the steps in which a word is predicted."""
        size = self.members.shape[1]
        middle = [(self.groups, size)] if len(self.groups) else []
        return [(self.classes[None], size * (self.groups.shape[1] if middle else 1)), *middle, (self.members, 1)]

    def rows(self) -> np.ndarray:
        """All weights as rows of equal width, for sending."""
        flat = np.concatenate([part.ravel() for part in self.parts()])
        return np.resize(np.append(flat, np.zeros(-len(flat) % WIDTH, np.float32)), (-(-len(flat) // WIDTH), WIDTH))

    @staticmethod
    def of_rows(rows: np.ndarray, side: int = CLASSES) -> Weights:
        flat, parts, at = rows.ravel(), [], 0
        for shape in shapes_of(side):
            size = int(np.prod(shape))
            parts.append(flat[at:at + size].reshape(shape).astype(np.float32))
            at += size
        return Weights(*parts)


def exponentials(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits, and the sum of each word's; logits are shifted only where a sum could overflow or vanish."""
    columns, ones = np.swapaxes(rows, -1, -2), np.ones(rows.shape[-2], np.float32)
    p = h @ columns
    with np.errstate(over="ignore"):
        np.exp(p, out=p)
    total = p @ ones
    if not (total.min() > 1e-30 and total.max() < 1e30):
        p = h @ columns
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        total = p @ ones
    return p, total


def contexts(ids: np.ndarray, owner: np.ndarray, outside: int = OUTSIDE) -> np.ndarray:
    """(word, offset): the neighbours of every word, ``outside`` beyond its text."""
    out = np.full((len(ids), len(OFFSETS)), outside, np.int32)
    for k, o in enumerate(OFFSETS):
        here, there = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        same = owner[here] == owner[there]
        out[here, k][same] = ids[there][same]
    return out


def hidden(weights: Weights, near: np.ndarray) -> np.ndarray:
    """The hidden values of words, and a one that the biases are multiplied by."""
    out = np.ones((len(near), WIDTH + 1), np.float32)
    total = weights.embed[0].take(near[:, 0], 0)
    for k in range(1, len(OFFSETS)):
        total += weights.embed[k].take(near[:, k], 0)
    np.tanh(total, out=out[:, :-1])
    return out


def id_order(ids: np.ndarray, side: int) -> np.ndarray:
    """An order that sorts words by id; 16 bits are sorted by radix."""
    return np.argsort(ids.astype(np.min_scalar_type(side * side)), kind="stable")


@dataclass
class Ranges:
    """Some ranges of outputs and their words as (range, word) places among the sorted words, padded with the first word of each."""

    ranges: np.ndarray
    words: np.ndarray
    real: np.ndarray


def ranges_of(chosen: np.ndarray) -> tuple[list[tuple[int, slice]], list[Ranges]]:
    """The ranges that sorted words are in: (range, words) of each large one, small ones of about one size together."""
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    sizes = np.diff(np.append(first, len(chosen)))
    large, small, top = sizes > SMALL, [], SMALL
    while top:
        some = (sizes <= top) & (sizes > top // 2)
        if some.any():
            real = np.arange(top) < sizes[some][:, None]
            small.append(Ranges(chosen[first[some]], first[some][:, None] + np.where(real, np.arange(top), 0), real))
        top //= 2
    cuts = zip(chosen[first[large]].tolist(), first[large].tolist(), sizes[large].tolist(), strict=True)
    return [(c, slice(lo, lo + n)) for c, lo, n in cuts], small


def picks(p: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``p`` as one row, and where it holds the wanted output of each word."""
    return p.reshape(-1), np.arange(0, p.size, p.shape[-1]) + wanted


def log_probabilities(weights: Weights, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The log-probability of every word given its neighbours."""
    out = np.empty(len(ids), np.float64)
    for at in range(0, len(ids), BATCH):
        order = id_order(ids[at:at + BATCH], weights.side)
        own = ids[at:at + BATCH].take(order)
        h, chance = hidden(weights, near[at:at + BATCH].take(order, 0)), np.ones(len(own), np.float32)
        for outputs, size in weights.steps():
            n = outputs.shape[1]
            picked = own // size
            wanted = picked % n
            large, small = ranges_of(picked // n)
            for c, words in large:
                for lo in range(words.start, words.stop, BLOCK):
                    block = slice(lo, min(lo + BLOCK, words.stop))
                    p, total = exponentials(h[block], outputs[c])
                    flat, at_wanted = picks(p, wanted[block])
                    chance[block] *= flat.take(at_wanted) / total
            for some in small:
                p, total = exponentials(h.take(some.words, 0), outputs[some.ranges])
                flat, at_wanted = picks(p, wanted.take(some.words.reshape(-1)))
                chance[some.words[some.real]] *= (flat.take(at_wanted) / total.reshape(-1))[some.real.reshape(-1)]
        out[at + order] = np.log(np.maximum(chance, 1e-30))
    return out


def group_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of groups of consecutive rows, in pairs; ``rows`` are overwritten."""
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    at, step = np.flatnonzero(place), 1
    while len(at):
        odd = place.take(at) & step != 0
        right = at[odd]
        rows[right - step] += rows.take(right, 0)
        at, step = at[~odd], 2 * step
    return rows.take(first, 0)


class Trainer:
    """Adagrad steps on batches of words."""

    def __init__(self, weights: Weights):
        self.w = weights
        self.seen = Weights(*(np.full_like(a, 1e-6) for a in weights.parts()))

    @staticmethod
    def _update(values: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
        squares += gradient * gradient
        values -= RATE * gradient / np.sqrt(squares)

    @staticmethod
    def _update_some(values: np.ndarray, squares: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
        seen = squares[at] + gradient * gradient
        squares[at] = seen
        np.sqrt(seen, out=seen)
        gradient *= RATE
        gradient /= seen
        values[at] -= gradient

    def _large(self, outputs: np.ndarray, seen: np.ndarray, h: np.ndarray, wanted: np.ndarray, back: np.ndarray) -> None:
        """One range of outputs learns from its words."""
        gradient = np.zeros_like(outputs)
        for lo in range(0, len(h), BLOCK):
            own = h[lo:lo + BLOCK]
            p, total = exponentials(own, outputs)
            p *= (1 / total)[:, None]
            flat, at = picks(p, wanted[lo:lo + BLOCK])
            flat[at] -= 1
            back[lo:lo + BLOCK] += p @ outputs[:, :-1]
            gradient += p.T @ own
        self._update(outputs, seen, gradient)

    def _small(self, outputs: np.ndarray, seen: np.ndarray, h: np.ndarray, wanted: np.ndarray, back: np.ndarray, some: Ranges) -> None:
        """Ranges of outputs learn from few words each."""
        rows, own = outputs[some.ranges], h.take(some.words, 0)
        p, total = exponentials(own, rows)
        p *= (some.real / total)[:, :, None]
        flat, at = picks(p, wanted.take(some.words.reshape(-1)))
        flat[at] -= some.real.reshape(-1)
        back[some.words[some.real]] += (p @ rows[:, :, :-1])[some.real]
        self._update_some(outputs, seen, some.ranges, p.transpose(0, 2, 1) @ own)

    def step(self, ids: np.ndarray, near: np.ndarray) -> None:
        w = self.w
        order = id_order(ids, w.side)
        ids, near = ids.take(order), near.take(order, 0)
        h = hidden(w, near)
        back = np.zeros((len(h), WIDTH), np.float32)
        for (outputs, size), (seen, _) in zip(w.steps(), self.seen.steps(), strict=True):
            n = outputs.shape[1]
            picked = ids // size
            wanted = picked % n
            large, small = ranges_of(picked // n)
            for c, words in large:
                self._large(outputs[c], seen[c], h[words], wanted[words], back[words])
            for some in small:
                self._small(outputs, seen, h, wanted, back, some)
        back *= 1 - h[:, :-1] * h[:, :-1]
        for k in range(len(OFFSETS)):
            order = id_order(near[:, k], w.side)
            words = near[:, k].take(order)
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            self._update_some(w.embed[k], self.seen.embed[k], words[first], group_sums(back.take(order, 0), first))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the hash and count of every word of all documents."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in hashed_words(utf8(batch.column(0)), stem=0):
                if len(words.hashes):
                    ranked = np.sort(words.hashes)
                    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ranked[first].view(np.int64)), pa.array(np.diff(np.append(first, len(ranked))))],
                        names=["word", "n"])

    counts = docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts, "words")


def side_of(distinct: int) -> int:
    """Classes, and members of each, for so many distinct words."""
    return max(CLASSES, int(np.ceil(GROWTH * distinct ** 0.25)))


def most_frequent(counts: DataFrame, side: int) -> tuple[np.ndarray, DataFrame]:
    """(hashes of the words with an id of their own, most frequent first; the counts of all others)."""
    room = side * side - side * side // SHARED_OF
    top = counts.orderBy(F.desc("n"), "word").limit(room).collect()  # as many as the network has ids
    last = top[-1] if len(top) == room else None
    rest = counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"]))
                        if last else F.lit(False))
    return np.array([r["word"] for r in top], np.int64).view(np.uint64), rest


def vocabulary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Hashes of the most frequent words of all documents, most frequent first."""
    counts = counted(docs, text_col)
    return most_frequent(counts, side_of(counts.count()))[0]


class Lookup:
    """Word hashes to ids."""

    def __init__(self, frequent: np.ndarray, side: int = CLASSES):
        self.shared = side * side // SHARED_OF
        self.first_shared = side * side - self.shared
        self.order = np.argsort(frequent).astype(np.int32)
        self.ranked = frequent[self.order]
        # The first of the words with the same leading bits is found in one step, others are searched for.
        slots = (self.ranked >> SLOT_SHIFT).astype(np.int64)
        self.slots = np.zeros(1 << (64 - int(SLOT_SHIFT)), np.int32)
        self.slots[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.several = np.zeros(len(self.slots), bool)
        self.several[slots[1:][slots[1:] == slots[:-1]]] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        shared = (self.first_shared + (hashes >> np.uint64(40)) % np.uint64(self.shared)).astype(np.int32)
        if not len(self.ranked):
            return shared
        slots = (hashes >> SLOT_SHIFT).astype(np.int64)
        near = self.slots.take(slots)
        again = np.flatnonzero(self.several.take(slots))
        near[again] = np.minimum(np.searchsorted(self.ranked, hashes[again]), len(self.ranked) - 1)
        return np.where(self.ranked.take(near) == hashes, self.order.take(near), shared)

    def hashed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, text index, hashes) of all words of some texts."""
        ids, owner, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for words in hashed_words(texts, stem=0):
            ids.append(self(words.hashes))
            owner.append(words.text)
            hashes.append(words.hashes)
        return np.concatenate(ids), np.concatenate(owner), np.concatenate(hashes)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, text index) of all words of some texts."""
        return self.hashed(texts)[:2]


def portions(texts: list[bytes], size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes, to bound what is held per word."""
    lo, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size or i == len(texts) - 1:
            yield lo, i + 1
            lo, held = i + 1, 0


def study(trainer: Trainer, ids: np.ndarray, owner: np.ndarray, rng: np.random.Generator, outside: int = OUTSIDE) -> int:
    """Mask and predict every word once, in random order; the number of words."""
    near, order = contexts(ids, owner, outside), rng.permutation(len(ids))
    for at in range(0, len(order), BATCH):
        some = order[at:at + BATCH]
        trainer.step(ids.take(some), near.take(some, 0))
    return len(ids)


def _round(docs: DataFrame, text_col: str, frequent: np.ndarray, weights: Weights, number: int, rounds: int) -> Weights:
    """Weights after one round: the documents of the round, each task on its own, then the average."""
    side, context = weights.side, docs.sparkSession.sparkContext
    sent = context.broadcast((frequent, weights.rows()))
    tasks = TASKS * context.defaultParallelism
    fans = 1 if tasks <= FAN else int(np.ceil(np.sqrt(tasks)))
    mine = docs.where(F.pmod(F.xxhash64(F.lit(11), text_col), F.lit(rounds)) == number).select(text_col).coalesce(tasks)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        lookup, trainer, n = Lookup(sent.value[0], side), Trainer(Weights.of_rows(sent.value[1], side)), 0
        rng = np.random.default_rng(number)
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in portions(texts):
                n += study(trainer, *lookup.texts(texts[lo:hi]), rng, side * side)
        if n:
            rows = trainer.w.rows()
            parts = [rows[at:at + PART].tobytes() for at in range(0, len(rows), PART)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([task % fans] * len(parts), pa.int32()),
                 pa.array([float(n)] * len(parts)), pa.array(parts, pa.binary())], names=["part", "fan", "n", "rows"])

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        total, mean = pdf["n"].sum(), 0
        for n, rows in zip(pdf["n"], pdf["rows"], strict=True):
            mean = mean + np.frombuffer(rows, np.float32) * (n / total)
        return pd.DataFrame({"part": pdf["part"][:1], "fan": pdf["fan"][:1], "n": [total],
                             "rows": [mean.astype(np.float32).tobytes()]})

    schema = "part int, fan int, n double, rows binary"
    partial = mine.mapInArrow(learn, schema)
    if fans > 1:
        partial = partial.groupBy("part", "fan").applyInPandas(average, schema)
    whole = partial.groupBy("part").applyInPandas(average, schema).collect()  # the weights, once
    if not whole:
        return weights
    whole.sort(key=lambda r: r["part"])
    return Weights.of_rows(np.frombuffer(b"".join(r["rows"] for r in whole), np.float32).reshape(-1, WIDTH), side)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[np.ndarray, Weights, DataFrame]:
    """(vocabulary, weights, counts of the other words) learned from all documents."""
    counts = counted(docs, text_col)
    side = side_of(counts.count())
    (frequent, rest), weights = most_frequent(counts, side), Weights.start(side=side)
    for number in range(rounds):
        weights = _round(docs, text_col, frequent, weights, number, rounds)
    return frequent, weights, rest


def shares(said: DataFrame, rest: DataFrame, shared: int) -> DataFrame:
    """(row, share): the sum of log(count of the word / count of its shared id) over the words said in a row."""
    key = (F.shiftrightunsigned("word", 40) % shared).alias("key")
    totals = rest.groupBy(key).agg(F.sum("n").alias("total"))
    known = said.join(rest, "word", "left").select("row", key, "n").join(totals, "key", "left")
    share = F.when(F.col("total").isNull(), 0.0).otherwise(F.log(F.coalesce("n", F.lit(UNSEEN)) / F.col("total")))
    return known.groupBy("row").agg(F.sum(share).alias("share"))


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_probability), one row per row of ``docs``.

    A model without the counts of the other words scores these by their shared ids alone.
    """
    ship(docs.sparkSession)
    frequent, weights, *rest = model
    side = weights.side
    sent = docs.sparkSession.sparkContext.broadcast((frequent, weights.rows()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, weights = Lookup(sent.value[0], side), Weights.of_rows(sent.value[1], side)
        for batch in batches:
            texts, n, total = utf8(batch.column(2)), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            others, sizes = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows + 1, np.int64)
            for lo, hi in portions(texts):
                ids, owner, hashes = lookup.hashed(texts[lo:hi])
                logs = log_probabilities(weights, ids, contexts(ids, owner, side * side))
                n[lo:hi] = np.bincount(owner, minlength=hi - lo)
                total[lo:hi] = np.bincount(owner, logs, minlength=hi - lo)
                other = ids >= lookup.first_shared
                others.append(hashes[other])
                sizes[lo + 1:hi + 1] = np.bincount(owner[other], minlength=hi - lo)
            words = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)),
                                             pa.array(np.concatenate(others).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total), words],
                                             names=["row", "id", "n_words", "log_likelihood", "others"])

    schema = (rows.select("row", "id").schema.add("n_words", "long").add("log_likelihood", "double")
              .add("others", ArrayType(LongType())))
    scored = rows.mapInArrow(run, schema)
    if rest:
        scored = stored(scored, "scores")
        said = scored.select("row", F.explode("others").alias("word"))
        whole = F.col("log_likelihood") + F.coalesce("share", F.lit(0.0))
        scored = (scored.drop("others").join(shares(said, rest[0], side * side // SHARED_OF), "row", "left")
                  .withColumn("log_likelihood", whole))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.select("id", "n_words", "log_likelihood", mean.alias("mean_log_probability"))
