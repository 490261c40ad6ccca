import random

import pytest
from pyspark.sql import functions as F

from daygrain.llm import decontamination
from test_words import words
from cases import ODD


def brute(docs, items, size):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, said in items:
            q = words(said)
            n = min(size, len(q))
            for a in range(len(q) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == q[a:a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "A", "é", "x1"] * 4 + [f"w{i}" for i in range(20)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(1, 15))) for i in range(12)] + [(50, ""), (51, None), (52, "!!"), (3, "the of the of")]
    docs = [(i, say(rng.randint(0, 60)) + (", " + items[i % 12][1].upper().replace(" ", "\n-") if i % 3 == 0 else "")) for i in range(60)]
    return docs, items


@pytest.mark.parametrize(("size", "block"), [(4, 2_000_000), (10, 2_000_000), (4, 20), (1, 2_000_000)])
def test_matches_brute_force(spark, frame, monkeypatch, size, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    docs, items = corpus(size)
    docs = docs + [(i and i + 100, t) for i, t in ODD]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.matches(frame(docs), table, size=size).collect()
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute(docs, items, size)


def test_proximity(spark, frame):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame([(1, "alpha beta gamma delta"), (2, "alpha the beta gamma delta x x"), (3, "alpha x x x x x x beta"), (4, "beta alpha"),
                  (5, "delta x alpha")])
    got = {r["id"]: (r["n_hit"], r["n_near"]) for r in decontamination.matches(docs, items, size=4, slop=2).collect()}
    # The two rarest terms are gamma, then delta (ties by place in the item).
    assert got == {1: (4, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def brute_near(docs, items, size, slop):
    """Places of the rarest term of each window with all its terms within ``slop``."""
    texts = [words(t) for _, t in docs]
    count = lambda t: sum(w.count(t) for w in texts)
    out = [0] * len(docs)
    for item in {i for i, _ in items}:
        windows = set()
        for i, said in items:
            q = words(said) if i == item else []
            n = min(size, len(q))
            windows |= {tuple(q[a:a + n]) for a in range(len(q) - n + 1 if n else 0)}
        for window in windows:
            pivot = min(range(len(window)), key=lambda k: (count(window[k]), k))
            for d, w in enumerate(texts):
                for p in (p for p, t in enumerate(w) if t == window[pivot]):
                    out[d] += all(t in w[max(0, p - pivot + k - slop):max(0, p - pivot + k + slop + 1)]
                                  for k, t in enumerate(window) if k != pivot)
    return out


@pytest.mark.parametrize(("size", "slop"), [(3, 1), (4, 2), (10, 3), (1, 2)])
def test_proximity_matches_brute_force(spark, frame, size, slop):
    docs, items = corpus(20 + size)
    rng = random.Random(size)
    for i in range(30):  # windows with a word put in, left out or swapped
        w = (items[i % 12][1] or "").split()
        at = rng.randrange(len(w))
        w[at:at + 1] = rng.choice([[], [w[at], "put"], [w[at], "in", "in"]])
        docs.append((200 + i, " ".join(w)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: r["n_near"] for r in decontamination.matches(frame(docs), table, size=size, slop=slop).collect()}
    want = dict(zip((i for i, _ in docs), brute_near(docs, items, size, slop)))
    assert got == want and sum(want.values()) > 20


def test_decontaminate(spark, odd, empty):
    items = spark.createDataFrame([(1, "one"), (2, "two WORDS")], "item_id long, text string")
    out = decontamination.decontaminate(odd, items)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 2, 3, 7, 8, 9, None, None, 10, 11, 12, 13], key=str)
    assert decontamination.decontaminate(empty, items).count() == 0
    none = decontamination.matches(odd, items.where("false"))
    assert none.count() == odd.count() and none.agg(F.sum("n_hit")).first()[0] == 0


def test_rows_without_an_id_are_judged_by_their_own_text(spark, frame):
    leaked = "one two three four five six seven eight nine ten"
    docs = frame([(None, "x " + leaked), (None, "a clean text"), (None, None), (7, leaked + " y"), (7, "another clean text"), (8, "clean")])
    items = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(None, "a clean text"), (None, None), (7, "another clean text"), (8, "clean")], key=str)
