from collections import Counter
from math import floor, log

import numpy as np
import pytest

from cases import ODD
from daygrain.llm import lexical_search
from test_words import words

ITEMS = "item_id long, text string, id long, term string"


def brute(docs, items, k=10):
    """Documents as (id, text), items as (id, text): (item, rank, id, score)."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, bag in asked.items():
        scored = []
        for d, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n_docs // n_terms
            score = sum(times * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                        for t, times in bag.items() if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item", "rank", "id", "score").collect()), key=str)


def corpus():
    draw = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(vocabulary[int(x)] for x in draw.zipf(1.3, 30 + i % 50) % 300)) for i in range(700)]
    # Copies: many equal scores, more than k of them, in both orders of ids.
    docs += [(2000 - i, docs[5][1]) for i in range(60)] + [(3000 + i, "Only WORDS here, w1") for i in range(30)]
    items = [(i, " ".join(vocabulary[int(x)] for x in draw.zipf(1.3, 12) % 300)) for i in range(40)]
    return docs, items + [(100, docs[5][1]), (101, "words here"), (102, "absent"), (103, None), (104, "")]


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_matches_brute_force(spark, frame, block):
    docs, items = corpus()
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    found = lexical_search.search(frame(docs), asked, block_entries=block)
    assert found.columns == ["item", "rank", "id", "score"]
    assert got(found) == brute(docs, items)


def test_odd_cases(spark, odd, empty):
    items = [(1, "two words"), (1, "Two b"), (None, "no id"), (2, "漢字 x ünï"), (3, "%%")]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    assert got(lexical_search.search(odd, asked)) == brute(ODD, items)
    assert lexical_search.search(empty, asked).count() == 0
    none = lexical_search.search(odd, asked.where("false"))
    assert none.count() == 0 and none.columns == ["item", "rank", "id", "score"]


def test_text_ids(spark, frame):
    docs = frame([(i, t) for i, t in ODD]).selectExpr("concat('d', doc_id) AS doc_id", "text")
    asked = spark.createDataFrame([("q", "two words")], "item_id string, text string")
    assert [r["id"] for r in lexical_search.search(docs, asked).orderBy("rank").collect()] == ["d5", "d6", "d6"]


def test_products_are_exact_beyond_a_double():
    draw = np.random.default_rng(1)
    entries = draw.integers(0, 1 << 33, (3, 2 * lexical_search.TILE_TERMS + 5))
    entries[draw.random(entries.shape) < 0.9] = 0
    impacts = draw.integers(0, lexical_search.IMPACT_BOUND, (entries.shape[1], 4))
    want = [[sum(int(a) * int(b) for a, b in zip(entries[i], impacts[:, j])) for j in range(4)] for i in range(3)]
    assert 1 << 55 < max(map(max, want)) < 1 << 63
    assert lexical_search.products(entries, impacts).tolist() == want
    assert lexical_search.ENTRY_BOUND * lexical_search.TILE_TERMS * lexical_search.IMPACT_BOUND < 1 << 53
