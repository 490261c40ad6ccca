import random

import numpy as np
import pytest

from daygrain.llm import toxicity
from daygrain.llm.common import hashed_words, plain_words

SLURS = ["blork", "zanth", "gripple"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(SLURS))
        out.append((i, " ".join(text), int(bad)))
    return out


def test_words_hash_alike_across_pieces():
    texts = ["Abc d é! x".encode(), b"", ("hello wörld, " * 200_000).encode(), b"tail one"]
    seen = {}
    for words in hashed_words(texts):
        seen |= {(t, p): h for t, p, h in zip(words.text.tolist(), words.place.tolist(), words.hashes.tolist())}
    assert sorted(seen) == [(i, j) for i, t in enumerate(texts) for j, _ in enumerate(plain_words(t))]
    assert len(set(seen.values())) == len({w for t in texts for w in plain_words(t)})


def test_held_out_accuracy(spark, frame):
    rows = corpus(1500)
    docs = frame([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.ids) < 5000  # L1 leaves few weights
    scored = toxicity.score(docs, model, keep=["doc_id"]).collect()
    wrong = [r for r in scored if r["doc_id"] % 3 == 0 and (r["toxicity"] >= 0.7) != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 10


def test_sequential_update_matches_the_textbook():
    rng = np.random.default_rng(3)
    examples = [(np.unique(rng.integers(0, 50, 8)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(200)]
    s = toxicity.Settings(epochs=2, l1=0.3)
    model = toxicity.fit_ftrl(examples, s)
    z, n = dict.fromkeys(range(50), 0.0), dict.fromkeys(range(50), 0.0)
    toxic = sum(y for _, y in examples)
    bias, bn = float(np.log((toxic + .5) / (len(examples) - toxic + .5))), 0.0

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** .5) / s.alpha + s.l2)
    for _ in range(s.epochs):
        for ids, y in examples:
            w = {i: weight(i) for i in ids.tolist()}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for i in w:
                z[i] += g - ((n[i] + g * g) ** .5 - n[i] ** .5) / s.alpha * w[i]
                n[i] += g * g
            bn += g * g
            bias -= 0.1 * g / (1 + bn ** .5)
    want = {i: weight(i) for i in range(50) if weight(i)}
    got = dict(zip(model.ids.tolist(), model.weights.tolist()))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model)
    assert out.columns == [*odd.columns, "toxicity"] and out.count() == odd.count()
    assert all(0 <= r["toxicity"] <= 1 for r in out.collect())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(odd, labels.where("false"))
    assert {r["toxicity"] for r in toxicity.score(odd, none).collect()} == {0.5}
    one = toxicity.fit(odd, labels.where("toxic = 0"))
    assert all(r["toxicity"] < 0.5 for r in toxicity.score(odd, one).collect())
    assert toxicity.fit(empty, labels).bias == 0


@pytest.mark.parametrize("name", ["toxicity"])
def test_clashing_score_column_is_replaced(odd, name):
    from pyspark.sql import functions as F
    out = toxicity.score(odd.withColumn(name, F.lit("old")), toxicity.Model(bias=1.0))
    assert dict(out.dtypes)[name] == "double"
