from collections import defaultdict
from math import log

import pytest
from pyspark.sql import functions as F

from daygrain.llm import mixing


def table(frame):
    texts = []
    for s, n in ((0, 300), (1, 90), (2, 30), (3, 60)):
        texts += [(s + 4 * k + 4, "w " * (1 + (k * 7 + s) % 40)) for k in range(n)]
    return frame(texts)  # the source is null, s1 or s0, by id


def brute(docs):
    tokens = defaultdict(int)
    for r in docs.collect():
        tokens[r["source"]] += len((r["text"] or "").split())
    return tokens


@pytest.mark.parametrize("limits", [{}, {"min_entropy": 0.99}, {"min_entropy": 0.99, "max_repetition": 1.2},
                                    {"max_repetition": 1.5, "min_entropy": 1.0}, {"budget": 3000.0, "min_entropy": 0.97}])
def test_weights_and_budget(frame, limits):
    docs = table(frame)
    tokens = brute(docs)
    counted, ruled = mixing.planned(docs, **limits)
    rule = {r["source"]: r for r in ruled.collect()}
    total = sum(tokens.values())
    e = next(iter(rule.values()))["exponent"]
    z = sum((t / total) ** e for t in tokens.values())
    weights = {s: (t / total) ** e / z for s, t in tokens.items()}
    assert all(abs(rule[s]["weight"] - w) < 1e-9 for s, w in weights.items())
    budget = limits.get("budget", max(tokens[s] / w for s, w in weights.items()))
    spent = defaultdict(int)
    longest = 40
    for r in mixing.mix(docs, **limits).collect():
        spent[r["source"]] += len((r["text"] or "").split())
    for s, w in weights.items():
        assert budget * w - longest <= spent[s] <= budget * w + 1e-6
        if "max_repetition" in limits:
            assert budget * w / tokens[s] <= limits["max_repetition"] * (1 + 1e-6)
    entropy = -sum(w * log(w) for w in weights.values())
    if "min_entropy" in limits and "max_repetition" not in limits:
        assert abs(entropy - limits["min_entropy"] * log(len(weights))) < 1e-4 or e in (0.0, 1.0)
    if "budget" not in limits:  # every document is kept
        assert {r["doc_id"] for r in mixing.mix(docs, **limits).collect()} == {r["doc_id"] for r in docs.collect()}


def test_copies_are_epochs_and_order_is_a_permutation(frame):
    docs = table(frame)
    out = mixing.mix(docs, min_entropy=1.0).collect()
    per_doc = defaultdict(list)
    for r in out:
        per_doc[r["doc_id"]].append(r["epoch"])
    assert all(sorted(e) == list(range(1, len(e) + 1)) for e in per_doc.values())
    keys = sorted(out, key=lambda r: r["mix_key"])
    sources = [r["source"] for r in keys]
    assert sources != sorted(sources, key=str)
    counts = {s: max(len(per_doc[r["doc_id"]]) for r in out if r["source"] == s) for s in set(sources)}
    assert all(max(counts.values()) - 0 >= c for c in counts.values())


def test_odd_rows(odd, empty):
    out = mixing.mix(odd, min_entropy=0.9, max_repetition=2.0)
    assert out.columns == [*odd.columns, "epoch", "mix_key"]
    first = out.where("epoch = 1")
    assert first.count() == odd.count()
    assert mixing.mix(out, min_entropy=0.9).columns == out.columns
    assert mixing.mix(empty, min_entropy=0.9, max_repetition=2.0).count() == 0
    blank = odd.where("doc_id IN (1, 2, 3)")
    assert mixing.mix(blank, min_entropy=0.9, max_repetition=2.0).count() == 3


def test_a_caller_keeps_its_weight_column(frame):
    docs = frame([(i, f"text {i}") for i in range(12)]).withColumn("_weight", F.lit(0.25)).withColumn("whole", F.lit("w"))
    out = mixing.mix(docs, min_entropy=0.95, max_repetition=2.0)
    assert {(r["_weight"], r["whole"]) for r in out.collect()} == {(0.25, "w")}
    assert out.columns == [*docs.columns, "epoch", "mix_key"]
