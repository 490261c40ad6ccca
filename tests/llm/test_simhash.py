import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daygrain.llm import simhash
from daygrain.operators.runs import components
from cases import ODD


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest unsigned fingerprint reachable over links of at most RADIUS bits."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= simhash.RADIUS:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "One two\tthree", "a b c d a b c d É é \U0001F600", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_a_text_longer_than_a_step(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_allocation(m):
    rng = np.random.default_rng(m)
    counts = rng.integers(1, 10_000, (50, m))
    limits = simhash.allocate(counts, [64 // m] * m, 100_000)
    assert (limits >= -1).all() and (limits.sum(1) == simhash.RADIUS - m + 1).all()
    if m == 3:  # a full bucket is not probed when the others are almost empty
        assert simhash.allocate(np.array([[10 ** 6, 1, 1]]), [21, 21, 22], 10 ** 6)[0, 0] == -1


@pytest.mark.parametrize(("m", "chunk"), [(2, 1024), (3, 1024), (3, 4)])
def test_links_find_all_components(spark, monkeypatch, m, chunk):
    rng = random.Random(m)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            fps.add(f)
            for _ in range(rng.choice([1, 2, 3])):
                f ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)  # a dense group
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)}
    monkeypatch.setattr(simhash, "partition_count", lambda n, radius: m)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = components(simhash.links(table), table.select(F.col("fp").alias("node"))).collect()
    want = brute_components(sorted(fps))
    groups, expected = {}, {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    for f, root in want.items():
        expected.setdefault(root, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_odd_rows(odd, empty):
    got = simhash.near_copies(odd).collect()
    assert sorted((str(r["id"]), r["fp"] % (1 << 64)) for r in got) == sorted((str(i), plain_fingerprint(t)) for i, t in ODD)
    by_id = {r["id"]: r["component_id"] for r in got if r["id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[9] == by_id[8] == by_id[7] == 7 and by_id[12] == 11
    out = simhash.near_dedup(odd)
    assert out.columns == odd.columns
    ids = sorted((str(r["doc_id"]) for r in out.collect()))
    assert ids == sorted(["1", "4", "5", "7", "None", "None", "10", "11", "13"])
    assert simhash.near_copies(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
