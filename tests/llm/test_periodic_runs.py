import hashlib
import random
import re
import zlib

import pytest

from cases import ODD
from daygrain.llm import periodic_runs
from daygrain.llm.queries import QUERIES, planted_periods

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    """Every start, every period: stretches that cannot be extended and have no smaller period."""
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts():
    draw = random.Random(3)
    out = [" ".join(draw.choice("ab") for _ in range(n)) for n in range(0, 60, 3)]
    for _ in range(60):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            unit = [draw.choice("abcdef") for _ in range(draw.randrange(1, 9))]
            parts += unit * draw.randrange(1, 8) + unit[:draw.randrange(0, len(unit) + 1)]
            parts += [draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(0, 12))]
        out.append(" ".join(parts))
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), "x " * 500, "x y " * 200 + "x x " * 9, "a b a b a b a b c a b a b a b a b", "x x x x x", "a a a a a a"]


@pytest.mark.parametrize("group", [1 << 22, 50])
def test_runs_match_brute_force(spark, frame, monkeypatch, group):
    monkeypatch.setattr(periodic_runs, "GROUP", group)
    rows = list(enumerate(texts(), 100))
    got = {r["id"]: r for r in periodic_runs.periodic_runs(frame(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute_runs(words_of(t))
        assert [tuple(r) for r in got[i]["runs"]] == want, t
        assert got[i]["collapsed"] == brute_collapsed(words_of(t), want)


def test_scan_of_random_words():
    draw = random.Random(9)
    for _ in range(400):
        letters, n = draw.choice(["ab", "abc", "abcde"]), draw.randrange(0, 80)
        w = [draw.choice(letters) for _ in range(n)]
        if draw.random() < 0.5 and n > 8:
            at, q = draw.randrange(n // 2), draw.randrange(1, 6)
            w[at:] = [w[at + (i % q)] if at + i % q < n else w[at] for i in range(n - at)]
        assert periodic_runs.find_runs([[x.encode() for x in w]])[0] == brute_runs(w), w


def test_odd_cases(odd, empty):
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == len(ODD)
    blank = [r for r in got if r["id"] in (1, 2, 3)]
    assert all(r["runs"] == [] and r["collapsed"] == "" for r in blank)
    assert {(r["id"], r["collapsed"]) for r in got if r["id"] == 6} == {(6, "two words")}
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_a_very_long_text(frame):
    draw = random.Random(4)
    w = [draw.choice("abcdefghij") for _ in range(60_000)]
    w[20_000:50_000] = (w[20_000:20_700] * 50)[:30_000]
    runs = periodic_runs.find_runs([[x.encode() for x in w]])[0]
    longest = max(runs, key=lambda r: r[1])
    assert longest[2] == 700 and longest[0] <= 20_000 and longest[0] + longest[1] >= 50_000


def test_planting_matches_the_rule(spark, frame):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (10**12, "x"), (-4, "a b c d"), (5, None)]
    got = {r["doc_id"]: r["text"] for r in planted_periods(frame(rows)).collect()}
    assert len(got) == len(dict(rows))
    for i, t in dict(rows).items():
        want = words_of(t) if i is None else planted(i, words_of(t))
        assert words_of(got[i]) == want


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    for r in rows:
        w = planted(r["doc_id"], words_of(r["text"]))
        runs = brute_runs(w) if len(w) <= 700 else [tuple(x) for x in periodic_runs.find_runs([[x.encode() for x in w]])[0]]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        mine = got[r["doc_id"]]
        assert (mine["n_runs"], mine["start"], mine["length"], mine["period"]) == (len(runs), *best)
        assert mine["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert mine["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert mine["collapsed_sha256"] == sha(brute_collapsed(w, runs))
