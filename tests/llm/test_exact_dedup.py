import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daygrain.llm import exact_dedup
from cases import ODD


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = max(members, key=lambda m: (m[1], m[0] is not None, -(m[0] or 0)))[0]
        out += [(i, n, hashlib.sha256(norm.encode()).hexdigest(), keep, len(members)) for i, n in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_classes_match_brute_force(frame, block):
    rows = ODD + [(100 + i, "abcdef" * (i % 7) + "x" * (i % 3)) for i in range(60)] + [(200, " a b c"), (201, "abc"), (202, "ab c")]
    got = exact_dedup.classes(frame(rows), block_points=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_shared_addresses_fall_back_to_the_blocks(frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "address", lambda block: [F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2")])
    got = exact_dedup.classes(frame(ODD), block_points=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ODD)


def test_deduplicate_keeps_one_row_of_a_group(odd, empty):
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    # 3 is the longest blank text, 6 stands for "two  words" and its repeat, 5 has a capital.
    assert sorted(ids, key=str) == sorted([3, 4, 5, 6, 7, 8, None, 10, 11, 12, 13], key=str)
    assert exact_dedup.deduplicate(empty).count() == 0 and exact_dedup.classes(empty).count() == 0
