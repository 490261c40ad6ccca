"""Neighbour information against a version that compares all pairs."""

import math

import numpy as np
import pytest

from daygrain.operators import information as I


def psi(n):
    return -0.57721566490153286 + sum(1.0 / i for i in range(1, n))


def plain(x, y, k=3):
    """All pairs; x may hold None."""
    rows = [(a, b) for a, b in zip(x, y) if b is not None]
    known = [a for a, _ in rows if a is not None]
    if len(rows) <= k or not known:
        return None
    a = np.array([np.median(known) if v is None else v for v, _ in rows], float)
    b = np.array([v for _, v in rows], float)
    a, b = ((v - v.mean()) / (v.std() if v.min() < v.max() else 1.0) for v in (a, b))
    total = 0.0
    for i in range(len(a)):
        da, db = np.abs(a - a[i]), np.abs(b - b[i])
        d = np.sort(np.delete(np.maximum(da, db), i))[k - 1]
        same = int(((da < 1e-12) & (db < 1e-12)).sum())
        r = 0.0 if same > k else d * I.INSIDE
        total += psi(same if same > k else k) - psi(int((da <= r + 1e-13).sum())) - psi(int((db <= r + 1e-13).sum()))
    return max(0.0, psi(len(a)) + total / len(a))


def columns(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(2, 9, n).astype(float)
    smooth = rng.normal(size=n)
    return {
        "label": [None if i % 17 == 3 else v for i, v in enumerate((y + (smooth > 0)).tolist())],
        "smooth": smooth.tolist(),
        "holes": [None if i % 5 == 0 else float(v) for i, v in enumerate(smooth ** 2 + 0.1 * rng.normal(size=n))],
        "tails": (rng.standard_cauchy(n) ** 3).tolist(),
        "classes": rng.integers(0, 3, n).astype(float).tolist(),
        "copy": (y * 2).tolist(),
        "constant": [7.1] * n,
        "odd": [math.nan if i % 7 == 0 else math.inf if i % 11 == 0 else float(i % 4) for i in range(n)],
        "clusters": np.where(rng.random(n) < 0.02, 1e6 * rng.random(n), rng.normal(size=n) * 1e-3).tolist(),
    }


def table(spark, data):
    names = list(data)
    return spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` double" for c in names)).repartition(5)


@pytest.mark.parametrize("label,cell", [("label", 8), ("smooth", 8), ("smooth", 256)])
def test_equal_to_all_pairs(spark, label, cell):
    data = columns(600, 5)
    cols = [c for c in data if c != label]
    found = {r["column"]: r for r in I.neighbour_mi(table(spark, data), cols, label, cell=cell).collect()}
    assert set(found) == set(cols)
    for c in cols:
        clean = [None if v is None or not math.isfinite(v) else v for v in data[c]]
        want = plain(clean, data[label])
        assert found[c]["mi"] == pytest.approx(want, abs=1e-9), c
        assert found[c]["n"] == sum(v is not None for v in data[label])


def test_distances_are_exact_whatever_the_cells(spark):
    rng = np.random.default_rng(11)
    pts = {(float(a), float(b)) for a, b in zip(np.round(rng.exponential(size=900) ** 3, 2), rng.integers(0, 4, 900))}
    pts = sorted(pts)
    counts = [1 + (i % 6) * (i % 2) for i in range(len(pts))]
    df = spark.createDataFrame([("c", x, y, n, 1) for (x, y), n in zip(pts, counts)], "column string, _x double, _y double, _count long, n long")
    rows = [p for p, n in zip(pts, counts) for _ in range(n)]
    xs, ys = np.array(rows).T
    want = {}
    for x, y in pts:
        want[x, y] = np.sort(np.maximum(np.abs(xs - x), np.abs(ys - y)))[4]
    for cell in (5, 40):
        celled = I._celled(df, cell)
        sizes = [r["count"] for r in celled.groupBy("_strip", "_cell").count().collect()]
        assert len(sizes) > 4 and min(sizes) >= cell and max(sizes) < 2 * cell
        found = {(r["_x"], r["_y"]): r["_d"] for r in I.neighbour_distances(celled, 4).collect()}
        assert found == want


def test_many_askers_share_a_cell(spark, monkeypatch):
    monkeypatch.setattr(I, "ASKERS", 3)
    data = columns(200, 8)
    found = {r["column"]: r["mi"] for r in I.neighbour_mi(table(spark, data), ["tails", "clusters"], "smooth", cell=8).collect()}
    for c, mi in found.items():
        assert mi == pytest.approx(plain(data[c], data["smooth"]), abs=1e-9)


def test_too_few_rows_and_unknown_columns(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, 2.0), (3.0, None, None), (4.0, None, 4.0)], "a double, b double, y double")
    assert {r["column"]: (r["mi"], r["n"]) for r in I.neighbour_mi(df, ["a", "b"], "y").collect()} == {"a": (None, 3), "b": (None, 3)}
    assert [tuple(r) for r in I.neighbour_mi(df.where("false"), ["a"], "y").collect()] == [("a", None, 0)]
    with pytest.raises(ValueError):
        I.neighbour_mi(df, ["a"], "y", k=0)


def test_digamma(spark):
    got = spark.range(1, 60).select("id", I.digamma(I.F.col("id")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-11) for r in got)
