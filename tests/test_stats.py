"""Summaries and correlations against pandas and numeric integration."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daygrain.operators import correlation as K, stats as S


def skewed(spark, n=6000):
    """One group holds most rows, one has few values, one is NULL."""
    rng = random.Random(5)
    rows = [("hot", rng.lognormvariate(0, 2)) for _ in range(n)]
    rows += [("flat", 3.0)] * 2000 + [("ties", float(rng.randrange(4))) for _ in range(500)]
    rows += [(None, rng.random()) for _ in range(50)] + [("hot", None)] * 30 + [("one", 1.0)]
    return rows, spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize("bounded", [False, True])
def test_describe12_equals_pandas(spark, bounded):
    rows, df = skewed(spark)
    got = {r["g"]: r.asDict() for r in S.describe12(df, ["g"], "x", bounded).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g in {r[0] for r in rows}:
        x = pdf[pdf["g"].isna() if g is None else pdf["g"] == g]["x"].dropna()
        want = dict(n=len(x), mean=x.mean(), median=x.median(), sd=x.std(), q25=x.quantile(.25), q75=x.quantile(.75),
                    iqr=x.quantile(.75) - x.quantile(.25), skew=x.skew(), p1=x.quantile(.01), p99=x.quantile(.99), min=x.min(), max=x.max())
        for name, value in want.items():
            if pd.isna(value):
                assert got[g][name] is None, (g, name)
            else:
                assert got[g][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (g, name)


def test_describe12_without_groups(spark):
    rows, df = skewed(spark)
    x = pd.Series([r[1] for r in rows]).dropna()
    got = S.describe12(df, [], "x").first()
    assert got["median"] == pytest.approx(x.median()) and got["p99"] == pytest.approx(x.quantile(.99))


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "x double")
    out = S.histogram(df, [], "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == [1, 1, 1, 3]
    flat = S.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), [], "x", 2).orderBy("bin").collect()
    assert [(r["bin_lo"], r["n"]) for r in flat] == [(1.5, 0), (2.0, 3)]


def matrix(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"a": x, "b": x + rng.normal(size=n), "c": np.round(rng.normal(size=n)), "d": -x * 2 + 1000.0,
                        "g": rng.integers(0, 3, n).astype(str)})
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "c"] = np.nan
    pdf["k"] = 7.0
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                      "a double, b double, c double, d double, g string, k double")


def test_pearson_equals_pandas(spark):
    pdf, df = matrix(spark)
    cols = ["a", "b", "c", "d", "k"]
    got = {(r["var_a"], r["var_b"]): (r["pearson_r"], r["n"]) for r in K.pairwise_pearson(df, cols).collect()}
    want = pdf[cols].corr(min_periods=3)
    assert len(got) == 10
    for (a, b), (r, n) in got.items():
        assert n == int((pdf[a].notna() & pdf[b].notna()).sum())
        if "k" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def average_ranks(x):
    return pd.Series(x).rank().to_numpy()


def test_spearman_ranks_each_pair_on_its_rows(spark):
    pdf, df = matrix(spark)
    for row in K.pairwise_spearman(df, ["a", "b", "c", "d"]).collect():
        both = pdf[[row["var_a"], row["var_b"]]].dropna()
        want = np.corrcoef(average_ranks(both.iloc[:, 0]), average_ranks(both.iloc[:, 1]))[0, 1]
        assert row["spearman_rho"] == pytest.approx(want, abs=1e-9)


def t_tail(r, n):
    """Two-sided tail of Student's t by integration."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    u = np.linspace(0, math.atan(t / math.sqrt(df)), 200001)
    density = np.cos(u) ** (df - 1)
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    area = float(np.sum((density[1:] + density[:-1]) / 2) * (u[1] - u[0])) if t else 0.0
    return 1 - 2 * front * area


@pytest.mark.parametrize("r, n", [(0.0, 10), (0.1, 12), (0.5, 20), (-0.3, 100), (0.9, 5), (0.05, 2000)])
def test_p_values(spark, r, n):
    out = K.with_p_values(spark.createDataFrame([(r, n)], "pearson_r double, n long")).first()["p"]
    assert out == pytest.approx(t_tail(r, n), abs=1e-6)


def test_p_value_edges(spark):
    rows = [(1.0, 10), (None, 10), (0.5, 2)]
    out = [r["p"] for r in K.with_p_values(spark.createDataFrame(rows, "pearson_r double, n long")).collect()]
    assert out[0] == 0.0 and out[1] is None and (out[2] is None or math.isnan(out[2]))


def test_within_group_differs_from_pooled(spark):
    rows = [("x", 1.0, 3.0), ("x", 2.0, 2.0), ("x", 3.0, 1.0), ("y", 11.0, 13.0), ("y", 12.0, 12.0), ("y", 13.0, 11.0)]
    df = spark.createDataFrame(rows, "participant_id string, a double, b double")
    out = K.pooled_vs_within(df, ["a", "b"]).first()
    assert out["pooled_r"] > 0.9 and out["within_r"] == pytest.approx(-1.0) and out["flips"]


def test_redundancy_groups_use_average_linkage(spark):
    pairs = [("a", "b", 0.95), ("a", "c", 0.85), ("b", "c", 0.7), ("a", "d", None), ("b", "d", 0.1), ("c", "d", -0.2)]
    df = spark.createDataFrame(pairs, "var_a string, var_b string, spearman_rho double")
    # c joins {a, b} at mean |rho| 0.775: outside 0.8, inside 0.75.
    assert K.redundancy_groups(df, ["a", "b", "c", "d"], 0.8).first()["members"] == "a;b"
    assert K.redundancy_groups(df, ["a", "b", "c", "d"], 0.75).first()["members"] == "a;b;c"


def test_vif(spark):
    pdf, df = matrix(spark)
    complete = pdf[["a", "b", "c"]].dropna()
    out = {r["column"]: r["vif"] for r in K.vif(df, ["a", "b", "c"]).collect()}
    inverse = np.linalg.inv(np.corrcoef(complete.to_numpy().T))
    for i, c in enumerate(["a", "b", "c"]):
        assert out[c] == pytest.approx(inverse[i, i], abs=0.01)
    assert {r["column"]: r["vif"] for r in K.vif(df, ["a", "c", "d"]).collect()}["a"] == float("inf")


def test_binned_mi_orders_dependence(spark):
    pdf, df = matrix(spark)
    out = {r["column"]: r["mi_binned"] for r in K.binned_mi(df, ["b", "c", "d"], "a").collect()}
    assert out["d"] > out["b"] > out["c"] >= 0


def test_numeric_screen(spark):
    _, df = matrix(spark)
    kept, dropped = K.numeric_screen(df, ["a", "g", "k"])
    assert kept == ["a"] and dropped == {"non_numeric": ["g"], "zero_variance": ["k"]}


def test_median_imputation_and_coverage(spark):
    from daygrain.operators import missing as M
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (5.0, 3.0), (9.0, None)], "a double, b double")
    assert [r["a"] for r in M.median_impute(df, ["a", "b"]).collect()] == [1.0, 5.0, 5.0, 9.0]
    assert {r["column"]: r["coverage"] for r in M.coverage(df, ["a", "b"]).collect()} == {"a": 0.75, "b": 0.75}
    assert M.complete_cases(df, ["a", "b"], 0.7).count() == 2
    assert df.select(F.lit(1)).count() == 4


def test_values_that_are_not_finite_are_unknown(spark):
    rows = [(float(i), float(i * i % 17)) for i in range(50)]
    odd = spark.createDataFrame(rows + [(float("nan"), 1.0), (2.0, float("inf")), (None, 3.0)], "a double, b double")
    clean = spark.createDataFrame(rows, "a double, b double")
    for of in (K.pairwise_pearson, K.pairwise_spearman):
        got, want = of(odd, ["a", "b"]).first(), of(clean, ["a", "b"]).first()
        assert got["n"] == want["n"] == 50 and got[2] == pytest.approx(want[2], abs=1e-12)
    relevance = K.label_relevance(odd, ["a"], "b").first()
    assert relevance["n"] == 50


def test_spearman_of_many_columns(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 9, (300, 30)).astype(float), columns=[f"c{i}" for i in range(30)])
    pdf.iloc[:40, 10:20] = np.nan
    pdf.loc[rng.random(300) < 0.3, "c25"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"c{i} double" for i in range(30)))
    out = K.pairwise_spearman(df, list(pdf.columns))
    want = pdf.corr("pearson")
    for r in out.collect():
        both = pdf[[r["var_a"], r["var_b"]]].dropna()
        want = np.corrcoef(average_ranks(both.iloc[:, 0]), average_ranks(both.iloc[:, 1]))[0, 1]
        assert r["n"] == len(both) and r["spearman_rho"] == pytest.approx(want, abs=1e-9)

    def exchanges(cols):
        return K.pairwise_spearman(df, cols)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(["c0", "c1"]) == exchanges([f"c{i}" for i in range(10)])


def test_spearman_of_many_patterns(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.integers(0, 30, (400, 45)).astype(float), columns=[f"c{i}" for i in range(45)])
    for i in range(45):
        pdf.loc[rng.random(400) < 0.02 * (i % 23), f"c{i}"] = np.nan
    pdf["c7"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"c{i} double" for i in range(45)))
    classes = list(range(45))
    block, slot, first, wide = K._blocks(classes)
    assert max(wide) <= K.MASKS and len(first) == 3 and all(first[b] + s == classes[i] for i, (b, s) in enumerate(zip(block, slot)))
    for pairs in (list(combinations(pdf.columns, 2)), [(c, "c44") for c in pdf.columns[:-1]]):
        out = K.spearman_pairs(df, pairs).collect()
        assert len(out) == len(pairs)
        for r in out:
            both = pdf[[r["var_a"], r["var_b"]]].dropna()
            assert r["n"] == len(both)
            want = np.corrcoef(average_ranks(both.iloc[:, 0]), average_ranks(both.iloc[:, 1]))[0, 1] if len(both) > 2 else None
            assert r["spearman_rho"] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_blocks_bound_the_ranks_of_a_row():
    for classes in ([0] * 5000, [i // 40 for i in range(4000)], list(range(300)), [i % 3 for i in range(3000)]):
        block, slot, first, wide = K._blocks(classes)
        size = np.bincount(block)
        assert max(wide) <= K.MASKS and all(n * w <= K.CELLS for n, w in zip(size, wide))
        order = {m: i for i, m in enumerate(sorted(set(classes)))}
        assert all(first[block[c]] + slot[c] == order[classes[c]] for c in range(len(classes)))


@pytest.mark.parametrize("plain", [0, 64])
def test_pearson_by_sums_and_by_matrices(spark, monkeypatch, plain):
    monkeypatch.setattr(K, "PLAIN_PAIRS", plain)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(1e6, 1.0, (500, 5)), columns=list("abcde"))
    pdf.loc[rng.random(500) < 0.3, "b"] = np.nan
    pdf["d"] = 4.0
    pdf["e"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double")
    for r in K.pairwise_pearson(df, list("abcde")).collect():
        both = pdf[[r["var_a"], r["var_b"]]].dropna()
        assert r["n"] == len(both)
        flat = len(both) < 3 or "d" in (r["var_a"], r["var_b"])
        assert r["pearson_r"] == (None if flat else pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9))


def plain_r2(matrix, j):
    rest = [i for i in range(len(matrix)) if i != j]
    return float(matrix[j, rest] @ np.linalg.pinv(matrix[np.ix_(rest, rest)]) @ matrix[rest, j])


def test_one_sweep_gives_every_r2():
    rng = np.random.default_rng(7)
    for k in range(1, 12):
        x = rng.normal(size=(400, k)) @ rng.normal(size=(k, k))
        if k > 4:
            x[:, 1] = 2 * x[:, 0] - x[:, 3]  # three columns explain each other
        if k > 7:
            x[:, 6] = x[:, 5]
        c = np.atleast_2d(np.corrcoef(x.T))
        for j, r2 in enumerate(K.swept_r2(c)):
            assert r2 == pytest.approx(plain_r2(c, j) if k > 1 else 0.0, abs=1e-6)
    assert K.swept_r2(np.eye(3)).tolist() == [0.0, 0.0, 0.0]


def test_inflation_of_several_coverages(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(1e5, 1.0, (600, 5)), columns=list("abcde"))
    pdf["b"] = pdf["a"] + 0.5 * pdf["b"]
    pdf.loc[rng.random(600) < 0.03, "c"] = np.nan
    pdf.loc[rng.random(600) < 0.5, "d"] = np.nan
    pdf["e"] = pdf["a"] + pdf["c"]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double")
    out = K.core_vifs(df, list("abcde"), (1.0, 0.95, 0.4)).collect()
    for share, core in ((1.0, ["a", "b"]), (0.95, ["a", "b", "c", "e"]), (0.4, list("abcde"))):
        some = {r["column"]: r for r in out if r["min_coverage"] == share}
        rows = pdf[core].dropna()
        c = np.corrcoef(rows.to_numpy().T)
        assert set(some) == set(core)
        for j, name in enumerate(core):
            assert some[name]["n"] == len(rows) and some[name]["r2_vs_rest"] == pytest.approx(plain_r2(c, j), abs=1e-3)
            assert (some[name]["vif"] == float("inf")) == (share < 1.0 and name in "ace")
    few = K.core_vifs(df.limit(50), ["a", "b"]).collect()
    assert {(r["status"], r["vif"]) for r in few} == {("too few rows", None)} and len(few) == 4
    assert {r["status"] for r in K.core_vifs(df.where("false"), ["a", "b"]).collect()} == {"too few columns"}


def test_ranks_are_looked_up_or_placed_as_the_values_are_few_or_many(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 500
    x = pd.DataFrame({"a": rng.integers(0, 5, n).astype(float), "b": rng.normal(size=n).round(1), "c": rng.normal(size=n),
                      "d": rng.normal(size=n), "e": np.ones(n), "f": np.full(n, np.nan)})
    x["d"] += x["c"]
    x["b"] += x["a"]
    for i, c in enumerate("abcd"):
        x.loc[rng.random(n) < 0.1 * i, c] = np.nan
    df = spark.createDataFrame(x)
    shuffled = K._shuffled_sums
    for table in (1 << 21, 500, 0):
        called = []
        monkeypatch.setattr(K, "TABLE", table)
        monkeypatch.setattr(K, "_shuffled_sums", lambda data, pairs: called.extend(pairs) or shuffled(data, pairs))
        got = {(r["var_a"], r["var_b"]): (r["spearman_rho"], r["n"]) for r in K.pairwise_spearman(df, list(x)).collect()}
        # Few values: no rank is shuffled to a row.
        assert bool(called) == (table < 1 << 21)
        for (a, b), (rho, rows) in got.items():
            both = x[[a, b]].dropna()
            want = both.rank().corr().iloc[0, 1] if len(both) >= 3 else np.nan
            assert rows == len(both) and (rho is None if np.isnan(want) else rho == pytest.approx(want))


def test_binned_information_shuffles_cells_only(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3) if i % 5 else None, float(i % 2)) for i in range(100)], "a double, b double, y double")
    out = K.binned_mi(df, ["a", "b"], "y", 2)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["column"]: (r["mi_binned"], r["n"]) for r in out.collect()}
    for c in "ab":
        rows = [(r[c], r["y"]) for r in df.collect() if r[c] is not None]
        hi = max(v for v, _ in rows)
        cells = pd.Series([(min(int(v // (hi / 2)), 1), y) for v, y in rows]).value_counts() / len(rows)
        px, py = cells.groupby(lambda k: k[0]).sum(), cells.groupby(lambda k: k[1]).sum()
        want = sum(p * np.log(p / (px[k[0]] * py[k[1]])) for k, p in cells.items())
        assert got[c] == (pytest.approx(max(want, 0.0)), len(rows))


def test_small_groups_are_not_spread_over_buckets(spark, monkeypatch):
    from daygrain.operators import stats
    x = pd.DataFrame({"g": ["a"] * 40 + ["b"] * 5 + [None] * 3, "v": [float(i * i % 17) for i in range(48)]})
    df = spark.createDataFrame(x)
    probs = {"lo": 0.1, "mid": 0.5}
    plan = stats.exact_quantiles(df, ["g"], "v", probs)._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" not in plan and "Window" not in plan
    for most in (4096, 10, 0):
        monkeypatch.setattr(stats, "GATHERED", most)
        got = {r["g"]: (r["lo"], r["mid"]) for r in stats.exact_quantiles(df, ["g"], "v", probs).collect()}
        for g, part in x.groupby("g", dropna=False):
            assert got[None if pd.isna(g) else g] == pytest.approx(tuple(part["v"].quantile([0.1, 0.5])))


def test_wide_rows_are_stored_by_methods_that_are_compiled(spark, monkeypatch):
    """The setting holds while the columns are stored, and the ranks of values seen again, new and unknown are whole."""
    from daygrain import session
    from daygrain.operators import correlation as K
    seen, before = [], spark.conf.get(session.METHOD_LIMIT)

    def noted(df, *rest):
        seen.append(spark.conf.get(session.METHOD_LIMIT))
        return session.stored(df, *rest)

    monkeypatch.setattr(K, "stored", noted)
    rows = spark.range(0, 3000, 1, 1).select((F.col("id") % 7).cast("double").alias("a"), F.floor(F.col("id") / 100).cast("double").alias("b"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = K.pairwise_spearman(rows, ["a", "b"]).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen == ["8000"] and spark.conf.get(session.METHOD_LIMIT) == before
    pdf = rows.toPandas()
    assert got["n"] == 3000 and abs(got["spearman_rho"] - pdf["a"].rank().corr(pdf["b"].rank())) < 1e-9
