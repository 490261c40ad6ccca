"""Pairwise correlation, redundancy, collinearity and label relevance.

Results are long pair tables (var_a, var_b, ...), as many rows as pairs of
columns; only tables of that size ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.operators.missing import complete_cases, covered_columns
from daygrain.operators.rolling import demean_within
from daygrain.operators.stats import value_positions
from daygrain.session import ship, short_methods, stored

MIN_PAIR_ROWS = 3
MIN_COMPLETE_ROWS = 100
#: Masks a value is ranked on at a time, ranks of a row in one tile, and ranks in one array of a task.
MASKS, CELLS, TENSOR = 16, 2048, 1 << 22
#: Ranks (values x masks) that a task looks up in memory; the columns of fewest values take them.
TABLE = 1 << 21
#: Up to so many pairs the sums are plain aggregates; more pairs fold as matrices.
PLAIN_PAIRS = 64
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_PAIR = "var_a string, var_b string"

Pairs = Sequence[tuple[str, str]]


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns of ``cols``."""
    types = dict(df.dtypes)
    numeric = [c for c in cols if types[c] in _NUMERIC or types[c].startswith("decimal")]
    return numeric, [c for c in cols if c not in numeric]


def finite(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """``cols`` as doubles; what is not a finite number is NULL."""
    values = {c: F.col(c).cast("double") for c in cols}
    return df.select(*keep, *[F.when(F.abs(v) < F.lit(math.inf), v).alias(c) for c, v in values.items()])


def numeric_screen(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Columns that vary, and what was dropped why.

    A column varies when its minimum and maximum differ: one scan, no distinct
    counting.
    """
    numeric, other = numeric_columns(df, cols)
    row = df.agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in numeric]).first()
    constant = [c for c in numeric if not row[c]]
    return [c for c in numeric if row[c]], {"non_numeric": other, "zero_variance": constant}


_SUMS = ("n", "sa", "sb", "qa", "qb", "p")


def _r_of_sums(sums: DataFrame, pairs: Pairs, out: str) -> DataFrame:
    """r and n per pair from per-task sums (i, n, sum a, sum b, squares, products)."""
    total = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(s: str, q: str) -> Column:
        rest = F.col(q) - F.col(s) * F.col(s) / n
        return F.when(rest > 1e-12 * F.col(q), rest)

    r = (F.col("p") - F.col("sa") * F.col("sb") / n) / F.sqrt(spread("sa", "qa") * spread("sb", "qb"))
    r = F.when((F.col("n") >= MIN_PAIR_ROWS) & r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    names = df_of_pairs(sums, pairs)
    return names.join(total, "i", "left").select(
        "var_a", "var_b", r.alias(out), F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"))


def df_of_pairs(like: DataFrame, pairs: Pairs) -> DataFrame:
    return like.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, {_PAIR}")


def _indices(pairs: Pairs) -> tuple[list[str], np.ndarray, np.ndarray]:
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(cols)}
    return cols, np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs])


def _plain_sums(data: DataFrame, pairs: Pairs, centre: dict[str, float]) -> DataFrame:
    """The six sums of every pair as aggregates, one row per pair."""
    sums = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c) - F.lit(centre[c])) for c in (a, b))
        parts = (F.when(both, F.lit(1.0)), x, y, x * x, y * y, x * y)
        sums += [F.coalesce(F.sum(p), F.lit(0.0)).alias(f"{c}_{i}") for c, p in zip(_SUMS, parts, strict=True)]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"{c}_{i}").alias(c) for c in _SUMS]) for i in range(len(pairs))])
    return data.agg(*sums).select(F.inline(rows))


def pearson_pairs(df: DataFrame, pairs: Pairs, out: str = "pearson_r") -> DataFrame:
    """Pearson r and n of the named pairs, each on its own complete rows, in one scan.

    Up to ``PLAIN_PAIRS`` pairs are six plain sums each.  For more, each task
    folds its Arrow batches into masked k x k moment matrices and emits one row
    per pair.  The sums meet in one small aggregation.  Columns are centred on
    their means first, so that the sums do not cancel.  Values that are not
    finite count as unknown.
    """
    cols, left, right = _indices(pairs)
    data = finite(df, cols)
    means = data.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centre = np.array([0.0 if means[c] is None else means[c] for c in cols])
    if len(pairs) <= PLAIN_PAIRS:
        return _r_of_sums(_plain_sums(data, pairs, dict(zip(cols, centre.tolist(), strict=True))), pairs, out)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(cols), len(cols)))
        s, q, p = n.copy(), n.copy(), n.copy()
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            known = np.isfinite(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            p += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(left)), "n": n[left, right],
                            "sa": s[left, right], "sb": s[right, left],
                            "qa": q[left, right], "qb": q[right, left], "p": p[left, right]})

    sums = data.mapInPandas(fold, "i int, n double, sa double, sb double, qa double, qb double, p double")
    return _r_of_sums(sums, pairs, out)


def pairwise_pearson(df: DataFrame, cols: Sequence[str], out: str = "pearson_r") -> DataFrame:
    """Every pair of columns, a before b in the given order."""
    return pearson_pairs(df, list(combinations(cols, 2)), out)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the regularised incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def two_sided_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P-value of Pearson's r: the beta tail I(1 - r^2; (n-2)/2, 1/2)."""
    out = np.full(len(r), np.nan)
    ok = np.isfinite(r) & (n >= MIN_PAIR_ROWS)
    a, b, x = (n[ok] - 2) / 2.0, 0.5, np.clip(1.0 - r[ok] ** 2, 0.0, 1.0)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    half = np.full_like(a, b)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - math.lgamma(b))
        low = front * _beta_fraction(a, half, x) / a
        # Above the mean of the distribution the mirrored fraction converges.
        high = 1.0 - front * _beta_fraction(half, a, 1 - x) / b
        p = np.where(x < (a + 1) / (a + b + 2), low, high)
    out[ok] = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(p, 0.0, 1.0)))
    return out


def with_p_values(pairs: DataFrame, r: str = "pearson_r", n: str = "n") -> DataFrame:
    """Add the two-sided p-value of each pair (vectorised on the pair table)."""
    @F.pandas_udf("double")
    def p_value(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(rs.to_numpy(dtype=float), ns.to_numpy(dtype=float)))

    raw = p_value(F.col(r).cast("double"), F.col(n).cast("double"))
    return pairs.withColumn("p", F.when(F.col(r).isNotNull(), raw))


def _known_classes(data: DataFrame, cols: Sequence[str]) -> list[int]:
    """For each column the first column that is known on exactly the same rows."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(cols), len(cols)))
        for batch in batches:
            known = np.isfinite(batch.to_numpy(dtype=float))
            if known.all():
                n += len(known)
            else:
                m = known.astype(float)
                n += m.T @ m
        yield pd.DataFrame({"i": np.arange(n.size), "n": n.ravel()})

    rows = data.mapInPandas(fold, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(cols) ** 2)
    for row in rows:  # one number per pair of columns
        n[row["i"]] = row["n"]
    n = n.reshape(len(cols), len(cols))
    return [next(j for j in range(len(cols)) if n[j, j] == n[i, i] == n[i, j]) for i in range(len(cols))]


def _blocks(classes: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Columns in blocks of at most ``MASKS`` masks and ``CELLS`` ranks a row.

    Returns the block and the place in its block's masks of every column, and
    the first mask and the number of masks of every block.
    """
    order = {m: i for i, m in enumerate(sorted(set(classes)))}
    block, slot, first, wide, size = [0] * len(classes), [0] * len(classes), [], [], 0
    for c in sorted(range(len(classes)), key=lambda c: order[classes[c]]):
        mask = order[classes[c]]
        span = mask - first[-1] + 1 if first else 0
        if not first or span > MASKS or (size + 1) * span > CELLS:
            first.append(mask)
            wide.append(0)
            size, span = 0, 1
        size += 1
        wide[-1] = max(wide[-1], span)
        block[c], slot[c] = len(first) - 1, span - 1
    return block, slot, first, wide


def _narrow_columns(data: DataFrame, cols: Sequence[str], classes: Sequence[int], pairs: Pairs) -> list[int]:
    """Columns whose ranks under all masks asked for are few enough to be looked up, the narrowest first."""
    row = data.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    at = {c: i for i, c in enumerate(cols)}
    masks: list[set[int]] = [set() for _ in cols]
    for a, b in pairs:
        masks[at[a]].add(classes[at[b]])
        masks[at[b]].add(classes[at[a]])
    cost = [row[f"d{i}"] * len(masks[i]) for i in range(len(cols))]
    narrow, used = [], 0
    for i in sorted(range(len(cols)), key=lambda i: (cost[i], i)):
        used += cost[i]
        if used > TABLE:
            break
        narrow.append(i)
    return sorted(narrow)


def _value_counts(data: DataFrame, cols: Sequence[str], narrow: Sequence[int], masks: Sequence[int]) -> DataFrame:
    """(c, v, w0, w1, ...): rows of each value of the narrow columns, by mask of known columns."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = {c: np.empty(0) for c in narrow}
        counts = {c: np.zeros((0, len(masks)), np.int64) for c in narrow}
        for batch in batches:
            x = batch.to_numpy(dtype=float) + 0.0
            known = np.isfinite(x)
            by_mask = known[:, masks].astype(np.int32)
            for c in narrow:
                rows = np.flatnonzero(known[:, c])
                if not len(rows):
                    continue
                v = x[rows, c]
                at = np.minimum(np.searchsorted(values[c], v), max(len(values[c]) - 1, 0))
                if len(masks) == 1 and len(values[c]) and (values[c][at] == v).all():  # no new ones: nothing to sort
                    counts[c][:, 0] += np.bincount(at[known[rows, masks[0]]], minlength=len(values[c]))
                    continue
                order = rows[np.argsort(v, kind="stable")]
                v = x[order, c]
                starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                v, n = v[starts], np.add.reduceat(by_mask[order], starts, axis=0)
                every = np.union1d(values[c], v)
                if len(every) > len(values[c]):
                    grown = np.zeros((len(every), len(masks)), np.int64)
                    grown[np.searchsorted(every, values[c])] = counts[c]
                    values[c], counts[c] = every, grown
                counts[c][np.searchsorted(every, v)] += n
        for c in narrow:
            yield pd.DataFrame({"c": np.full(len(values[c]), c, np.int32), "v": values[c],
                                **{f"w{j}": counts[c][:, j] for j in range(len(masks))}})

    weights = [f"w{j}" for j in range(len(masks))]
    rows = data.mapInPandas(fold, "c int, v double, " + ", ".join(f"{w} long" for w in weights))
    return rows.groupBy("c", "v").agg(*[F.sum(w).alias(w) for w in weights])


class _Ranks:
    """Ranks of the narrow columns' values under every mask, less their mean; unknown values have zero."""

    def __init__(self, counts: pd.DataFrame, narrow: Sequence[int], masks: Sequence[int]):
        self.values, self.start, self.masks = {}, {}, list(masks)
        counts = counts.sort_values(["c", "v"])
        n = counts[[f"w{j}" for j in range(len(masks))]].to_numpy(float)
        owner, v = counts["c"].to_numpy(), counts["v"].to_numpy(float)
        # The last place is that of unknown values.
        self.table = np.zeros((len(masks), len(v) + 1))
        self.total, self.square = {}, {}
        for c in narrow:
            lo, hi = np.searchsorted(owner, [c, c + 1])
            self.values[c], self.start[c] = v[lo:hi], int(lo)
            w = n[lo:hi]
            upto, total = np.cumsum(w, axis=0), w.sum(axis=0)
            ranks = np.where(w > 0, upto - w + (w + 1) / 2 - (total + 1) / 2, 0.0)
            self.table[:, lo:hi] = ranks.T
            self.total[c], self.square[c] = total, (w * ranks * ranks).sum(axis=0)

    def places(self, x: np.ndarray, c: int) -> np.ndarray:
        """Place of every value of column ``c`` in the table."""
        if not len(self.values[c]):
            return np.full(len(x), self.table.shape[1] - 1)
        at = np.minimum(np.searchsorted(self.values[c], x), len(self.values[c]) - 1)
        return np.where(np.isfinite(x), self.start[c] + at, self.table.shape[1] - 1)


def _looked_up_sums(data: DataFrame, ranks: _Ranks, classes: Sequence[int], wanted: list[tuple[int, int, int]]) -> DataFrame:
    """Sums of (pair, column a, column b) of narrow columns: ranks are looked up row by row, no row is shuffled."""
    at = {m: j for j, m in enumerate(ranks.masks)}
    used = sorted({c for _, a, b in wanted for c in (a, b)})
    tiles: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i, a, b in wanted:
        tiles.setdefault((classes[a], classes[b]), []).append((i, a, b))
    plan = []
    for (p, q), members in tiles.items():
        left, right = sorted({a for _, a, _ in members}), sorted({b for _, _, b in members})
        plan.append((at[p], at[q], left, right, [m[0] for m in members],
                     [left.index(m[1]) for m in members], [right.index(m[2]) for m in members]))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((len(left), len(right))) for _, _, left, right, *_ in plan]
        for batch in batches:
            x = batch.to_numpy(dtype=float) + 0.0
            places = {c: ranks.places(x[:, c], c) for c in used}
            for total, (p, q, left, right, *_) in zip(sums, plan, strict=True):
                a = np.stack([ranks.table[q][places[c]] for c in left])
                b = np.stack([ranks.table[p][places[c]] for c in right], axis=1)
                total += a @ b
        for total, (p, q, left, right, ids, i, j) in zip(sums, plan, strict=True):
            yield pd.DataFrame({"i": ids, "p": total[i, j]})

    # What one column alone decides is in the counts: n and the squares.
    alone = pd.DataFrame([(i, ranks.total[a][at[classes[b]]], 0.0, 0.0, ranks.square[a][at[classes[b]]], ranks.square[b][at[classes[a]]])
                          for i, a, b in wanted], columns=["i", *_SUMS[:5]])
    products = data.mapInPandas(fold, "i int, p double").groupBy("i").agg(F.sum("p").alias("p"))
    known = data.sparkSession.createDataFrame(alone, "i int, n double, sa double, sb double, qa double, qb double")
    return known.join(products, "i", "left").select("i", "n", "sa", "sb", "qa", "qb", F.coalesce("p", F.lit(0.0)).alias("p"))


def _half_looked_up_sums(data: DataFrame, ranks: _Ranks, classes: Sequence[int], wanted: list[tuple[int, int, int]]) -> DataFrame:
    """Sums of (pair, wide column, narrow column).

    A value of the wide column has one rank, so its rows fold map-side to their
    number and the sum of their looked-up ranks; only distinct values are placed.
    """
    at = {m: j for j, m in enumerate(ranks.masks)}
    partners: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in wanted:
        partners.setdefault(a, []).append((i, b))
    blocks = [(a, members[k:k + MASKS]) for a, members in partners.items() for k in range(0, len(members), MASKS)]
    size = max(len(members) for _, members in blocks)
    names = [f"{k}{j}" for j in range(size) for k in "ws"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch.to_numpy(dtype=float) + 0.0
            places = {b: ranks.places(x[:, b], b) for _, members in blocks for _, b in members}
            for k, (a, members) in enumerate(blocks):
                rows = np.flatnonzero(np.isfinite(x[:, a]))
                out = {"k": np.full(len(rows), k, np.int32), "v": x[rows, a], **{n: np.zeros(len(rows)) for n in names}}
                for j, (_, b) in enumerate(members):
                    out[f"w{j}"] = np.isfinite(x[rows, b]).astype(float)
                    out[f"s{j}"] = ranks.table[at[classes[a]]][places[b][rows]]
                yield pd.DataFrame(out)

    rows = data.mapInPandas(look, "k int, v double, " + ", ".join(f"{n} double" for n in names))
    counts = rows.groupBy(F.struct("k").alias("_key"), F.col("v").alias("_v")).agg(*[F.sum(n).alias(n) for n in names])
    weights = [f"w{j}" for j in range(size)]
    placed = value_positions(counts, "_v", weights)
    parts = []
    for j in range(size):
        w = F.col(f"w{j}")
        rank = F.when(w > 0, F.col(f"w{j}_before") + (w + 1) / 2 - (F.col(f"w{j}_total") + 1) / 2).otherwise(F.lit(0.0))
        parts += [F.sum(w).alias(f"n{j}"), F.sum(w * rank * rank).alias(f"qa{j}"), F.sum(rank * F.col(f"s{j}")).alias(f"p{j}")]
    zero = F.lit(0.0)
    sums = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"n{j}").alias("n"), zero.alias("sa"), zero.alias("sb"),
                              F.col(f"qa{j}").alias("qa"), F.col(f"p{j}").alias("p")) for j in range(size)])
    folded = placed.groupBy(F.col("_key.k").alias("k")).agg(*parts).select("k", F.inline(sums))
    names_of = data.sparkSession.createDataFrame(
        [(k, j, i, float(ranks.square[b][at[classes[a]]])) for k, (a, members) in enumerate(blocks) for j, (i, b) in enumerate(members)],
        "k int, j int, i int, qb double")
    return folded.join(names_of, ["k", "j"]).select("i", "n", "sa", "sb", "qa", "qb", "p")


def spearman_pairs(df: DataFrame, pairs: Pairs, out: str = "spearman_rho") -> DataFrame:
    """Spearman rho of the named pairs, ranked on each pair's complete rows.

    A value has one average rank per set of rows (mask) it is ranked on; columns
    that are known on the same rows share a mask.  Columns of few distinct values
    (narrow: their ranks under all masks fit in ``TABLE``) have their ranks looked
    up in the tasks, which fold the rows to sums without shuffling them.  A pair
    with one narrow column folds to the values of the other.  Pairs of two other
    columns return their ranks to the rows (``_shuffled_sums``).
    """
    cols, left, right = _indices(pairs)
    # Stored: read more than once, and the row numbers must not change when a lost task is run again.
    with short_methods(df.sparkSession):
        data = stored(finite(df, cols).withColumn("_row", F.monotonically_increasing_id()), "columns")
    values = data.select(*cols)
    classes = _known_classes(values, cols)
    narrow = _narrow_columns(values, cols, classes, pairs)
    sums, few = [], set(narrow)
    both = [(i, a, b) for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)) if a in few and b in few]
    half = [(i, a, b) if b in few else (i, b, a) for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))
            if (a in few) != (b in few)]
    if both or half:
        ship(df.sparkSession)
        masks = sorted(set(classes))
        ranks = _Ranks(_value_counts(values, cols, narrow, masks).toPandas(), narrow, masks)
        sums += [_looked_up_sums(values, ranks, classes, both)] if both else []
        sums += [_half_looked_up_sums(values, ranks, classes, half)] if half else []
    rest = [i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)) if a not in few and b not in few]
    if rest:
        where = data.sparkSession.createDataFrame(list(enumerate(rest)), "i int, at int")
        sums.append(_shuffled_sums(data, [pairs[i] for i in rest]).join(where, "i").select(F.col("at").alias("i"), *_SUMS))
    return _r_of_sums(reduce(DataFrame.unionByName, sums), pairs, out)


def _shuffled_sums(data: DataFrame, pairs: Pairs) -> DataFrame:
    """Sums of pairs of columns of any number of values.

    All columns are ranked together in long form (column, value), so the plan
    does not grow with their number.  Masks come in blocks: a value is counted and ranked for one block
    of masks at a time, and the ranks go back to their rows tile by tile, a tile
    being the columns of two blocks.  So no row ever holds a rank for every
    column and mask, and a batch holds at most ``CELLS`` ranks a row.
    """
    cols, left, right = _indices(pairs)
    classes = _known_classes(data.select(*cols), cols)
    masks = sorted(set(classes))
    block, slot, first, wide = map(np.array, _blocks(classes))
    weights = [f"w{i}" for i in range(int(max(wide, default=0)))]
    asked: dict[int, set[int]] = {}
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        asked.setdefault(a, set()).add(int(block[b]))
        asked.setdefault(b, set()).add(int(block[a]))

    def constant(values) -> Column:
        return F.array(*[F.lit(int(v)) for v in values])

    at = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)])
    wanted = F.array(*[constant(sorted(asked[i])) for i in range(len(cols))])
    marked = data.withColumn("_known", F.array(*[F.col(cols[m]).isNotNull().cast("byte") for m in masks]))
    long = (marked.unpivot(["_row", "_known"], list(cols), "_name", "_v").where(F.col("_v").isNotNull())
            .select("_row", F.element_at(at, F.col("_name")).alias("_c"), (F.col("_v") + 0.0).alias("_v"), "_known")
            .select("*", F.explode(F.get(wanted, "_c")).alias("_b")))
    known = F.slice("_known", F.get(constant(first), "_b") + 1, len(weights))
    counts = long.select("_c", "_b", "_v", known.alias("_known")).withColumn("_key", F.struct("_c", "_b")).groupBy("_key", "_v").agg(
        *[F.sum(F.coalesce(F.get("_known", F.lit(i)), F.lit(0))).alias(w) for i, w in enumerate(weights)])
    placed = value_positions(counts, "_v", weights).select(
        F.col("_key._c").alias("_c"), F.col("_key._b").alias("_b"), "_v",
        F.array(*[F.col(f"{w}_before") + (F.col(w) + 1) / 2 for w in weights]).alias("_ranks"))
    own = F.get(constant(block), "_c")
    ranked = (long.select("_row", "_c", "_b", "_v").join(placed, ["_c", "_b", "_v"])
              .groupBy("_row", F.least("_b", own).alias("_lo"), F.greatest("_b", own).alias("_hi"))
              .agg(F.collect_list("_c").alias("cs"), F.flatten(F.collect_list("_ranks")).alias("ranks")))
    tiles: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        tiles.setdefault((min(int(block[a]), int(block[b])), max(int(block[a]), int(block[b]))), []).append(i)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {c: np.zeros(len(left)) for c in _SUMS}
        for batch in batches:
            for (lo, hi), part in batch.groupby(["_lo", "_hi"], sort=False):
                here = np.array(tiles[lo, hi])
                members = np.flatnonzero((block == lo) | (block == hi))
                local = np.zeros(len(cols), int)
                local[members] = np.arange(len(members))
                step = max(1, TENSOR // (len(members) * len(weights)))
                for start in range(0, len(part), step):
                    rows = part.iloc[start:start + step]
                    sizes = rows["cs"].map(len).to_numpy()
                    row, col = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows["cs"].to_numpy())
                    ranks = np.full((len(rows), len(members), len(weights)), np.nan)
                    ranks[row, local[col]] = np.concatenate(rows["ranks"].to_numpy()).reshape(-1, len(weights))
                    for some in np.array_split(here, -(-len(here) // 256)):
                        a, b = left[some], right[some]
                        x, y = ranks[:, local[a], slot[b]], ranks[:, local[b], slot[a]]
                        both = np.isfinite(x) & np.isfinite(y)
                        x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
                        for name, value in zip(_SUMS, (both, x, y, x * x, y * y, x * y), strict=True):
                            sums[name][some] += value.sum(0)
        yield pd.DataFrame({"i": np.arange(len(left)), **sums})

    return ranked.select("_lo", "_hi", "cs", "ranks").mapInPandas(fold, "i int, n double, sa double, sb double, qa double, qb double, p double")


def pairwise_spearman(df: DataFrame, cols: Sequence[str], out: str = "spearman_rho") -> DataFrame:
    """Every pair of columns, a before b in the given order."""
    return spearman_pairs(df, list(combinations(cols, 2)), out)


def within_group_pearson(df: DataFrame, cols: Sequence[str], group: str = "participant_id") -> DataFrame:
    """Pearson r after subtracting group means: the within-person signal."""
    numeric = finite(df, cols, group)
    return pairwise_pearson(demean_within(numeric, cols, group), cols, "within_r")


def pooled_vs_within(df: DataFrame, cols: Sequence[str], group: str = "participant_id") -> DataFrame:
    """Pooled and within-group r side by side."""
    pooled = pairwise_pearson(df, cols, "pooled_r")
    within = within_group_pearson(df, cols, group).drop("n")
    return pooled.join(within, ["var_a", "var_b"]).withColumn(
        "flips", F.coalesce(F.signum("pooled_r") * F.signum("within_r") < 0, F.lit(False)))


def strong_pairs(pearson: DataFrame, spearman: DataFrame, min_abs: float = 0.6) -> DataFrame:
    """Pairs with |r| >= ``min_abs`` with rho, n and p, strongest first."""
    strong = pearson.where(F.abs("pearson_r") >= min_abs)
    joined = with_p_values(strong).join(spearman.select("var_a", "var_b", "spearman_rho"),
                                        ["var_a", "var_b"], "left")
    return (joined.orderBy(F.abs("pearson_r").desc(), "var_a", "var_b")
            .select("var_a", "var_b", F.round("pearson_r", 3).alias("pearson_r"),
                    F.round("spearman_rho", 3).alias("spearman_rho"), "n", "p"))


def redundancy_groups(pairs: DataFrame, cols: Sequence[str], threshold: float = 0.8,
                      rho: str = "spearman_rho") -> DataFrame:
    """Groups of columns that average linkage joins below distance 1 - threshold.

    The distance is 1 - |rho| (unknown counts as no correlation).  The pair
    table has one row per pair of columns, so it is small by construction.
    """
    cols = list(cols)
    at = {c: i for i, c in enumerate(cols)}
    distance = np.ones((len(cols), len(cols)))
    for row in pairs.select("var_a", "var_b", rho).collect():
        value = 1.0 - abs(row[rho]) if row[rho] is not None else 1.0
        distance[at[row["var_a"]], at[row["var_b"]]] = distance[at[row["var_b"]], at[row["var_a"]]] = value
    groups = _average_linkage(distance, 1.0 - threshold)
    members = sorted((sorted(cols[i] for i in g) for g in groups if len(g) > 1), key=lambda g: (-len(g), g))
    rows = [(threshold, i + 1, len(g), ";".join(g)) for i, g in enumerate(members)]
    return pairs.sparkSession.createDataFrame(rows, "threshold double, group_no int, size int, members string")


def _average_linkage(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Merge the closest clusters by mean distance until none is within ``cut``."""
    clusters = [[i] for i in range(len(distance))]
    d = distance.copy()
    np.fill_diagonal(d, np.inf)
    alive = np.ones(len(d), dtype=bool)
    while alive.sum() > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut + 1e-12:
            break
        i, j = min(i, j), max(i, j)
        wi, wj = len(clusters[i]), len(clusters[j])
        merged = (wi * d[i] + wj * d[j]) / (wi + wj)
        clusters[i] += clusters[j]
        d[i], d[:, i] = merged, merged
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        alive[j] = False
    return [c for c, keep in zip(clusters, alive) if keep]


def swept_r2(matrix: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """R^2 of every column of a correlation matrix on all the others, by one pass of the sweep operator.

    Each column is swept in turn; one whose pivot is gone is a combination of
    those swept before, and so is each of these that has a share in it: their
    R^2 is one.  For the other columns the swept matrix has the inverse on its
    diagonal.  The cost is that of one inverse.
    """
    a, k = matrix.astype(float).copy(), len(matrix)
    free = []
    for j in range(k):
        pivot = a[j, j]
        if pivot <= tolerance:
            continue
        free.append(j)
        row, column = a[j] / pivot, a[:, j].copy()
        a -= np.outer(column, row)
        a[j], a[:, j], a[j, j] = row, column / pivot, -1.0 / pivot
    bound = [j for j in range(k) if j not in set(free)]
    r2 = np.ones(k)
    for j in free:
        if not np.any(np.abs(a[j, bound]) > 1e-9):
            r2[j] = 1.0 + 1.0 / a[j, j]
    return r2


def _inflation(matrix: np.ndarray) -> list[tuple[float, float]]:
    """(inflation, R^2) of every column; infinite where a column is explained."""
    return [(float("inf") if r2 >= 1.0 - 1e-12 else round(1.0 / (1.0 - r2), 2), round(r2, 4)) for r2 in swept_r2(matrix).tolist()]


def _complete_moments(df: DataFrame, cores: Sequence[Sequence[str]], centre: dict[str, float]) -> list[np.ndarray]:
    """For each list of columns the moments (one, columns) of its complete rows, centred, in one scan."""
    cols = list(dict.fromkeys(c for core in cores for c in core))
    members = [np.array([cols.index(c) for c in core], int) for core in cores]
    middle = np.array([centre[c] for c in cols])
    sizes = [len(m) + 1 for m in members]
    starts = np.cumsum([0] + [s * s for s in sizes])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((s, s)) for s in sizes]
        for batch in batches:
            x = batch.to_numpy(dtype=float) - middle
            for which, total in zip(members, sums, strict=True):
                rows = x[:, which][np.isfinite(x[:, which]).all(axis=1)]
                ones = np.hstack([np.ones((len(rows), 1)), rows])
                total += ones.T @ ones
        yield pd.DataFrame({"i": np.arange(starts[-1]), "v": np.concatenate([s.ravel() for s in sums])})

    # One number per pair of columns and list.
    found = finite(df, cols).mapInPandas(fold, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(starts[-1])
    for row in found:
        flat[row["i"]] = row["v"]
    return [flat[a:b].reshape(s, s) for a, b, s in zip(starts[:-1], starts[1:], sizes, strict=True)]


def _correlations(moments: np.ndarray) -> np.ndarray:
    """Correlation matrix of centred moments; a constant column correlates with nothing."""
    n, sums = max(moments[0, 0], 1.0), moments[0, 1:]
    spread = moments[1:, 1:] - np.outer(sums, sums) / n
    size = np.where(np.diag(spread) > 1e-12 * np.diag(moments[1:, 1:]), np.diag(spread), np.inf)
    out = spread / np.sqrt(np.outer(size, size))
    np.fill_diagonal(out, 1.0)
    return out


def core_vifs(df: DataFrame, cols: Sequence[str], coverages: Sequence[float] = (1.0, 0.95), min_rows: int = MIN_COMPLETE_ROWS) -> DataFrame:
    """``core_vif`` for several least coverages from two scans: one for coverage and means, one for all moments."""
    data = finite(df, cols)
    row = data.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"{name}_{c}") for c in cols for name, f in (("n", F.count), ("m", F.avg))]).first()
    cores = [[c for c in cols if row["_n"] and row[f"n_{c}"] / row["_n"] >= share] for share in coverages]
    moments = _complete_moments(data, cores, {c: row[f"m_{c}"] or 0.0 for c in cols}) if any(cores) else [np.zeros((1, 1))] * len(cores)
    rows = []
    for share, core, moment in zip(coverages, cores, moments, strict=True):
        n = int(moment[0, 0])
        if len(core) >= 2 and n >= min_rows:
            rows += [(share, c, v, r2, n, "ok") for c, (v, r2) in zip(core, _inflation(_correlations(moment)), strict=True)]
        else:
            status = "too few columns" if len(core) < 2 else "too few rows"
            rows += [(share, c, None, None, n, status) for c in cols]
    return df.sparkSession.createDataFrame(rows, "min_coverage double, column string, vif double, r2_vs_rest double, n int, status string")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation of each column on the others, over complete rows.

    Spark computes the k x k moments; R^2 of all columns follows from one sweep
    of that matrix.  A perfectly explained column has infinite inflation.
    """
    cols = list(cols)
    means = finite(df, cols).dropna().agg(*[F.avg(c).alias(c) for c in cols]).first()
    moments = _complete_moments(df, [cols], {c: means[c] or 0.0 for c in cols})[0]
    rows = [(c, v, r2) for c, (v, r2) in zip(cols, _inflation(_correlations(moments)), strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, r2_vs_rest double").orderBy(
        F.desc("vif"), "column")


def core_subset(df: DataFrame, cols: Sequence[str], min_cov: float) -> DataFrame:
    """Complete rows of the columns known on a share of at least ``min_cov`` of the rows."""
    core = covered_columns(df, cols, min_cov)
    return complete_cases(df, core, min_cov)


def core_vif(df: DataFrame, cols: Sequence[str], min_cov: float, min_rows: int = MIN_COMPLETE_ROWS) -> DataFrame:
    """``vif`` of the core subset with a status; too few rows or columns give rows without numbers."""
    core = covered_columns(df, cols, min_cov)
    cases = complete_cases(df, core, min_cov)
    n = cases.count()
    if len(core) >= 2 and n >= min_rows:
        return vif(cases, core).withColumns({"n": F.lit(n), "status": F.lit("ok")})
    status = "too few columns" if len(core) < 2 else "too few rows"
    return df.sparkSession.createDataFrame([(c, None, None, n, status) for c in cols],
                                           "column string, vif double, r2_vs_rest double, n int, status string")


def _y_where(i: int) -> Column:
    return F.when(F.col(f"_x{i}").isNotNull(), F.col("_y"))


def binned_mi(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of equal-width bins of each column and the label.

    A contingency estimate: it ranks like the nearest-neighbour estimator but
    has other values, hence the name ``mi_binned``.
    """
    cols = list(cols)
    data = finite(df.select(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(cols)], F.col(label).alias("_y")),
                  [*[f"_x{i}" for i in range(len(cols))], "_y"]).where(F.col("_y").isNotNull())
    # The ranges are one row, so the values are placed where they are read and only cells are shuffled.
    spans = data.agg(*[f(v).alias(f"{n}{i}") for i in range(len(cols))
                       for v, f, n in ((f"_x{i}", F.min, "lo"), (f"_x{i}", F.max, "hi"), (_y_where(i), F.min, "ylo"), (_y_where(i), F.max, "yhi"))]).first()

    def place(x: str, lo: float | None, hi: float | None) -> Column:
        width = None if lo is None else (hi - lo) / bins
        if not width:
            return F.lit(0).cast("long")
        return F.coalesce(F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)), F.lit(0))

    placed = [F.when(F.col(f"_x{i}").isNotNull(), F.struct(
        F.lit(c).alias("column"), place(f"_x{i}", spans[f"lo{i}"], spans[f"hi{i}"]).alias("bx"),
        place("_y", spans[f"ylo{i}"], spans[f"yhi{i}"]).alias("by"))) for i, c in enumerate(cols)]
    cells = (data.select(F.explode(F.array(*placed)).alias("_c")).where(F.col("_c").isNotNull()).select("_c.*")
             .groupBy("column", "bx", "by").agg(F.count("*").alias("nxy")))
    nx = cells.groupBy("column", "bx").agg(F.sum("nxy").alias("nx"))
    ny = cells.groupBy("column", "by").agg(F.sum("nxy").alias("ny"))
    n = cells.groupBy("column").agg(F.sum("nxy").alias("n"))
    table = cells.join(nx, ["column", "bx"]).join(ny, ["column", "by"]).join(n, "column")
    p = F.col("nxy") / F.col("n")
    gain = p * F.ln(F.col("nxy") * F.col("n").cast("double") / (F.col("nx").cast("double") * F.col("ny")))
    return table.groupBy("column").agg(F.greatest(F.sum(gain), F.lit(0.0)).alias("mi_binned"),
                                       F.max("n").alias("n"))


def label_relevance(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """r, p, rho, n and binned information of each column against the label."""
    known = finite(df, [*cols, label]).where(F.col(label).isNotNull())
    pairs = [(c, label) for c in cols]
    pearson = with_p_values(pearson_pairs(known, pairs))
    spearman = spearman_pairs(known, pairs).drop("n")
    out = (pearson.join(spearman, ["var_a", "var_b"])
           .join(binned_mi(known, cols, label, bins).drop("n").withColumnRenamed("column", "var_a"), "var_a", "left"))
    return (out.select(F.col("var_a").alias("column"), "pearson_r", F.col("p").alias("pearson_p"),
                       "spearman_rho", "n", "mi_binned", F.abs("spearman_rho").alias("abs_spearman"))
            .orderBy(F.desc_nulls_last("abs_spearman"), "column"))
