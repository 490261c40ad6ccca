"""Correlation, redundancy, collinearity and relevance."""

from itertools import combinations

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.registry import query
from daygrain.operators import correlation as K
from daygrain.operators.information import neighbour_mi

rnd = B.rnd
COLS = ["qty", "price", "disc", "tax"]
# Quantity is unknown on first lines and the discount on every line of some status.
DATA_SQL = """x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS participant_id, l_extendedprice AS price, l_tax AS tax,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS qty,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN NULL ELSE l_discount END AS disc,
    l_linenumber::DOUBLE AS line FROM lineitem)"""


def data(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("participant_id"), F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("qty"),
        F.when(~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")), F.col("l_discount")).alias("disc"),
        F.col("l_linenumber").cast("double").alias("line"))


def each_pair(template: str, cols=COLS) -> str:
    return " UNION ALL ".join(template.format(a=a, b=b) for a, b in combinations(cols, 2))


def tidy(df, *cols, digits=6):
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query("numeric_screen", """SELECT c AS name, w AS verdict FROM (SELECT unnest(['price', 'tax', 'qty', 'one', 'participant_id']) AS c,
    unnest(['kept', 'kept', 'kept', 'zero_variance', 'non_numeric']) AS w) WHERE (SELECT count(*) FROM lineitem) > 0""")
def numeric_screen(spark, sf_dir):
    rows = data(spark, sf_dir).withColumn("one", F.lit(1))
    kept, dropped = K.numeric_screen(rows, ["price", "tax", "qty", "one", "participant_id"])
    verdicts = [(c, "kept") for c in kept] + [(c, why) for why, cols in dropped.items() for c in cols]
    return spark.createDataFrame(verdicts, "name string, verdict string")


@query("pairwise_pearson", f"WITH {DATA_SQL} " + each_pair(
    "SELECT '{a}' AS var_a, '{b}' AS var_b, " + rnd("corr({a}, {b})", 6) + " + 0.0::DOUBLE AS pearson_r, count(*) FILTER "
    "({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM x"))
def pairwise_pearson(spark, sf_dir):
    return tidy(K.pairwise_pearson(data(spark, sf_dir), COLS), "pearson_r")


@query("pairwise_pearson_one_scan", f"WITH {DATA_SQL} " + each_pair(
    "SELECT '{a}' AS var_a, '{b}' AS var_b, " + rnd("corr({a}, {b})", 6) + " + 0.0::DOUBLE AS pearson_r, count(*) FILTER "
    "({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM x"))
def pairwise_pearson_one_scan(spark, sf_dir):
    return tidy(K.pearson_pairs(data(spark, sf_dir), list(combinations(COLS, 2))), "pearson_r")


@query("pairwise_p_values")
def pairwise_p_values(spark, sf_dir):
    return K.with_p_values(K.pairwise_pearson(data(spark, sf_dir), COLS))


SPEARMAN_PAIR = ("SELECT '{a}' AS var_a, '{b}' AS var_b, " + rnd("corr(ra, rb)", 6) + " + 0.0::DOUBLE AS spearman_rho, count(*) AS n FROM "
                 "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
                 "rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
                 "FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("pairwise_spearman", f"WITH {DATA_SQL} " + each_pair(SPEARMAN_PAIR))
def pairwise_spearman(spark, sf_dir):
    return tidy(K.pairwise_spearman(data(spark, sf_dir), COLS), "spearman_rho")


DEMEANED_SQL = DATA_SQL + ", y AS (SELECT " + ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY participant_id) AS {c}" for c in COLS) + " FROM x)"


@query("within_group_pearson", f"WITH {DEMEANED_SQL} " + each_pair(
    "SELECT '{a}' AS var_a, '{b}' AS var_b, " + rnd("corr({a}, {b})", 6) + " + 0.0::DOUBLE AS within_r, count(*) FILTER "
    "({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM y"))
def within_group_pearson(spark, sf_dir):
    return tidy(K.within_group_pearson(data(spark, sf_dir), COLS), "within_r")


@query("pooled_vs_within", f"WITH {DEMEANED_SQL}, p AS ({each_pair('SELECT ' + chr(39) + '{a}' + chr(39) + ' AS var_a, ' + chr(39) + '{b}' + chr(39) + ' AS var_b, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS corr_count FROM x')}), "
       f"w AS ({each_pair('SELECT ' + chr(39) + '{a}' + chr(39) + ' AS var_a, ' + chr(39) + '{b}' + chr(39) + ' AS var_b, corr({a}, {b}) AS r FROM y')}) "
       f"SELECT var_a, var_b, {rnd('p.r', 6)} + 0.0::DOUBLE AS pooled_r, {rnd('w.r', 6)} + 0.0::DOUBLE AS within_r, corr_count AS n, "
       f"coalesce(sign(p.r) * sign(w.r) < 0, false) AS flips FROM p JOIN w USING (var_a, var_b)")
def pooled_vs_within(spark, sf_dir):
    return tidy(K.pooled_vs_within(data(spark, sf_dir), COLS), "pooled_r", "within_r")


# Three clearly related columns next to an unrelated one.
RELATED_SQL = """x AS (SELECT p_size::DOUBLE AS size, p_size * 2.0 + p_partkey % 3 AS twice, -p_size * 1.0 + p_partkey % 5 AS minus,
    p_partkey % 7 AS other FROM part)"""


def related(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    return B.table(spark, sf_dir, "part").select(
        size.alias("size"), (size * 2 + key % 3).alias("twice"), (key % 5 - size).alias("minus"), (key % 7).cast("double").alias("other"))


@query("strong_pairs", f"WITH {RELATED_SQL}, r AS (" + each_pair(
    "SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r, count(*) AS n FROM x", ["size", "twice", "minus", "other"]) + "), s AS ("
    + each_pair(SPEARMAN_PAIR, ["size", "twice", "minus", "other"]) + f""")
    SELECT var_a, var_b, {rnd('r', 3)} AS pearson_r, {rnd('spearman_rho', 3)} AS spearman_rho, r.n AS n FROM r JOIN s USING (var_a, var_b)
    WHERE abs(r) >= 0.6""")
def strong_pairs(spark, sf_dir):
    cols = ["size", "twice", "minus", "other"]
    rows = related(spark, sf_dir)
    return K.strong_pairs(K.pairwise_pearson(rows, cols), K.pairwise_spearman(rows, cols)).drop("p")


@query("redundancy_groups", f"WITH {RELATED_SQL}, s AS (" + each_pair(SPEARMAN_PAIR, ["size", "twice", "minus", "other"]) + """),
    m AS (SELECT var_a AS c FROM s WHERE abs(spearman_rho) >= 0.9 UNION SELECT var_b FROM s WHERE abs(spearman_rho) >= 0.9)
    SELECT 0.9::DOUBLE AS threshold, 1 AS group_no, CAST(count(*) AS INTEGER) AS size, string_agg(c, ';' ORDER BY c) AS members FROM m""")
def redundancy_groups(spark, sf_dir):
    cols = ["size", "twice", "minus", "other"]
    return K.redundancy_groups(K.pairwise_spearman(related(spark, sf_dir), cols), cols, 0.9)


@query("variance_inflation", f"""WITH {RELATED_SQL},
    r AS (SELECT corr(size, twice) AS ab, corr(size, other) AS ac, corr(twice, other) AS bc FROM x),
    s AS (SELECT 'size' AS "column", (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc) AS r2 FROM r
        UNION ALL SELECT 'twice', (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac) FROM r
        UNION ALL SELECT 'other', (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab) FROM r)
    SELECT "column", {rnd('(1 / (1 - r2))', 2)} AS vif, {rnd('r2', 4)} AS r2_vs_rest FROM s""")
def variance_inflation(spark, sf_dir):
    return K.vif(related(spark, sf_dir), ["size", "twice", "other"])


@query("core_inflation_by_coverage", f"""WITH {RELATED_SQL},
    y AS (SELECT size, twice, CASE WHEN p_partkey % 20 <> 0 THEN (p_partkey % 7)::DOUBLE END AS other
          FROM (SELECT p_size::DOUBLE AS size, p_size * 2.0 + p_partkey % 3 AS twice, p_partkey FROM part)),
    one AS (SELECT corr(size, twice) AS ab, count(*) AS n FROM y),
    r AS (SELECT corr(size, twice) AS ab, corr(size, other) AS ac, corr(twice, other) AS bc, count(*) AS n FROM y WHERE other IS NOT NULL),
    s AS (SELECT 1.0::DOUBLE AS min_coverage, c AS "column", ab * ab AS r2, n FROM one, (SELECT unnest(['size', 'twice']) AS c)
        UNION ALL SELECT 0.9, 'size', (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc), n FROM r
        UNION ALL SELECT 0.9, 'twice', (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac), n FROM r
        UNION ALL SELECT 0.9, 'other', (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab), n FROM r)
    SELECT min_coverage, "column", {rnd('(1 / (1 - r2))', 2)} AS vif, {rnd('r2', 4)} AS r2_vs_rest, CAST(n AS INTEGER) AS n, 'ok' AS status FROM s""")
def core_inflation_by_coverage(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    rows = B.table(spark, sf_dir, "part").select(size.alias("size"), (size * 2 + key % 3).alias("twice"),
                                                 F.when(key % 20 != 0, (key % 7).cast("double")).alias("other"))
    return K.core_vifs(rows, ["size", "twice", "other"], (1.0, 0.9))


@query("core_subset", f"WITH {DATA_SQL} SELECT price, tax FROM x")
def core_subset(spark, sf_dir):
    return K.core_subset(data(spark, sf_dir), ["price", "tax", "qty", "disc"], 1.0)


@query("core_subset_inflation", f"""WITH {RELATED_SQL}, r AS (SELECT corr(size, twice) AS ab FROM x)
    SELECT c AS "column", {rnd('(1 / (1 - ab * ab))', 2)} AS vif, {rnd('ab * ab', 4)} AS r2_vs_rest,
        (SELECT CAST(count(*) AS INTEGER) FROM part) AS n, 'ok' AS status FROM (SELECT unnest(['size', 'twice']) AS c), r""")
def core_subset_inflation(spark, sf_dir):
    return K.core_vif(related(spark, sf_dir), ["size", "twice"], 1.0)


# Quantities and prices with values that are no finite numbers.
ODD_SQL = """x AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS qty,
    CASE WHEN l_linenumber = 2 THEN NULL ELSE l_extendedprice END AS price, l_tax AS tax FROM lineitem)"""


def odd_data(spark, sf_dir):
    line = F.col("l_linenumber")
    return B.table(spark, sf_dir, "lineitem").select(
        F.when(line == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(line == 2, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("price"), F.col("l_tax").alias("tax"))


@query("pearson_of_odd_values", f"WITH {ODD_SQL} " + each_pair(
    "SELECT '{a}' AS var_a, '{b}' AS var_b, " + rnd("corr({a}, {b})", 6) + " + 0.0::DOUBLE AS pearson_r, count(*) FILTER "
    "({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM x", ["qty", "price", "tax"]))
def pearson_of_odd_values(spark, sf_dir):
    return tidy(K.pairwise_pearson(odd_data(spark, sf_dir), ["qty", "price", "tax"]), "pearson_r")


@query("spearman_of_odd_values", f"WITH {ODD_SQL} " + each_pair(SPEARMAN_PAIR, ["qty", "price", "tax"]))
def spearman_of_odd_values(spark, sf_dir):
    return tidy(K.pairwise_spearman(odd_data(spark, sf_dir), ["qty", "price", "tax"]), "spearman_rho")


@query("spearman_of_a_hundred_columns")
def spearman_of_a_hundred_columns(spark, sf_dir):
    """All 4,950 pairs; what SQL would need a query each for is checked on the four-column twin."""
    cols = [f"c{i}" for i in range(100)]
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    rows = B.table(spark, sf_dir, "lineitem").select(
        *[((key * (i + 3) + line * (i * i + 1)) % 101).cast("double").alias(c) for i, c in enumerate(cols)])
    return tidy(K.pairwise_spearman(rows, cols), "spearman_rho")


# A hundred columns of the customers, each unknown on other rows; a few of the 4,950 pairs have a twin.
PATTERN_PAIRS = ((0, 1), (0, 99), (17, 42), (16, 15), (50, 98), (63, 64))
PATTERN_SQL = "x AS (SELECT " + ", ".join(
    f"CASE WHEN (c_custkey * {2 * i + 3}) % {7 + i} = 0 THEN NULL ELSE ((c_custkey * {i + 3} + c_nationkey * {i * i + 1}) % 101)::DOUBLE END AS c{i}"
    for i in sorted({i for p in PATTERN_PAIRS for i in p})) + " FROM customer)"


def patterns(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return B.table(spark, sf_dir, "customer").select(*[
        F.when((key * (2 * i + 3)) % (7 + i) != 0, ((key * (i + 3) + nation * (i * i + 1)) % 101).cast("double")).alias(f"c{i}")
        for i in range(100)])


@query("spearman_of_a_hundred_patterns", f"WITH {PATTERN_SQL} " + " UNION ALL ".join(
    SPEARMAN_PAIR.format(a=f"c{min(p)}", b=f"c{max(p)}") for p in PATTERN_PAIRS))
def spearman_of_a_hundred_patterns(spark, sf_dir):
    """All 4,950 pairs are ranked; those with a twin are shown."""
    out = K.pairwise_spearman(patterns(spark, sf_dir), [f"c{i}" for i in range(100)])
    shown = [F.struct(F.lit(f"c{min(p)}"), F.lit(f"c{max(p)}")) for p in PATTERN_PAIRS]
    return tidy(out.where(F.struct("var_a", "var_b").isin(shown)), "spearman_rho")


def mi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum(nxy::DOUBLE / n * ln(nxy::DOUBLE * n / (nx::DOUBLE * ny))) AS mi FROM (
        SELECT bx, byy, count(*) AS nxy, sum(count(*)) OVER (PARTITION BY bx) AS nx, sum(count(*)) OVER (PARTITION BY byy) AS ny,
            sum(count(*)) OVER () AS n FROM (
            SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS bx, least(floor((line - ylo) / ((yhi - ylo) / 10)), 9) AS byy
            FROM (SELECT {c}, line, min({c}) OVER () AS lo, max({c}) OVER () AS hi, min(line) OVER () AS ylo, max(line) OVER () AS yhi
                  FROM x WHERE {c} IS NOT NULL)) GROUP BY 1, 2)"""


@query("binned_mutual_information", f"WITH {DATA_SQL}, m AS (" + " UNION ALL ".join(mi_sql(c) for c in ("price", "qty", "disc"))
       + f") SELECT \"column\", {rnd('greatest(mi, 0)', 6)} AS mi_binned FROM m")
def binned_mutual_information(spark, sf_dir):
    return tidy(K.binned_mi(data(spark, sf_dir), ["price", "qty", "disc"], "line"), "mi_binned").drop("n")


def neighbour_mi_sql(c: str) -> str:
    """All pairs of the labelled parts."""
    return f"""SELECT '{c}' AS "column", (SELECT h FROM psi WHERE m = max(d.n)) + avg(pk.h - pa.h - pb.h) AS mi, max(d.n) AS n FROM (
        SELECT s.i, any_value(s.n) AS n, any_value(CASE WHEN same > 3 THEN same ELSE 3 END) AS ties,
            count(*) FILTER (abs(t.x - s.x) <= r + 1e-13) AS a, count(*) FILTER (abs(t.y - s.y) <= r + 1e-13) AS b
        FROM (SELECT p.i, any_value(p.x) AS x, any_value(p.y) AS y, count(*) + 1 AS n,
                  count(*) FILTER (q.x = p.x AND q.y = p.y) + 1 AS same,
                  min(greatest(abs(q.x - p.x), abs(q.y - p.y)), 3)[3] * (1 - pow(2, -30)) AS r
              FROM v_{c} p JOIN v_{c} q ON p.i <> q.i GROUP BY p.i) s CROSS JOIN v_{c} t GROUP BY s.i) d
        JOIN psi pk ON pk.m = d.ties JOIN psi pa ON pa.m = d.a JOIN psi pb ON pb.m = d.b"""


NEIGHBOUR_COLS = ["size", "steps", "key"]


@query("neighbour_information", """WITH w AS (SELECT p_partkey AS i, p_retailprice AS price, floor(p_size / 10)::DOUBLE AS steps,
        CASE WHEN p_type <> 'SMALL' THEN p_size::DOUBLE END AS size, sqrt(p_partkey) AS key FROM part), """ + ", ".join(
    f"""v_{c} AS (SELECT i, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y
        FROM (SELECT i, coalesce({c}, median({c}) OVER ()) AS x, price AS y FROM w))""" for c in NEIGHBOUR_COLS) + f""",
    psi AS (SELECT m, -0.57721566490153286 + coalesce(sum(1.0::DOUBLE / (m - 1)) FILTER (m > 1) OVER (ORDER BY m), 0) AS h
            FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM part))) AS m))
    SELECT "column", {rnd('greatest(mi, 0)', 6)} + 0.0::DOUBLE AS mi, n FROM (""" + " UNION ALL ".join(
    neighbour_mi_sql(c) for c in NEIGHBOUR_COLS) + ")")
def neighbour_information(spark, sf_dir):
    parts = B.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_retailprice").alias("price"), F.floor(F.col("p_size") / 10).cast("double").alias("steps"),
        F.when(F.col("p_type") != "SMALL", F.col("p_size").cast("double")).alias("size"), F.sqrt("p_partkey").alias("key"))
    return tidy(neighbour_mi(parts, NEIGHBOUR_COLS, "price"), "mi")


@query("label_relevance", f"WITH {DATA_SQL}, s AS (" + " UNION ALL ".join(
    SPEARMAN_PAIR.format(a=c, b="line") for c in COLS) + "), p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS var_a, corr({c}, line) AS r FROM x" for c in COLS) + f""")
    SELECT var_a AS "column", {rnd('r', 6)} + 0.0::DOUBLE AS pearson_r, spearman_rho, n FROM s JOIN p USING (var_a)""")
def label_relevance(spark, sf_dir):
    out = K.label_relevance(data(spark, sf_dir), COLS, "line")
    return tidy(out, "pearson_r", "spearman_rho").select("column", "pearson_r", "spearman_rho", "n")
