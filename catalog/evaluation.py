"""Folds, demeaning, models and metrics."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog import bindings as B
from catalog.registry import query
from daygrain.operators import evaluation as E, features as X, model as M
from daygrain.operators.missing import coverage
from daygrain.plans import evaluation as P

rnd = B.rnd

SCORED_SQL = """scored AS (SELECT event_id, event_type, 2 + k % 7 AS label, 1.5::DOUBLE + value / 32 AS prediction FROM ev),
    classed AS (SELECT *, CAST(label AS INTEGER) AS t, CAST(least(greatest(round_even(prediction, 0), 2), 8) AS INTEGER) AS p FROM scored)"""
BY = ["event_type"]


def scored(spark, sf_dir):
    return B.events(spark, sf_dir).select(
        "event_id", "event_type", (F.lit(2) + F.col("k") % 7).cast("double").alias("label"),
        (F.lit(1.5) + F.col("value") / 32).alias("prediction"))


@query("regression_metrics", B.with_views(SCORED_SQL + f""",
    m AS (SELECT event_type, avg(label) AS mean FROM scored GROUP BY 1)
    SELECT event_type, {rnd('avg(abs(label - prediction))', 6)} AS mae, {rnd('sqrt(avg((label - prediction) ** 2))', 6)} AS rmse,
        {rnd('(1 - sum((label - prediction) ** 2) / sum((label - mean) ** 2))', 6)} AS r2
    FROM scored JOIN m USING (event_type) GROUP BY 1"""))
def regression_metrics(spark, sf_dir):
    out = E.regression_metrics(scored(spark, sf_dir), by=BY)
    return out.select(*BY, *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query("prediction_classes", B.with_views(SCORED_SQL + " SELECT event_id, t AS true_class, p AS pred_class FROM classed"))
def prediction_classes(spark, sf_dir):
    return E.classified(scored(spark, sf_dir)).select("event_id", "true_class", "pred_class")


@query("accuracy", B.with_views(SCORED_SQL + f" SELECT event_type, {rnd('avg((t = p)::INTEGER)', 9)} AS accuracy FROM classed GROUP BY 1"))
def accuracy(spark, sf_dir):
    return E.accuracy(scored(spark, sf_dir), BY).withColumn("accuracy", F.round("accuracy", 9))


@query("balanced_accuracy", B.with_views(SCORED_SQL + f""",
    r AS (SELECT event_type, t, avg((t = p)::INTEGER) AS recall FROM classed GROUP BY 1, 2)
    SELECT event_type, {rnd('avg(recall)', 9)} AS balanced_accuracy FROM r GROUP BY 1"""))
def balanced_accuracy(spark, sf_dir):
    return E.balanced_accuracy(scored(spark, sf_dir), BY).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query("macro_f1", B.with_views(SCORED_SQL + f""",
    c AS (SELECT event_type, t AS c FROM classed UNION SELECT event_type, p FROM classed),
    f AS (SELECT c.event_type, c.c, 2.0 * count(*) FILTER (t = c.c AND p = c.c) /
        nullif(count(*) FILTER (t = c.c) + count(*) FILTER (p = c.c), 0) AS f1
        FROM c JOIN classed d ON d.event_type = c.event_type GROUP BY 1, 2)
    SELECT event_type, {rnd('avg(coalesce(f1, 0))', 9)} AS f1_macro FROM f GROUP BY 1"""))
def macro_f1(spark, sf_dir):
    return E.macro_f1(scored(spark, sf_dir), BY).withColumn("f1_macro", F.round("f1_macro", 9))


@query("quadratic_kappa", B.with_views(SCORED_SQL + f""",
    c AS (SELECT event_type, t AS c FROM classed UNION SELECT event_type, p FROM classed),
    i AS (SELECT event_type, c, row_number() OVER (PARTITION BY event_type ORDER BY c) AS i FROM c),
    o AS (SELECT d.event_type, a.i AS ti, b.i AS pi FROM classed d JOIN i a ON a.event_type = d.event_type AND a.c = d.t
        JOIN i b ON b.event_type = d.event_type AND b.c = d.p),
    tm AS (SELECT event_type, ti, count(*) AS n FROM o GROUP BY 1, 2), pm AS (SELECT event_type, pi, count(*) AS n FROM o GROUP BY 1, 2),
    seen AS (SELECT event_type, sum((ti - pi) ** 2) AS s, count(*) AS n FROM o GROUP BY 1),
    chance AS (SELECT tm.event_type, sum((ti - pi) ** 2 * tm.n * pm.n) AS s FROM tm JOIN pm ON tm.event_type = pm.event_type GROUP BY 1)
    SELECT event_type, {rnd('(1 - seen.s / (chance.s / seen.n))', 9)} AS qwk FROM seen JOIN chance USING (event_type)"""))
def quadratic_kappa(spark, sf_dir):
    return E.quadratic_kappa(scored(spark, sf_dir), BY).withColumn("qwk", F.round("qwk", 9))


@query("confusion_grid", B.with_views(SCORED_SQL + """,
    g AS (SELECT event_type, CAST(a.v AS INTEGER) AS t, CAST(b.v AS INTEGER) AS p FROM (SELECT DISTINCT event_type FROM ev),
        range(2, 9) a(v), range(2, 9) b(v))
    SELECT event_type, g.t AS "true", g.p AS pred, count(c.event_id) AS count FROM g
    LEFT JOIN classed c USING (event_type, t, p) GROUP BY 1, 2, 3"""))
def confusion_grid(spark, sf_dir):
    return E.confusion_long(scored(spark, sf_dir), by=BY)


@query("distinct_true_classes", B.with_views(SCORED_SQL + " SELECT event_type, count(DISTINCT t) AS n_classes_true FROM classed GROUP BY 1"))
def distinct_true_classes(spark, sf_dir):
    return E.n_true_classes(scored(spark, sf_dir), BY)


@query("run_summary", B.with_views(SCORED_SQL + f""",
    r AS (SELECT event_type AS config, label % 3 AS feature_set, event_id % 4 AS fold, avg(abs(label - prediction)) AS mae
          FROM scored GROUP BY 1, 2, 3)
    SELECT config, CAST(CAST(feature_set AS INTEGER) AS VARCHAR) AS feature_set, {rnd('avg(mae)', 6)} AS mean_mae,
        {rnd('stddev_samp(mae)', 6)} AS std_mae FROM r GROUP BY 1, 2"""))
def run_summary(spark, sf_dir):
    runs = scored(spark, sf_dir).withColumns({
        "config": F.col("event_type"), "feature_set": (F.col("label") % 3).cast("int").cast("string"),
        "fold": F.col("event_id") % 4})
    by = ["config", "feature_set", "fold"]
    metrics = E.regression_metrics(runs, by=by).join(E.accuracy(runs, by), by).join(E.quadratic_kappa(runs, by), by).withColumn(
        "base_mae", F.col("mae"))
    return E.summarize_runs(metrics).select("config", "feature_set", F.round("mean_mae", 6).alias("mean_mae"),
                                            F.round("std_mae", 6).alias("std_mae"))


COLS = ["l_quantity", "l_extendedprice"]
LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_returnflag AS participant_id, l_extendedprice, l_discount, l_tax,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem)"""


def lines(spark, sf_dir):
    quantity = F.when(F.col("l_linenumber") != 1, F.col("l_quantity"))
    return B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("participant_id"), "l_extendedprice", "l_discount", "l_tax",
        quantity.alias("l_quantity"))


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("leave_one_out_folds", f"""WITH {LINES_SQL}
    SELECT participant_id AS fold, count(*) AS n_test, CAST((SELECT count(*) FROM lines) - count(*) AS BIGINT) AS n_train
    FROM lines GROUP BY 1""")
def leave_one_out_folds(spark, sf_dir):
    return X.lopo_folds(lines(spark, sf_dir))


@query("fold_split_rows", f"""WITH {LINES_SQL}
    SELECT f.participant_id AS fold, l.participant_id = f.participant_id AS is_test, count(*) AS n
    FROM (SELECT DISTINCT participant_id FROM lines) f, lines l GROUP BY 1, 2""")
def fold_split_rows(spark, sf_dir):
    folds = X.lopo_folds(lines(spark, sf_dir))
    sides = F.array(F.struct(F.lit(True).alias("is_test"), F.col("n_test").alias("n")),
                    F.struct(F.lit(False).alias("is_test"), F.col("n_train").alias("n")))
    return folds.select("fold", F.inline(sides))


@query("resolved_feature_sets", f"""WITH {LINES_SQL},
    s AS (SELECT 'S1_tier1' AS feature_set, unnest(['l_discount', 'l_quantity', 'l_tax']) AS feature, unnest([0, 1, 2]) AS i
        UNION ALL SELECT 'S2_tier1_2', unnest(['l_quantity', 'l_tax']), unnest([0, 1])
        UNION ALL SELECT 'S3_minimal', unnest(['l_tax']), unnest([0])),
    c AS (SELECT unnest(['l_discount', 'l_quantity', 'l_tax']) AS feature,
        unnest([count(l_discount), count(l_quantity), count(l_tax)]) / count(*)::DOUBLE AS coverage FROM lines)
    SELECT feature_set, CAST(i AS INTEGER) AS position, feature, {rnd('coverage', 9)} AS coverage FROM s JOIN c USING (feature)""")
def resolved_feature_sets(spark, sf_dir):
    rows = lines(spark, sf_dir)
    x = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
    sets = X.resolve_feature_sets(rows, x, tier1=["l_extendedprice"], tier2=["l_discount"], minimal=["l_tax"])
    known = coverage(rows, x).withColumnRenamed("column", "feature")
    return X.feature_set_table(sets, rows).join(known, "feature").withColumn("coverage", F.round("coverage", 9))


@query("group_means", f"""WITH {LINES_SQL}
    SELECT participant_id, {rnd('avg(l_quantity)', 6)} AS l_quantity, {rnd('avg(l_extendedprice)', 4)} AS l_extendedprice FROM lines GROUP BY 1""")
def group_means(spark, sf_dir):
    return rounded(rounded(X.fit_group_means(lines(spark, sf_dir), COLS), ["l_quantity"]), ["l_extendedprice"], 4)


@query("demean_parameters", f"""WITH {LINES_SQL}
    SELECT coalesce(participant_id, 'GLOBAL') AS participant_id, {rnd('avg(l_quantity)', 6)} AS l_quantity,
        {rnd('avg(l_extendedprice)', 4)} AS l_extendedprice, grouping(participant_id) = 1 AS is_global
    FROM lines GROUP BY ROLLUP (participant_id)""")
def demean_parameters(spark, sf_dir):
    return rounded(rounded(X.demean_params(lines(spark, sf_dir), COLS), ["l_quantity"]), ["l_extendedprice"], 4)


@query("demeaned_features", f"""WITH {LINES_SQL},
    g AS (SELECT participant_id, avg(l_quantity) AS m FROM lines WHERE participant_id <> 'R' GROUP BY 1)
    SELECT l_orderkey, l_linenumber, {rnd("(l_quantity - coalesce(g.m, (SELECT avg(l_quantity) FROM lines WHERE participant_id <> 'R')))", 6)}
        AS l_quantity FROM lines LEFT JOIN g USING (participant_id)""")
def demeaned_features(spark, sf_dir):
    rows = lines(spark, sf_dir)
    params = X.demean_params(rows.where(F.col("participant_id") != "R"), ["l_quantity"])
    out = X.apply_demean(rows, ["l_quantity"], params)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])


@query("held_out_demeaning", f"""WITH {LINES_SQL},
    o AS (SELECT f.participant_id, avg(l.l_quantity) AS m FROM (SELECT DISTINCT participant_id FROM lines) f
        JOIN lines l ON l.participant_id <> f.participant_id GROUP BY 1)
    SELECT l_orderkey, l_linenumber, {rnd('(l_quantity - m)', 6)} AS l_quantity FROM lines JOIN o USING (participant_id)""")
def held_out_demeaning(spark, sf_dir):
    out = X.lopo_demeaned(lines(spark, sf_dir), ["l_quantity"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])


@query("reference_predictors", f"""WITH {LINES_SQL},
    o AS (SELECT f.participant_id, avg(l.l_extendedprice) AS base FROM (SELECT DISTINCT participant_id FROM lines) f
        JOIN lines l ON l.participant_id <> f.participant_id GROUP BY 1),
    g AS (SELECT participant_id, avg(l_extendedprice) AS own FROM lines GROUP BY 1)
    SELECT l_orderkey, l_linenumber, {rnd('base', 4)} AS base_prediction, {rnd('own', 4)} AS oracle_prediction
    FROM lines JOIN o USING (participant_id) JOIN g USING (participant_id)""")
def reference_predictors(spark, sf_dir):
    out = X.reference_predictions(lines(spark, sf_dir), "l_extendedprice")
    return rounded(out.select("l_orderkey", "l_linenumber", "base_prediction", "oracle_prediction"),
                   ["base_prediction", "oracle_prediction"], 4)


@query("final_dataset", f"""WITH {LINES_SQL}, g AS (SELECT participant_id, avg(l_quantity) AS m FROM lines GROUP BY 1)
    SELECT participant_id, {rnd('(l_quantity - m)', 6)} AS l_quantity, l_extendedprice FROM lines JOIN g USING (participant_id)""")
def final_dataset(spark, sf_dir):
    rows = lines(spark, sf_dir)
    out = X.final_dataset(rows, ["l_quantity"], X.demean_params(rows, ["l_quantity"]), ["participant_id"], ["l_extendedprice"])
    return rounded(out, ["l_quantity"])


@query("assembled_matrix", f"""WITH {LINES_SQL}
    SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -1.0) AS quantity, l_tax AS tax FROM lines""")
def assembled_matrix(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    out = M.assemble(lines(spark, sf_dir), ["l_quantity", "l_tax"]).withColumn("v", vector_to_array("features"))
    return out.select("l_orderkey", "l_linenumber", F.when(F.isnan(F.col("v")[0]), -1.0).otherwise(F.col("v")[0]).alias("quantity"),
                      F.col("v")[1].alias("tax"))


FAST = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample": 1.0, "min_child_weight": 1}
FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("boosted_fit_predict")
def boosted_fit_predict(spark, sf_dir):
    """Every row predicted by the fit that holds its group out."""
    rows = lines(spark, sf_dir)
    parts = [M.fit_predict(FAST, *X.lopo_split(rows, fold), FEATURES, "l_extendedprice")[0] for fold in X.fold_names(rows)]
    return reduce(DataFrame.unionByName, parts).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"), "prediction")


@query("evaluation_grid")
def evaluation_grid(spark, sf_dir):
    rows = lines(spark, sf_dir)
    sets = {"all": FEATURES, "minimal": ["l_quantity"]}
    scored_rows = P.run_grid(rows, sets, "l_extendedprice", {"fast": FAST})
    return P.grid_metrics(scored_rows, rows, "l_extendedprice")


#: The published setting of the final refit.
REFIT = M.CONFIGS["A_expressive"]


@query("refit_model_round_trip")
def refit_model_round_trip(spark, sf_dir):
    """The published refit on all rows, saved, loaded again and asked for every row."""
    from pyspark.ml import PipelineModel

    from catalog.scans import scratch
    from daygrain.sources import sinks
    rows = lines(spark, sf_dir)
    params = X.demean_params(rows, FEATURES)
    demeaned = X.apply_demean(rows, FEATURES, params)
    path = scratch(spark)
    sinks.save_model(M.fit(REFIT, demeaned, FEATURES, "l_extendedprice"), params, FEATURES, REFIT, path)
    again = PipelineModel.load(f"{path}/model")
    return M.predict(again, demeaned, FEATURES).select("l_orderkey", "l_linenumber", "prediction")
