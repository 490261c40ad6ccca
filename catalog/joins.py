"""Joins: spine, dimension, as-of, proximity, caches and exposure."""

from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.registry import query
from daygrain.operators import daily, joins as J
from daygrain.operators.features import demean_params
from daygrain.operators.runs import pair_counts_within

PAIR_SECONDS = 3600

# Windows of every participant: two long ones, one half-open and overlapping.
WINDOWS_SQL = """windows AS (SELECT participant_id, w AS window_id,
    CASE w WHEN 1 THEN TIMESTAMP '2024-01-02' WHEN 2 THEN TIMESTAMP '2024-01-08 06:00:00' ELSE TIMESTAMP '2024-01-20' END AS lower,
    CASE w WHEN 1 THEN TIMESTAMP '2024-01-08 23:59:59.999' WHEN 2 THEN TIMESTAMP '2024-01-15 12:00:00'
        ELSE TIMESTAMP '2024-01-20 23:59:59.999' END AS upper, w <> 2 AS inclusive
    FROM people, (SELECT unnest([1, 2, 3]) AS w))"""


def in_window_sql(ts: str) -> str:
    return f"{ts} >= lower AND ({ts} < upper OR (inclusive AND {ts} = upper))"


def windows(spark, sf_dir):
    from daygrain.operators.windowed import make_windows
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("window_id"), F.lit(a).alias("start"), F.lit(b).alias("end"))
                                for i, a, b in ((1, "2024-01-02", "2024-01-08"),
                                                (2, "2024-01-08 06:00:00", "2024-01-15 12:00:00"),
                                                (3, "2024-01-20", None))]))
    people = B.participants(spark, sf_dir).select("participant_id", asked.alias("a"))
    return make_windows(people.select("participant_id", "a.*"))


@query("spine_join_defaults", B.with_views("""
    w AS (SELECT participant_id, d AS date, count(*) AS n_rows, sum(glasses_of_fluid) AS fluids FROM reporting GROUP BY 1, 2)
    SELECT participant_id, date, coalesce(n_rows, 0) AS n_rows, fluids FROM spine LEFT JOIN w USING (participant_id, date)""",
    "spine", "reporting"))
def spine_join_defaults(spark, sf_dir):
    w = B.reporting(spark, sf_dir).groupBy("participant_id", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n_rows"), F.sum("glasses_of_fluid").alias("fluids"))
    return J.join_spine(B.spine(spark, sf_dir), {"reporting": w}, {"n_rows": 0})


@query("static_dimension_join", """
    SELECT o_orderkey, o_custkey AS participant_id, c_mktsegment, c_nationkey
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def static_dimension_join(spark, sf_dir):
    facts = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("participant_id"))
    dim = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"), "c_mktsegment", "c_nationkey")
    return J.with_static(facts, dim).select("o_orderkey", "participant_id", "c_mktsegment", "c_nationkey")


@query("reindex_to_horizon", B.with_views("""
    e AS (SELECT participant_id, d AS date, sum(floor(value)) AS load FROM ev GROUP BY 1, 2)
    SELECT participant_id, date, load AS load_or_null, coalesce(load, 0) AS load_or_zero
    FROM spine LEFT JOIN e USING (participant_id, date)""", "spine"))
def reindex_to_horizon(spark, sf_dir):
    ev = B.events(spark, sf_dir)
    load = ev.groupBy("participant_id", F.to_date("ts").alias("date")).agg(F.sum(F.floor("value").cast("double")).alias("load"))
    spine = B.spine(spark, sf_dir)
    unknown = J.reindex_days(load, spine).withColumnRenamed("load", "load_or_null")
    zero = J.reindex_days(load, spine, 0.0).withColumnRenamed("load", "load_or_zero")
    return unknown.join(zero, J.KEYS)


@query("morning_attribution", B.with_views(WINDOWS_SQL + """
    SELECT participant_id, window_id, log_id FROM windows JOIN sleep USING (participant_id)
    WHERE """ + in_window_sql("end_ts") + """ AND start_ts >= CAST(lower AS DATE) - INTERVAL 1 DAY""", "people", "sleep"))
def morning_attribution(spark, sf_dir):
    return J.nights_ending_in(B.sleep(spark, sf_dir), windows(spark, sf_dir)).select("participant_id", "window_id", "log_id")


@query("last_known_injury", B.with_views(WINDOWS_SQL + """
    SELECT participant_id, window_id, max(ts) AS last_report_ts, arg_max(coalesce(foot, 'none'), ts) AS left_foot
    FROM windows LEFT JOIN (SELECT * FROM injury) i USING (participant_id)
    WHERE i.ts IS NULL OR i.d <= CAST(upper AS DATE) GROUP BY 1, 2
    UNION ALL SELECT participant_id, window_id, NULL, NULL FROM windows w WHERE EXISTS
        (SELECT 1 FROM injury i WHERE i.participant_id = w.participant_id) AND NOT EXISTS
        (SELECT 1 FROM injury i WHERE i.participant_id = w.participant_id AND i.d <= CAST(w.upper AS DATE))""",
    "people", "injury"))
def last_known_injury(spark, sf_dir):
    last = J.last_known(B.injury(spark, sf_dir), windows(spark, sf_dir), "ts", "injuries")
    foot = F.coalesce(F.try_element_at("last_known", F.lit("left_foot")), F.lit("none"))
    return last.select("participant_id", "window_id", "last_report_ts",
                       F.when(F.col("last_known").isNotNull(), foot).alias("left_foot"))


PAIRS_SQL = f"""pairs AS (SELECT a.participant_id, a.event_id AS event_id_1, b.event_id AS event_id_2,
    (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap_s FROM ev a JOIN ev b ON a.participant_id = b.participant_id
    AND b.ts <= a.ts + INTERVAL {PAIR_SECONDS} SECOND AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)))"""


def pairs(spark, sf_dir):
    return J.pairs_within(B.events(spark, sf_dir), "participant_id", "ts", "event_id", PAIR_SECONDS)


@query("pairs_within_seconds", B.with_views(PAIRS_SQL + """
    SELECT participant_id, event_id_1, event_id_2, gap_s FROM pairs"""))
def pairs_within_seconds(spark, sf_dir):
    return pairs(spark, sf_dir).select("participant_id", "event_id_1", "event_id_2", "gap_s")


@query("pair_counts_within_seconds", B.with_views(PAIRS_SQL + """
    SELECT participant_id, coalesce(n, 0) AS n_pairs FROM people
    LEFT JOIN (SELECT participant_id, count(*) AS n FROM pairs GROUP BY 1) USING (participant_id)""", "people"))
def pair_counts_within_seconds(spark, sf_dir):
    return pair_counts_within(B.events(spark, sf_dir), "participant_id", "ts", PAIR_SECONDS)


@query("symmetric_adjacency", B.with_views(PAIRS_SQL + """
    SELECT participant_id, event_id_1 AS node, event_id_2 AS neighbour FROM pairs
    UNION ALL SELECT participant_id, event_id_2, event_id_1 FROM pairs"""))
def symmetric_adjacency(spark, sf_dir):
    return J.adjacency(pairs(spark, sf_dir), "participant_id", "event_id")


@query("label_lookup_pending", """
    SELECT doc_id, source, coalesce(CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END, 'PENDING') AS is_food
    FROM documents LEFT JOIN labels USING (doc_id)""")
def label_lookup_pending(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = B.table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE quality WHEN 1 THEN 'YES' ELSE 'NO' END").alias("is_food"))
    return J.with_labels(docs, labels, "doc_id", "is_food")


@query("pending_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_keys(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id")
    return J.pending_keys(docs, B.table(spark, sf_dir, "labels"), "doc_id")


@query("valid_cache_hits", """
    SELECT o_orderkey, c_acctbal AS calories FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0""")
def valid_cache_hits(spark, sf_dir):
    items = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cache_key"))
    cache = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cache_key"),
        F.struct(F.col("c_acctbal").alias("calories"), F.col("c_nationkey").alias("protein"),
                 F.lit(1).alias("carbohydrates"), F.lit(0).alias("fats")).alias("macros"))
    return J.cache_hits(items, cache, "cache_key", "macros").select("o_orderkey", F.col("macros.calories").alias("calories"))


@query("pair_gap_lookup", B.with_views("""
    named AS (SELECT participant_id, file AS file1, CASE WHEN k % 10 = 0 THEN 'gone.jpg'
        ELSE 'IMG_' || lpad(CAST(event_id + 1 AS VARCHAR), 9, '0') || '.jpg' END AS file2
        FROM photos JOIN (SELECT event_id, k FROM ev) e ON photos.seq = e.event_id)
    SELECT n.participant_id, file1, file2, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap_s FROM named n
    LEFT JOIN photos a ON a.participant_id = n.participant_id AND a.file = file1
    LEFT JOIN photos b ON b.participant_id = n.participant_id AND b.file = file2""", "photos"))
def pair_gap_lookup(spark, sf_dir):
    ev = B.events(spark, sf_dir)
    named = ev.select("participant_id",
                      F.expr("concat('IMG_', lpad(CAST(event_id AS STRING), 9, '0'), '.jpg')").alias("file1"),
                      F.expr("""CASE WHEN k % 10 = 0 THEN 'gone.jpg'
                          ELSE concat('IMG_', lpad(CAST(event_id + 1 AS STRING), 9, '0'), '.jpg') END""").alias("file2"))
    return J.pair_gaps(named, B.photos(spark, sf_dir), "participant_id", "file", "ts")


@query("exposure_hours", B.with_views(f"""
    a AS (SELECT participant_id, coalesce(sum(duration_min), 0) AS srpe_min FROM srpe GROUP BY 1),
    b AS (SELECT participant_id, sum(coalesce(active_ms, duration_ms, 0)) AS ms FROM exercise GROUP BY 1)
    SELECT participant_id, coalesce(srpe_min, 0) AS srpe_min, {B.rnd('(coalesce(ms, 0) / 60000.0::DOUBLE)', 4)} AS exercise_min,
        {B.rnd('((coalesce(srpe_min, 0) + coalesce(ms, 0) / 60000.0::DOUBLE) / 60)', 4)} AS total_h
    FROM a FULL JOIN b USING (participant_id)""", "srpe", "exercise"))
def exposure_hours(spark, sf_dir):
    out = daily.exposure_hours(B.srpe(spark, sf_dir), B.exercise(spark, sf_dir))
    return out.withColumns({"exercise_min": F.round("exercise_min", 4), "total_h": F.round("total_h", 4)})


@query("group_mean_lookup", """
    WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1)
    SELECT s_suppkey, """ + B.rnd("coalesce(m, (SELECT avg(c_acctbal) FROM customer))", 4) + """ AS looked_up
    FROM supplier LEFT JOIN m ON m.c_nationkey = s_nationkey + 12""")
def group_mean_lookup(spark, sf_dir):
    customers = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("participant_id"), "c_acctbal")
    params = demean_params(customers, ["c_acctbal"])
    asked = B.table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") + 12).cast("string").alias("participant_id"))
    looked = J.lookup_with_fallback(asked, params, "participant_id", ["c_acctbal"])
    return looked.select("s_suppkey", F.round("c_acctbal_mean", 4).alias("looked_up"))
