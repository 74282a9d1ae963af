"""The studies' concepts on the given tables, once as DataFrames and once as SQL common table expressions.

signal: events by user, event types as stimulus (error is rest), week of the month as repetition, two channels.
predictions: nearest class centroid of the source domain for the final rows of embeddings.
matrix: supplier x return flag. facts: market segment x priority x nation x year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import scale, segment


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


STIMULI = {"error": 0, "click": 1, "purchase": 2, "signup": 3, "view": 4}
SIG = f"""sig AS (SELECT user_id AS subject_id, event_id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
 CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STIMULI.items())} END AS stimulus,
 CAST(floor((day(ts) - 1) / 7.0) + 1 AS INT) AS repetition,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


def signal(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[x for k, v in STIMULI.items() for x in (F.lit(k), F.lit(v))])
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("subject_id"), "event_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.try_element_at(kinds, F.col("event_type")).alias("stimulus"), (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int").alias("repetition"),
    )
    return segment.with_index(rows, ["subject_id"], ["ts", "event_id"])


W, OVERLAP, STEP = 16, 0.5, 8
WIN = """ex AS (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((i - 15) / 8.0)) AS BIGINT), CAST(floor(i / 8.0) AS BIGINT))) AS window_id FROM sig),
 win AS (SELECT subject_id, window_id, CAST(max(CASE WHEN i - window_id * 8 = 8 THEN stimulus END) AS INT) AS y,
 CAST(max(CASE WHEN i - window_id * 8 = 8 THEN repetition END) AS INT) AS rep, avg(value) AS mean, stddev_pop(value) AS sd, avg(k) AS k_mean
 FROM ex GROUP BY subject_id, window_id HAVING count(*) = 16)"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    aggs = [segment.middle_label("stimulus", W).cast("int").alias("y"), segment.middle_label("repetition", W).cast("int").alias("rep"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.avg("k").alias("k_mean")]
    return segment.windows(signal(spark, d), ["subject_id"], W, OVERLAP, aggs)


LE = "le AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("vec_id") % 4 < 2, "source").when(F.col("vec_id") % 4 == 2, "calibration").otherwise("final")
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), role.alias("role"), F.col("embedding").alias("features"))


PRED = f"""{LE}, cen AS (SELECT label, j, avg(v) AS c FROM le WHERE vec_id % 4 < 2 GROUP BY label, j),
 dist AS (SELECT e.vec_id, e.label AS y, c.label AS p, sum((e.v - c.c) * (e.v - c.c)) AS d2 FROM le e JOIN cen c ON e.j = c.j WHERE e.vec_id % 4 = 3 GROUP BY e.vec_id, e.label, c.label),
 pred AS (SELECT vec_id, y, p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, p) AS r FROM dist) WHERE r = 1)"""
K = 10


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, y, p of final rows: centroids are classes times features and are broadcast as one array of structs."""
    e = embeddings(spark, d)
    cells = scale.long(e.where("role = 'source'"), "features", ("y",)).groupBy("y", "j").agg(F.avg("v").alias("c"))
    centroids = cells.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("j", "c")))["c"].alias("c")).agg(F.collect_list(F.struct("y", "c")).alias("centroids"))
    final = e.where("role = 'final'").crossJoin(F.broadcast(centroids))
    square = lambda c: F.aggregate(F.zip_with("features", c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.transform("centroids", lambda c: F.struct(square(c["c"]).alias("d2"), c["y"].alias("p"))))
    return final.select("vec_id", "y", nearest["p"].alias("p"))


MAT = """mat AS (SELECT 'db' || CAST(l_suppkey % 3 AS VARCHAR) AS db, l_suppkey AS subject_id, l_returnflag AS method, avg(l_extendedprice) AS value
 FROM lineitem GROUP BY l_suppkey, l_returnflag)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("method")).agg(F.avg("l_extendedprice").alias("value"))
    return m.select(F.concat(F.lit("db"), (F.col("subject_id") % 3).cast("string")).alias("db"), "subject_id", "method", "value")


FACT = """fact AS (SELECT c_mktsegment AS db, substr(o_orderpriority, 1, 1) AS method, c_nationkey AS subject_id, CAST(year(o_orderdate) AS INT) AS seed,
 avg(o_totalprice) / 9973 AS accuracy, min(o_totalprice) / 9973 AS macro_f1, max(o_totalprice) / 9973 AS cov_before, stddev_pop(o_totalprice) / 9973 AS cov_after, count(*) AS n
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
 favg AS (SELECT db, method, subject_id, avg(accuracy) AS value, avg(cov_before) AS before, avg(cov_after) AS after, count(*) AS seeds FROM fact GROUP BY 1, 2, 3)"""
PRIORITIES = ("1", "2", "3", "4", "5")


def facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("db"), F.substring("o_orderpriority", 1, 1).alias("method"), F.col("c_nationkey").alias("subject_id"), F.year("o_orderdate").alias("seed")).agg(
        (F.avg("o_totalprice") / 9973).alias("accuracy"), (F.min("o_totalprice") / 9973).alias("macro_f1"), (F.max("o_totalprice") / 9973).alias("cov_before"), (F.stddev_pop("o_totalprice") / 9973).alias("cov_after"), F.count("*").alias("n")
    )


def seed_averages(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("db", "method", "subject_id").agg(F.avg("accuracy").alias("value"), F.avg("cov_before").alias("before"), F.avg("cov_after").alias("after"), F.count("*").alias("seeds"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Windows as arrays: subject_id, window_id, y, rep, x (two channels of W samples, one after the other)."""
    x = lambda c: F.sort_array(F.collect_list(F.struct("pos", F.col(c).cast("float").alias("v"))))["v"]
    aggs = [segment.middle_label("stimulus", W).cast("int").alias("y"), segment.middle_label("repetition", W).cast("int").alias("rep"), F.concat(x("value"), x("k")).alias("x")]
    return segment.windows(signal(spark, d), ["subject_id"], W, OVERLAP, aggs)


TRIALS = """run AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE stimulus END AS s, CASE WHEN i = 0 THEN 0 ELSE repetition END AS r FROM sig),
 chg AS (SELECT *, CASE WHEN i > 0 AND (s <> lag(s) OVER w OR r <> lag(r) OVER w) THEN 1 ELSE 0 END AS c FROM run WINDOW w AS (PARTITION BY subject_id ORDER BY i)),
 num AS (SELECT *, sum(c) OVER (PARTITION BY subject_id ORDER BY i) AS trial_id FROM chg),
 trial AS (SELECT subject_id, CAST(trial_id AS BIGINT) AS trial_id, CAST(min(s) AS INT) AS stimulus, CAST(min(r) AS INT) AS repetition, CAST(min(i) AS BIGINT) AS "start", CAST(max(i) + 1 AS BIGINT) AS "end"
 FROM num GROUP BY subject_id, trial_id HAVING min(s) > 0 AND count(*) >= 2)"""
