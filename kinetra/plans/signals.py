"""Queries on signals: segmentation, windows, filters, joins, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.operators import segment, split
from kinetra.plans import bindings as B
from kinetra.plans.registry import query, r6
from kinetra.sources import recordings


@query("src5_exercise_pruning", "SELECT page_id, url FROM pages WHERE NOT (lower(url) LIKE '%/en/%') OR NOT EXISTS (SELECT 1 FROM pages WHERE NOT (lower(url) LIKE '%/en/%'))")
def _(spark, d):
    pages = B.table(spark, d, "pages").select("page_id", "url").withColumn("_ok", ~F.lower("url").contains("/en/"))
    return pages.crossJoin(F.broadcast(pages.agg(F.max("_ok").alias("_any")))).where("_ok or not _any").select("page_id", "url")


@query("src6_subject_id", r"""SELECT page_id, CAST(coalesce(nullif(regexp_extract(n, '[Ss](\d+)', 1), ''), nullif(regexp_extract(p, '[Ss]ubject[ _]?(\d+)', 1), ''), nullif(regexp_extract(p, '(\d+)', 1), '')) AS INT) AS subject_id
 FROM (SELECT page_id, list_extract(s, -1) AS n, coalesce(list_extract(s, -2), '') AS p FROM (SELECT page_id, string_split('subject_' || CAST(page_id % 97 AS VARCHAR) || '/' || list_extract(string_split(url, '/'), -1), '/') AS s FROM pages))""")
def _(spark, d):
    path = F.concat(F.lit("subject_"), (F.col("page_id") % 97).cast("string"), F.lit("/"), F.element_at(F.split("url", "/"), -1))
    return B.table(spark, d, "pages").withColumn("path", path).select("page_id", recordings.subject_id("path").alias("subject_id"))


@query("src2_key_aliasing", "SELECT event_id, coalesce(json_extract_string(props, '$.emg'), json_extract_string(props, '$.data'), json_extract_string(props, '$.k')) AS signal FROM events")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", F.coalesce(*[F.get_json_object("props", f"$.{k}") for k in ("emg", "data", "k")]).alias("signal"))


@query("src3_coercion", "SELECT event_id, CAST(coalesce(CAST(json_extract_string(props, '$.fs') AS INT), 2000) AS INT) AS fs, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM events")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.fs").cast("int"), F.lit(2000)).alias("fs"), F.round(F.col("value").cast("float").cast("double"), 4).alias("value"))


@query("src8_repetition_vector", """SELECT subject_id, arg_min(rep, (abs(n - (SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey))), rep)) AS rep FROM (SELECT l_suppkey AS subject_id, l_linenumber AS rep, count(*) * 4 AS n FROM lineitem GROUP BY 1, 2) GROUP BY subject_id""")
def _(spark, d):
    line = B.table(spark, d, "lineitem")
    target = line.groupBy("l_suppkey").count().agg(F.avg("count").alias("t"))
    named = line.groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_linenumber").alias("rep")).agg((F.count("*") * 4).alias("n"))
    return named.crossJoin(F.broadcast(target)).groupBy("subject_id").agg(F.min_by("rep", F.struct(F.abs(F.col("n") - F.col("t")), "rep")).alias("rep"))


@query("src9_subject_stream", f"WITH {B.SIG} SELECT subject_id, count(*) AS n, CAST(count(DISTINCT stimulus) AS BIGINT) AS classes, CAST(max(repetition) AS INT) AS reps FROM sig GROUP BY subject_id")
def _(spark, d):
    return B.signal(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"), F.count_distinct("stimulus").alias("classes"), F.max("repetition").alias("reps"))


@query("src19_label_census", "SELECT toxic, count(*) AS n, CAST(count(DISTINCT quality) AS BIGINT) AS qualities FROM labels GROUP BY toxic")
def _(spark, d):
    return B.table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_distinct("quality").alias("qualities"))


@query("flt1_drop_rest", f"WITH {B.SIG} SELECT subject_id, i FROM sig WHERE stimulus > 0")
def _(spark, d):
    return B.signal(spark, d).where("stimulus > 0").select("subject_id", F.col("i").cast("bigint").alias("i"))


def _movements(spark, d):
    return B.table(spark, d, "region").where("r_regionkey between 1 and 3").selectExpr("r_regionkey as movement_id", "r_regionkey - 1 as class_idx")


@query("flt2_label_filter", f"WITH {B.SIG} SELECT subject_id, i, CAST(r_regionkey - 1 AS INT) AS class_idx FROM sig JOIN region ON stimulus = r_regionkey WHERE r_regionkey BETWEEN 1 AND 3")
def _(spark, d):
    kept, _dropped = segment.keep_labels(B.signal(spark, d), _movements(spark, d), "stimulus")
    return kept.select("subject_id", F.col("i").cast("bigint").alias("i"), F.col("class_idx").cast("int").alias("class_idx"))


@query("flt2_dropped_counts", f"WITH {B.SIG} SELECT CAST(stimulus AS INT) AS stimulus, count(*) AS dropped FROM sig WHERE stimulus NOT IN (1, 2, 3) GROUP BY stimulus")
def _(spark, d):
    return segment.keep_labels(B.signal(spark, d), _movements(spark, d), "stimulus")[1]


@query("flt3_exercise_range", "SELECT p_partkey FROM part WHERE p_size BETWEEN 18 AND 40")
def _(spark, d):
    return B.table(spark, d, "part").where(segment.exercise_filter("p_size", "E2")).select("p_partkey")


@query("flt4_subject_whitelist", "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(spark, d):
    return B.table(spark, d, "events").join(B.table(spark, d, "supplier").where("s_acctbal > 0"), F.col("user_id") == F.col("s_suppkey"), "left_semi").select("event_id")


@query("flt5_min_trial_length", f"WITH {B.SIG}, {B.TRIALS} SELECT stimulus, count(*) AS trials, CAST(sum(\"end\" - \"start\") AS BIGINT) AS samples FROM trial GROUP BY stimulus")
def _(spark, d):
    return segment.trials(B.signal(spark, d), ["subject_id"], 2).groupBy("stimulus").agg(F.count("*").alias("trials"), F.sum(F.col("end") - F.col("start")).alias("samples"))


@query("prj1_channel_fit", "SELECT vec_id, len(x) AS n, round(CAST(list_sum(x) AS DOUBLE), 3) AS total FROM (SELECT vec_id, list_concat(embedding[1:CAST(vec_id % 64 + 1 AS INT)], list_transform(range(12), lambda z: CAST(0 AS FLOAT)))[1:12] AS x FROM embeddings)")
def _(spark, d):
    cut = B.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("x")).withColumn("x", segment.fit_channels("x", 12))
    return cut.select("vec_id", F.size("x").cast("bigint").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double")), 3).alias("total"))


@query("prj2_label_remap", f"WITH {B.SIG} SELECT subject_id, i, CAST(stimulus - 1 AS INT) AS class_idx FROM sig WHERE stimulus > 0")
def _(spark, d):
    index = F.create_map(*[F.lit(x) for k in range(1, 5) for x in (k, k - 1)])
    return B.signal(spark, d).select("subject_id", F.col("i").cast("bigint").alias("i"), F.try_element_at(index, "stimulus").alias("class_idx")).where("class_idx is not null")


@query("prj3_class_grouping", "SELECT n_nationkey, CAST(n_regionkey AS INT) AS group_id FROM nation WHERE n_regionkey IN (0, 1, 2)")
def _(spark, d):
    groups = B.table(spark, d, "nation").where("n_regionkey < 3").selectExpr("n_nationkey as movement_id", "n_regionkey as group_id")
    return segment.group_classes(B.table(spark, d, "nation").select("n_nationkey"), groups, "n_nationkey").selectExpr("n_nationkey", "cast(group_id as int) group_id")


@query("prj7_display_labels", "SELECT p_partkey, CAST(p_size AS VARCHAR) || ': ' || CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS label FROM part")
def _(spark, d):
    short = F.when(F.length("p_name") > 12, F.concat(F.substring("p_name", 1, 9), F.lit("..."))).otherwise(F.col("p_name"))
    return B.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(": "), short).alias("label"))


@query("prj8_class_count", "SELECT CAST(count(DISTINCT n_regionkey) AS BIGINT) AS grouped, count(*) AS movements FROM nation")
def _(spark, d):
    return B.table(spark, d, "nation").agg(F.count_distinct("n_regionkey").alias("grouped"), F.count("*").alias("movements"))


@query("w1_trials", f'WITH {B.SIG}, {B.TRIALS} SELECT subject_id, trial_id, stimulus, repetition, "start", "end" FROM trial')
def _(spark, d):
    t = segment.trials(B.signal(spark, d), ["subject_id"], 2)
    return t.withColumns({"stimulus": F.col("stimulus").cast("int"), "repetition": F.col("repetition").cast("int")})


@query("w2_sliding_windows", f"WITH {B.SIG}, {B.WIN} SELECT subject_id, window_id, round(mean, 6) AS mean, round(sd, 6) AS sd, round(k_mean, 6) AS k_mean FROM win")
def _(spark, d):
    return B.windows(spark, d).select("subject_id", "window_id", *r6(mean="mean", sd="sd", k_mean="k_mean"))


@query("w3_window_labels", f"WITH {B.SIG}, {B.WIN} SELECT subject_id, window_id, y FROM win")
def _(spark, d):
    return B.windows(spark, d).select("subject_id", "window_id", "y")


@query("w4_window_repetition", f"WITH {B.SIG}, {B.WIN} SELECT rep, y, count(*) AS n FROM win GROUP BY rep, y")
def _(spark, d):
    return B.windows(spark, d).groupBy("rep", "y").agg(F.count("*").alias("n"))


@query("w7_source_pool", f"""WITH {B.SIG}, {B.WIN}, c AS (SELECT subject_id, count(*) AS n FROM win GROUP BY subject_id),
 f AS (SELECT subject_id AS fold FROM c) SELECT fold, subject_id, n FROM (SELECT f.fold, c.subject_id, c.n, sum(c.n) OVER (PARTITION BY f.fold ORDER BY c.subject_id) - c.n AS before FROM f JOIN c ON c.subject_id <> f.fold) WHERE before < 100""")
def _(spark, d):
    counts = B.windows(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"))
    return split.source_pool(counts, counts.select(F.col("subject_id").alias("fold")), 100)


@query("w8_repetition_packing", f"""WITH {B.SIG}, {B.WIN}, r AS (SELECT subject_id, rep, count(*) AS n FROM win GROUP BY 1, 2),
 l AS (SELECT subject_id, list({{'total': n, 'reps': CAST(rep AS VARCHAR)}} ORDER BY md5('42:' || CAST(rep AS VARCHAR)), rep) AS x FROM r GROUP BY 1),
 p AS (SELECT subject_id, list_reduce(x, lambda a, b: CASE WHEN a.total + b.total <= 6 THEN {{'total': a.total + b.total, 'reps': a.reps || ',' || b.reps}} ELSE a END) AS p FROM l)
 SELECT subject_id, CAST(p.total AS BIGINT) AS total, p.reps AS reps FROM p""")
def _(spark, d):
    reps = B.windows(spark, d).groupBy("subject_id", "rep").agg(F.count("*").alias("n")).withColumn("o", split.hashed(42, "rep"))
    packed = split.pack_repetitions(reps, ["subject_id"], 6, "o")
    return packed.select("subject_id", "total", F.concat_ws(",", F.transform("reps", lambda r: r.cast("string"))).alias("reps"))


@query("jn5_broadcast_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return B.table(spark, d, "customer").join(F.broadcast(B.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("jn6_lookup_default", "SELECT c_custkey, CAST(coalesce(n_regionkey, -1) AS INT) AS group_id FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def _(spark, d):
    some = F.broadcast(B.table(spark, d, "nation").where("n_regionkey < 3"))
    return B.table(spark, d, "customer").join(some, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_regionkey", F.lit(-1)).cast("int").alias("group_id"))


@query("jn7_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, d):
    return B.table(spark, d, "supplier").join(B.table(spark, d, "lineitem").where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("jn8_fold_sources", "SELECT a.n_nationkey AS fold, count(*) AS sources FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey")
def _(spark, d):
    n = B.table(spark, d, "nation").select("n_nationkey")
    return n.withColumnRenamed("n_nationkey", "fold").join(F.broadcast(n), F.col("fold") != F.col("n_nationkey")).groupBy("fold").agg(F.count("*").alias("sources"))


@query("jn10_resume", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def _(spark, d):
    done = B.table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return B.table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn11_grid", "SELECT r_name, s AS seed, count(*) AS points FROM region, (VALUES (42), (123), (2024), (7), (999)) v(s), nation WHERE n_regionkey = r_regionkey GROUP BY r_name, s")
def _(spark, d):
    from kinetra.config import SEEDS

    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed int")
    grid = B.table(spark, d, "region").crossJoin(F.broadcast(seeds))
    return grid.join(B.table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "seed").agg(F.count("*").alias("points"))


SPLIT = f"""{B.SIG}, {B.WIN}, u AS (SELECT DISTINCT y, rep FROM win), k AS (SELECT y, rep, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY rep) AS r FROM u),
 sp AS (SELECT y, rep, CASE WHEN n >= 2 AND r <= least(greatest(1, CAST(round_even(n * 0.5, 0) AS INT)), n - 1) THEN 'held' ELSE 'kept' END AS side, n < 2 AS warned FROM k)"""


def _split(spark, d):
    return split.repetition_split(B.windows(spark, d), "y", "rep", 0.5, order=F.col("rep"))


@query("sp1_repetition_split", f"WITH {SPLIT} SELECT y, rep, side, warned FROM sp")
def _(spark, d):
    return _split(spark, d)


@query("sp1_hashed_repetition_split", f"""WITH {B.SIG}, {B.WIN}, u AS (SELECT DISTINCT subject_id, y, rep FROM win), k AS (SELECT *, count(*) OVER (PARTITION BY subject_id, y) AS n,
 row_number() OVER (PARTITION BY subject_id, y ORDER BY md5('42:' || CAST(y AS VARCHAR) || ':' || CAST(rep AS VARCHAR)), rep) AS r FROM u)
 SELECT subject_id, y, rep, CASE WHEN n >= 2 AND r <= least(greatest(1, CAST(round_even(n * 0.5, 0) AS INT)), n - 1) THEN 'held' ELSE 'kept' END AS side, n < 2 AS warned FROM k""")
def _(spark, d):
    return split.repetition_split(B.windows(spark, d), "y", "rep", 0.5, keys=("subject_id",))


@query("ag25_split_summary", f"WITH {SPLIT} SELECT side, count(*) AS n, CAST(count(DISTINCT win.y) AS BIGINT) AS classes, CAST(count(DISTINCT win.rep) AS BIGINT) AS reps FROM win JOIN sp ON win.y = sp.y AND win.rep = sp.rep GROUP BY side")
def _(spark, d):
    return split.split_summary(B.windows(spark, d).join(F.broadcast(_split(spark, d)), ["y", "rep"]), "y", "rep")


@query("sp2_stratified_subsample", "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY l_returnflag) AS c, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE n <= 100 OR r <= greatest(1, floor(c / n * 100))")
def _(spark, d):
    return split.stratified(B.table(spark, d, "lineitem"), "l_returnflag", 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("sp2_stratified_by_subject", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS m, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS c, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey) AS r FROM lineitem) WHERE m <= 50 OR r <= greatest(1, floor(c / m * 50)) GROUP BY 1, 2")
def _(spark, d):
    return split.stratified(B.table(spark, d, "lineitem"), "l_returnflag", 50, ["l_orderkey"], ("l_suppkey",)).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("sp3_exact_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def _(spark, d):
    return split.exact_sample(B.table(spark, d, "orders"), 500, 42, "o_orderkey").select("o_orderkey")


@query("sp4_subject_subset", "SELECT n_nationkey FROM nation ORDER BY md5('42:' || CAST(n_nationkey AS VARCHAR)), n_nationkey LIMIT 5")
def _(spark, d):
    return split.exact_sample(B.table(spark, d, "nation"), 5, 42, "n_nationkey").select("n_nationkey")


@query("set1_union_all", "SELECT subject, count(*) AS n FROM (SELECT l_suppkey AS subject FROM lineitem UNION ALL SELECT s_suppkey FROM supplier) GROUP BY subject")
def _(spark, d):
    a, b = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject")), B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"))
    return a.unionByName(b).groupBy("subject").agg(F.count("*").alias("n"))


@query("set2_distinct", f"WITH {B.SIG} SELECT DISTINCT CAST(stimulus AS INT) AS stimulus, repetition FROM sig")
def _(spark, d):
    return B.signal(spark, d).select("stimulus", "repetition").distinct()


@query("set3_leak_check", f"WITH {SPLIT} SELECT y, rep FROM sp WHERE side = 'held' INTERSECT SELECT y, rep FROM sp WHERE side = 'kept'")
def _(spark, d):
    s = _split(spark, d)
    return split.leaks(s.where("side = 'held'"), s.where("side = 'kept'"), "y", "rep")


@query("set4_complement", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    return B.table(spark, d, "orders").select("o_custkey").distinct().join(B.table(spark, d, "customer").where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("ag24_class_census", f"WITH {B.SIG} SELECT subject_id, CAST(count(DISTINCT stimulus) FILTER (WHERE stimulus > 0) AS BIGINT) AS classes, CAST(count(DISTINCT stimulus) FILTER (WHERE stimulus > 0) AS BIGINT) = 4 AS complete FROM sig GROUP BY subject_id")
def _(spark, d):
    n = F.count_distinct(F.when(F.col("stimulus") > 0, F.col("stimulus")))
    return B.signal(spark, d).groupBy("subject_id").agg(n.alias("classes"), (n == 4).alias("complete"))
