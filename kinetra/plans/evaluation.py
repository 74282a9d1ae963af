"""Queries on predictions and results: metrics, summary tables, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetra.operators import metrics, stats
from kinetra.plans import bindings as B
from kinetra.plans.registry import query, r6, r9

GRID = "grid AS (SELECT CAST(a.v AS INT) AS y, CAST(b.v AS INT) AS p FROM generate_series(0, 9) a(v), generate_series(0, 9) b(v)), cell AS (SELECT grid.y, grid.p, count(pred.vec_id) AS n FROM grid LEFT JOIN pred ON grid.y = pred.y AND grid.p = pred.p GROUP BY grid.y, grid.p)"
CLS = f"{B.PRED}, {GRID}, cls AS (SELECT c AS class, CAST(sum(CASE WHEN y = c THEN n ELSE 0 END) AS BIGINT) AS support, CAST(sum(CASE WHEN p = c THEN n ELSE 0 END) AS BIGINT) AS predicted, CAST(sum(CASE WHEN y = c AND p = c THEN n ELSE 0 END) AS BIGINT) AS hits FROM cell, (SELECT CAST(v AS INT) AS c FROM generate_series(0, 9) g(v)) GROUP BY c)"


@query("ag3_confusion", f"WITH {B.PRED}, {GRID} SELECT y, p, n FROM cell")
def _(spark, d):
    return metrics.confusion(B.predictions(spark, d), B.K)


@query("ag4_per_class", f"WITH {CLS} SELECT class, support, round(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 9) AS recall, round(CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END, 9) AS f1 FROM cls")
def _(spark, d):
    return metrics.per_class(B.predictions(spark, d), B.K).select("class", "support", *r9(precision="precision", recall="recall", f1="f1"))


@query("ag5_accuracy", f"WITH {B.PRED} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred")
def _(spark, d):
    return B.predictions(spark, d).agg(F.round(metrics.accuracy(), 9).alias("accuracy"))


@query("ag6_balanced_accuracy", f"WITH {CLS} SELECT round(avg(hits / support), 9) AS balanced_accuracy FROM cls WHERE support > 0")
def _(spark, d):
    return metrics.summary(B.predictions(spark, d), B.K).select(*r9(balanced_accuracy="balanced_accuracy"))


@query("ag7_macro_f1", f"WITH {CLS} SELECT round(avg(2 * hits / (support + predicted)), 9) AS macro_f1 FROM cls WHERE support + predicted > 0")
def _(spark, d):
    return metrics.summary(B.predictions(spark, d), B.K).select(*r9(macro_f1="macro_f1"))


@query("ag8_chance", f"WITH {B.PRED} SELECT round(100.0 / count(DISTINCT y), 9) AS chance_pct, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) * count(DISTINCT y), 9) AS ratio_vs_chance FROM pred")
def _(spark, d):
    return metrics.chance(B.predictions(spark, d)).select(*r9(chance_pct="chance_pct", ratio_vs_chance="ratio_vs_chance"))


@query("ag13_prediction_balance", f"WITH {B.PRED}, {GRID}, s AS (SELECT p, sum(n) AS n FROM cell GROUP BY p), q AS (SELECT n, n / (SELECT sum(n) FROM s) AS q FROM s) SELECT round(100 * max(q), 9) AS top_share_pct, round(100 * avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 9) AS never_pct, round(sum(CASE WHEN n > 0 THEN -q * ln(q) ELSE 0 END) / ln(10), 9) AS entropy FROM q")
def _(spark, d):
    return metrics.prediction_balance(metrics.confusion(B.predictions(spark, d), B.K), B.K).select(*r9(top_share_pct="top_share_pct", never_pct="never_pct", entropy="entropy"))


HALVES = f"{B.PRED}, h AS (SELECT CAST(vec_id / 4 AS BIGINT) % 2 AS half, y, p FROM pred)"


def _halves(spark, d):
    pred = B.predictions(spark, d).withColumn("half", F.expr("cast(round(vec_id / 4) as bigint) % 2"))
    return metrics.confusion(pred, B.K, keys=("half",))


@query("ag16_mean_confusion", f"WITH {HALVES}, g AS (SELECT half, CAST(a.v AS INT) AS y, CAST(b.v AS INT) AS p FROM (SELECT DISTINCT half FROM h), generate_series(0, 9) a(v), generate_series(0, 9) b(v)), c AS (SELECT g.half, g.y, g.p, count(h.y) AS n FROM g LEFT JOIN h ON g.half = h.half AND g.y = h.y AND g.p = h.p GROUP BY 1, 2, 3), s AS (SELECT y, p, n / greatest(sum(n) OVER (PARTITION BY half, y), 1) AS share FROM c) SELECT y, p, round(avg(share), 9) AS share FROM s GROUP BY y, p")
def _(spark, d):
    return metrics.mean_of_rows(_halves(spark, d), ("half",)).select("y", "p", *r9(share="share"))


@query("ag17_summed_confusion", f"WITH {B.PRED}, {GRID} SELECT y, p, round(n / greatest(sum(n) OVER (PARTITION BY y), 1), 9) AS share FROM cell")
def _(spark, d):
    return metrics.rows_of_sum(_halves(spark, d)).select("y", "p", *r9(share="share"))


@query("ml11_nearest_centroid", f"WITH {B.PRED} SELECT vec_id, CAST(y AS INT) AS y, CAST(p AS INT) AS p FROM pred")
def _(spark, d):
    return B.predictions(spark, d).select("vec_id", F.col("y").cast("int").alias("y"), F.col("p").cast("int").alias("p"))


@query("ag1_descriptive", f"WITH {B.FACT} SELECT db, method, round(avg(value), 9) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END, 9) AS sd, round(median(value), 9) AS median, round(min(value), 9) AS min, round(max(value), 9) AS max, count(*) AS n, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END / sqrt(count(*)), 9) AS sem FROM favg GROUP BY db, method")
def _(spark, d):
    return stats.descriptive(B.seed_averages(spark, d), ["db", "method"], "value", interval=False).select("db", "method", *r9(mean="mean", sd="sd", median="median", min="min", max="max"), "n", *r9(sem="sem"))


@query("ag1_descriptive_interval")
def _(spark, d):
    return stats.descriptive(B.seed_averages(spark, d), ["db", "method"], "value")


@query("ag2_population_sd", f"WITH {B.FACT} SELECT db, method, seed, round(stddev_pop(accuracy), 9) AS sd FROM fact GROUP BY db, method, seed")
def _(spark, d):
    return B.facts(spark, d).groupBy("db", "method", "seed").agg(F.round(F.stddev_pop("accuracy"), 9).alias("sd"))


@query("ag9_seed_then_subject", f"WITH {B.FACT} SELECT db, method, round(avg(value), 9) AS mean, count(*) AS subjects FROM favg GROUP BY db, method")
def _(spark, d):
    return B.seed_averages(spark, d).groupBy("db", "method").agg(F.round(F.avg("value"), 9).alias("mean"), F.count("*").alias("subjects"))


@query("ag10_data_volumes", f"WITH {B.FACT} SELECT db, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean FROM fact WHERE method IN ('1', '3') GROUP BY db")
def _(spark, d):
    return B.facts(spark, d).where("method in ('1', '3')").groupBy("db").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))


@query("ag11_main_table", f"WITH {B.FACT} SELECT db, method, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(avg(value) / 20, 9) AS x_chance, count(*) FILTER (WHERE value > 20) AS above FROM favg GROUP BY db, method")
def _(spark, d):
    return B.seed_averages(spark, d).groupBy("db", "method").agg(*r9(mean=F.avg("value"), sd=F.stddev_samp("value"), x_chance=F.avg("value") / 20), F.count_if(F.col("value") > 20).alias("above"))


@query("ag12_seed_stability", f"WITH {B.FACT}, s AS (SELECT db, method, seed, avg(accuracy) AS m FROM fact GROUP BY 1, 2, 3) SELECT db, method, round(max(CASE WHEN seed = 1995 THEN m END), 9) AS seed_1995, round(max(CASE WHEN seed = 1996 THEN m END), 9) AS seed_1996, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS sd FROM s GROUP BY db, method")
def _(spark, d):
    s = B.facts(spark, d).groupBy("db", "method", "seed").agg(F.avg("accuracy").alias("m"))
    wide = s.groupBy("db", "method").pivot("seed", [1995, 1996]).agg(F.first("m"))
    return wide.join(s.groupBy("db", "method").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")), ["db", "method"]).select("db", "method", *r9(seed_1995="1995", seed_1996="1996", mean="mean", sd="sd"))


@query("ag14_per_class_means", f"WITH {B.FACT}, c AS (SELECT db, method, subject_id, unnest(range(0, 3)) AS class_index, avg(accuracy) AS a FROM fact GROUP BY 1, 2, 3) SELECT db, method, CAST(class_index + 1 AS INT) AS class_index, round(avg(a / (class_index + 1)), 9) AS f1_mean FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    per = B.facts(spark, d).withColumn("f1", F.array(F.col("accuracy"), F.col("accuracy") / 2, F.col("accuracy") / 3)).select("db", "method", "subject_id", F.posexplode("f1").alias("c", "f1"))
    return per.groupBy("db", "method", "subject_id", "c").agg(F.avg("f1").alias("f1")).groupBy("db", "method", (F.col("c") + 1).alias("class_index")).agg(F.round(F.avg("f1"), 9).alias("f1_mean"))


@query("ag15_best_vs_base", f"WITH {B.FACT}, m AS (SELECT db, method, avg(value) AS mean, stddev_samp(value) AS sd FROM favg GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY mean DESC, method) AS r FROM m) SELECT b.db, b.method AS best, round(b.mean, 9) AS mean, round(b.sd, 9) AS sd, round(b.mean - m.mean, 9) AS improvement FROM b JOIN m ON b.db = m.db AND m.method = '1' WHERE r = 1")
def _(spark, d):
    m = B.seed_averages(spark, d).groupBy("db", "method").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    best = m.withColumn("r", F.row_number().over(Window.partitionBy("db").orderBy(F.desc("mean"), "method"))).where("r = 1")
    base = m.where("method = '1'").select("db", F.col("mean").alias("base"))
    return best.join(base, "db").select("db", F.col("method").alias("best"), *r9(mean="mean", sd="sd", improvement=F.col("mean") - F.col("base")))


@query("w9_best_method", f"WITH {B.FACT} SELECT db, arg_max(method, m) AS best FROM (SELECT db, method, avg(value) AS m FROM favg GROUP BY 1, 2) GROUP BY db")
def _(spark, d):
    return B.seed_averages(spark, d).groupBy("db", "method").agg(F.avg("value").alias("m")).groupBy("db").agg(F.max_by("method", "m").alias("best"))


@query("ag18_shift_summary", f"WITH {B.FACT} SELECT method, metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(median(v), 9) AS median, count(*) AS n FROM (SELECT method, 'before' AS metric, before AS v FROM favg UNION ALL SELECT method, 'after', after FROM favg) GROUP BY method, metric")
def _(spark, d):
    shift = B.seed_averages(spark, d).unpivot(["method"], ["before", "after"], "metric", "v")
    return shift.groupBy("method", "metric").agg(*r9(mean=F.avg("v"), sd=F.stddev_samp("v"), median=F.percentile("v", F.lit(0.5))), F.count("*").alias("n"))


@query("ag19_reduction", f"WITH {B.FACT}, r AS (SELECT db, method, 100 * (before - after) / before AS red FROM favg) SELECT db, method, round(avg(red), 9) AS mean, round(median(red), 9) AS median, round(min(red), 9) AS least, count(*) FILTER (WHERE red > 0) AS reduced FROM r GROUP BY db, method")
def _(spark, d):
    r = B.seed_averages(spark, d).withColumn("red", 100 * (F.col("before") - F.col("after")) / F.col("before"))
    return r.groupBy("db", "method").agg(*r9(mean=F.avg("red"), median=F.percentile("red", F.lit(0.5)), least=F.min("red")), F.count_if(F.col("red") > 0).alias("reduced"))


@query("ag20_dilation_summary", "SELECT p_size AS dilation, round(avg(p_retailprice), 9) AS mean, round(stddev_pop(p_retailprice), 9) AS sd, round(sum(p_retailprice), 4) AS total, count(*) AS n FROM part GROUP BY p_size")
def _(spark, d):
    return B.table(spark, d, "part").groupBy(F.col("p_size").alias("dilation")).agg(*r9(mean=F.avg("p_retailprice"), sd=F.stddev_pop("p_retailprice")), F.round(F.sum("p_retailprice"), 4).alias("total"), F.count("*").alias("n"))


@query("ag21_kernel_importance", "SELECT l_partkey AS kernel_id, round(avg(abs(l_discount - 0.05)), 9) AS mean, round(stddev_pop(abs(l_discount - 0.05)), 9) AS sd FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    a = F.abs(F.col("l_discount") - 0.05)
    return B.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("kernel_id")).agg(*r9(mean=F.avg(a), sd=F.stddev_pop(a)))


@query("jn9_positional_importance", "WITH k AS (SELECT l_partkey AS kernel_id, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS raw, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS coral FROM lineitem GROUP BY 1) SELECT kernel_id, round(coral - raw, 9) AS change, round((coral - raw) / (abs(raw) + 1e-12) * 100, 4) AS change_pct FROM k WHERE raw > 0.001 AND coral IS NOT NULL")
def _(spark, d):
    line = B.table(spark, d, "lineitem")
    side = lambda flag, name: line.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("kernel_id")).agg(F.avg("l_discount").alias(name))
    k = side("A", "raw").join(side("R", "coral"), "kernel_id").where("raw > 0.001")
    change = F.col("coral") - F.col("raw")
    return k.select("kernel_id", F.round(change, 9).alias("change"), F.round(change / (F.abs("raw") + 1e-12) * 100, 4).alias("change_pct"))


@query("ag23_timing", "SELECT event_type, round(avg(CASE WHEN user_id % 7 <> 0 THEN value END), 9) AS mean, round(stddev_samp(CASE WHEN user_id % 7 <> 0 THEN value END), 9) AS sd FROM events GROUP BY event_type")
def _(spark, d):
    nan = F.when(F.col("user_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    e = B.table(spark, d, "events").withColumn("t", nan)
    return e.groupBy("event_type").agg(*r9(mean=F.avg(stats.not_nan("t")), sd=F.stddev_samp(stats.not_nan("t"))))


@query("ag30_equality_audit", f"WITH {B.FACT} SELECT a.db, round(100 * avg(CASE WHEN abs(a.value - b.value) > 1e-9 THEN 1.0 ELSE 0.0 END), 9) AS differ_pct, round(max(abs(a.value - b.value)), 9) AS most FROM favg a JOIN favg b ON a.db = b.db AND a.subject_id = b.subject_id AND a.method = '2' AND b.method = '1' GROUP BY a.db")
def _(spark, d):
    pair = stats.against(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value", "1").where("method = '2'")
    return pair.groupBy("db").agg(*r9(differ_pct=100 * F.avg((F.abs("d") > 1e-9).cast("int")), most=F.max(F.abs("d"))))


@query("ag32_per_subject_wide", f"WITH {B.FACT} SELECT db, subject_id, {', '.join(f'''round(max(CASE WHEN method = '{m}' THEN value END), 9) AS m{m}''' for m in B.PRIORITIES)} FROM favg GROUP BY db, subject_id")
def _(spark, d):
    wide = B.seed_averages(spark, d).groupBy("db", "subject_id").pivot("method", list(B.PRIORITIES)).agg(F.first("value"))
    return wide.select("db", "subject_id", *[F.round(m, 9).alias(f"m{m}") for m in B.PRIORITIES])


@query("ag33_sweep", f"WITH {B.FACT} SELECT method AS param, seed AS value, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS sd, count(*) AS n, round((SELECT avg(accuracy) FROM fact WHERE method = '1' AND seed = 1995), 9) AS reference FROM fact GROUP BY method, seed")
def _(spark, d):
    f = B.facts(spark, d)
    ref = f.where("method = '1' and seed = 1995").agg(F.round(F.avg("accuracy"), 9).alias("reference"))
    return f.groupBy(F.col("method").alias("param"), F.col("seed").alias("value")).agg(*r9(mean=F.avg("accuracy"), sd=F.stddev_pop("accuracy")), F.count("*").alias("n")).crossJoin(F.broadcast(ref))


@query("ag35_multi_seed", f"WITH {B.FACT}, s AS (SELECT db, method, seed, avg(accuracy) AS a FROM fact GROUP BY 1, 2, 3) SELECT db, method, round(avg(a), 4) AS mean, round(stddev_pop(a), 4) AS sd, array_to_string(list(CAST(seed AS VARCHAR) ORDER BY seed), ',') AS seeds FROM s GROUP BY db, method")
def _(spark, d):
    s = B.facts(spark, d).groupBy("db", "method", "seed").agg(F.avg("accuracy").alias("a"))
    return s.groupBy("db", "method").agg(F.round(F.avg("a"), 4).alias("mean"), F.round(F.stddev_pop("a"), 4).alias("sd"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("seed")), lambda x: x.cast("string"))).alias("seeds"))


def _width_sql(width: int) -> str:
    step = width // 2
    return f"""SELECT CAST({width} AS INT) AS width, count(*) AS n, round(avg(m), 6) AS mean FROM (SELECT subject_id, w, avg(value) AS m
 FROM (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((i - {width - 1}) / {step}.0)) AS BIGINT), CAST(floor(i / {step}.0) AS BIGINT))) AS w FROM sig) GROUP BY 1, 2 HAVING count(*) = {width})"""


@query("ag36_window_ablation", f"WITH {B.SIG} " + " UNION ALL ".join(_width_sql(w) for w in (8, 16, 32)))
def _(spark, d):
    from kinetra.operators import segment

    out = None
    for width in (8, 16, 32):  # each width is a plan of its own over one scan
        part = segment.windows(B.signal(spark, d), ["subject_id"], width, 0.5, [F.avg("value").alias("m")]).agg(F.count("*").alias("n"), *r6(mean=F.avg("m"))).withColumn("width", F.lit(width))
        out = part if out is None else out.unionByName(part)
    return out


@query("ag37_mean_rank", f"WITH {B.MAT} SELECT method, round(avg(r), 9) AS mean_rank FROM (SELECT method, rank() OVER (PARTITION BY subject_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY subject_id, value) - 1) / 2 AS r FROM mat) GROUP BY method")
def _(spark, d):
    return stats.mean_ranks(B.matrix(spark, d), [], "subject_id", "method", "value").select("method", *r9(mean_rank="mean_rank"))


@query("w5_average_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2 AS r FROM lineitem")
def _(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return stats.with_average_ranks(rows, ["l_orderkey"], "l_quantity", "r").drop("l_quantity")


@query("flt6_complete_cases", f"WITH {B.MAT} SELECT subject_id, method, round(value, 6) AS value FROM mat WHERE subject_id IN (SELECT subject_id FROM mat GROUP BY 1 HAVING count(*) = 3)")
def _(spark, d):
    return stats.complete_cases(B.matrix(spark, d), [], "subject_id", "value", 3).select("subject_id", "method", *r6(value="value"))


@query("flt7_pairwise_mask", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey IS NOT NULL")
def _(spark, d):
    nan = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(float("nan"))
    return B.table(spark, d, "customer").withColumn("v", nan).where(stats.not_nan("v").isNotNull() & F.col("c_nationkey").isNotNull()).agg(F.count("*").alias("n"))


@query("flt8_exclude_errors", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(spark, d):
    o = B.table(spark, d, "orders").withColumn("error", F.when(F.col("o_orderstatus") == "P", "failed"))
    return o.where("error is null").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("flt9_subgroups", f"WITH {B.FACT} SELECT method, round(avg(value) FILTER (WHERE subject_id <= 19), 9) AS first, round(avg(value) FILTER (WHERE subject_id = 20), 9) AS s20, round(avg(value) FILTER (WHERE subject_id = 21), 9) AS s21 FROM favg GROUP BY method")
def _(spark, d):
    part = lambda c: F.avg(F.when(c, F.col("value")))
    s = F.col("subject_id")
    return B.seed_averages(spark, d).groupBy("method").agg(*r9(first=part(s <= 19), s20=part(s == 20), s21=part(s == 21)))


@query("prj4_percent_rounding", f"WITH {B.FACT} SELECT db, method, subject_id, round_even(value * 100, 2) AS pct FROM favg")
def _(spark, d):
    return B.seed_averages(spark, d).select("db", "method", "subject_id", F.bround(F.col("value") * 100, 2).alias("pct"))


@query("prj6_cleanup", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0.0 WHEN user_id % 3 = 1 THEN 1.0 ELSE round(value, 4) END AS v FROM events")
def _(spark, d):
    raw = F.when(F.col("user_id") % 3 == 0, float("nan")).when(F.col("user_id") % 3 == 1, float("inf")).otherwise(F.round("value", 4))
    return B.table(spark, d, "events").withColumn("r", raw).select("event_id", F.when(F.isnan("r"), 0.0).when(F.col("r") == float("inf"), 1.0).when(F.col("r") == float("-inf"), 0.0).otherwise(F.col("r")).alias("v"))


@query("jn1_aligned_matrix", f"WITH {B.MAT}, b AS (SELECT subject_id FROM mat WHERE method = 'A') SELECT b.subject_id, round(n.value, 6) AS n, round(r.value, 6) AS r FROM b LEFT JOIN mat n ON n.subject_id = b.subject_id AND n.method = 'N' LEFT JOIN mat r ON r.subject_id = b.subject_id AND r.method = 'R'")
def _(spark, d):
    m = B.matrix(spark, d)
    wide = m.groupBy("subject_id").pivot("method", ["A", "N", "R"]).agg(F.first("value")).where("A is not null")
    return wide.select("subject_id", *r6(n="N", r="R"))


@query("jn2_same_subjects", f"WITH {B.FACT}, k AS (SELECT db, method, array_to_string(list(DISTINCT subject_id ORDER BY subject_id), ',') AS s FROM fact GROUP BY 1, 2) SELECT db, count(DISTINCT s) = 1 AS same FROM k GROUP BY db")
def _(spark, d):
    sets = B.facts(spark, d).groupBy("db", "method").agg(F.sort_array(F.collect_set("subject_id")).alias("s"))
    return sets.groupBy("db").agg((F.count_distinct("s") == 1).alias("same"))


@query("jn3_all_pairs", f"WITH {B.FACT} SELECT a.db, a.method AS a, b.method AS b, count(*) AS n, round(avg(a.value - b.value), 9) AS mean_diff FROM favg a JOIN favg b ON a.db = b.db AND a.subject_id = b.subject_id AND a.method < b.method GROUP BY 1, 2, 3")
def _(spark, d):
    return stats.pairs(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value").groupBy("db", "a", "b").agg(F.count("*").alias("n"), *r9(mean_diff=F.avg("d")))


@query("jn4_one_vs_rest", f"WITH {B.FACT} SELECT a.db, a.method, round(avg(a.value - b.value), 9) AS gain FROM favg a JOIN favg b ON a.db = b.db AND a.subject_id = b.subject_id AND b.method = '1' WHERE a.method <> '1' GROUP BY 1, 2")
def _(spark, d):
    return stats.against(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value", "1").groupBy("db", "method").agg(*r9(gain=F.avg("d")))


PAIR = f"{B.FACT}, pr AS (SELECT a.db, a.subject_id, a.method AS a, b.method AS b, a.value AS x, b.value AS y, a.value - b.value AS d FROM favg a JOIN favg b ON a.db = b.db AND a.subject_id = b.subject_id AND a.method < b.method)"


def _pairs(spark, d):
    return stats.pairs(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value")


@query("jn12_effects_by_sign_flip", f"WITH {PAIR} SELECT db, b AS method, round(-avg(d), 9) AS delta, CAST(count(*) FILTER (WHERE d < 0) AS BIGINT) AS improve, CAST(count(*) FILTER (WHERE d > 0) AS BIGINT) AS worsen FROM pr WHERE a = '1' GROUP BY db, b")
def _(spark, d):
    e = stats.paired_effects(_pairs(spark, d).where("a = '1'"), ["db", "b"])
    return e.select("db", F.col("b").alias("method"), F.round(-F.col("mean_diff"), 9).alias("delta"), F.col("n_worsen").alias("improve"), F.col("n_improve").alias("worsen"))


@query("w11_sorted_differences", f"WITH {PAIR} SELECT db, b, subject_id, round(d, 9) AS d, row_number() OVER (PARTITION BY db, b ORDER BY d, subject_id) AS place FROM pr WHERE a = '1'")
def _(spark, d):
    p = _pairs(spark, d).where("a = '1'")
    place = F.row_number().over(Window.partitionBy("db", "b").orderBy("d", "subject_id")).cast("bigint")
    return p.select("db", "b", "subject_id", *r9(d="d"), place.alias("place"))


FR = f"{B.MAT}, rk AS (SELECT db, subject_id, method, rank() OVER (PARTITION BY db, subject_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY db, subject_id, value) - 1) / 2 AS r FROM mat), mr AS (SELECT db, method, avg(r) AS mr, count(*) AS n FROM rk GROUP BY 1, 2), fr AS (SELECT db, max(n) AS n, count(*) AS k, 12.0 * max(n) / (count(*) * (count(*) + 1)) * sum(power(mr - 2.0, 2)) AS chi2 FROM mr GROUP BY db HAVING count(*) = 3)"


@query("st1_friedman", f"WITH {FR} SELECT db, n, k, round(chi2, 9) AS chi2, round(chi2 * (n - 1) / (n * (k - 1) - chi2), 9) AS f FROM fr")
def _(spark, d):
    return stats.friedman(B.matrix(spark, d), ["db"], "subject_id", "method", "value").select("db", "n", "k", *r9(chi2="chi2", f="f"))


@query("st1_iman_davenport_p")
def _(spark, d):
    return stats.friedman(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value", tail=True)


@query("st2_nemenyi", f"WITH {FR} SELECT a.db, a.method AS a, b.method AS b, round(abs(a.mr - b.mr), 9) AS rank_diff, round(2.343 * sqrt(3 * 4 / (6.0 * a.n)), 9) AS cd, abs(a.mr - b.mr) > 2.343 * sqrt(3 * 4 / (6.0 * a.n)) AS significant FROM mr a JOIN mr b ON a.db = b.db AND a.method < b.method")
def _(spark, d):
    return stats.nemenyi(B.matrix(spark, d), ["db"], "subject_id", "method", "value").select("db", "a", "b", *r9(rank_diff="rank_diff", cd="cd"), "significant")


@query("st3_signed_ranks", f"WITH {PAIR}, z AS (SELECT *, rank() OVER (PARTITION BY db, a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY db, a, b, abs(d)) - 1) / 2 AS r FROM pr WHERE d <> 0) SELECT db, a, b, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM z GROUP BY db, a, b")
def _(spark, d):
    return stats.signed_ranks(_pairs(spark, d), ["db", "a", "b"]).select("db", "a", "b", "w_plus", "w_minus")


@query("st3_wilcoxon_exact_p")
def _(spark, d):
    return stats.signed_ranks(_pairs(spark, d), ["db", "a", "b"], exact=True)


@query("st4_rank_biserial", f"WITH {PAIR}, z AS (SELECT *, rank() OVER (PARTITION BY db, a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY db, a, b, abs(d)) - 1) / 2 AS r FROM pr) SELECT db, a, b, round(1 - 2 * least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) / (count(*) * (count(*) + 1) / 2), 9) AS rank_biserial FROM z GROUP BY db, a, b")
def _(spark, d):
    return stats.signed_ranks(_pairs(spark, d), ["db", "a", "b"]).select("db", "a", "b", *r9(rank_biserial="rank_biserial"))


PV = f"{PAIR}, pv AS (SELECT db, a, b, 1 / (1 + power(count(*) * abs(avg(d)) / sum(abs(d)), 2) * 40) AS p FROM pr GROUP BY db, a, b)"


def _p_values(spark, d):
    return _pairs(spark, d).groupBy("db", "a", "b").agg((1 / (1 + F.pow(F.count("*") * F.abs(F.avg("d")) / F.sum(F.abs("d")), 2) * 40)).alias("p"))


@query("st5_holm_sidak", f"WITH {PV}, s AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY p, a, b) - 1 AS i, count(*) OVER (PARTITION BY db) AS m FROM pv) SELECT db, a, b, round(p, 9) AS p, round(least(1, max(1 - power(1 - p, m - i)) OVER (PARTITION BY db ORDER BY p, a, b ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM s")
def _(spark, d):
    return stats.holm_sidak(_p_values(spark, d), ["db"], "p", ["a", "b"]).select("db", "a", "b", *r9(p="p", p_adjusted="p_adjusted"))


@query("st5_restricted_family", f"WITH {PV}, s AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY p, b) - 1 AS i, count(*) OVER (PARTITION BY db) AS m FROM pv WHERE a = '1') SELECT db, b, round(least(1, max(1 - power(1 - p, m - i)) OVER (PARTITION BY db ORDER BY p, b ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM s")
def _(spark, d):
    return stats.holm_sidak(_p_values(spark, d).where("a = '1'"), ["db"], "p", ["b"]).select("db", "b", *r9(p_adjusted="p_adjusted"))


@query("st6_cohens_d", f"WITH {PAIR}, c AS (SELECT db, a, b, CASE WHEN count(*) < 2 OR var_samp(x) + var_samp(y) = 0 THEN 0 ELSE (avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2) END AS d FROM pr GROUP BY db, a, b) SELECT db, a, b, round(d, 9) AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM c")
def _(spark, d):
    return stats.cohens_d(_pairs(spark, d), ["db", "a", "b"]).select("db", "a", "b", *r9(cohens_d="cohens_d"), "effect")


@query("st7_paired_dz", f"WITH {PAIR} SELECT db, a, b, count(*) AS n, round(avg(d), 9) AS mean_diff, round(avg(d) / stddev_samp(d), 9) AS d_z, CAST(count(*) FILTER (WHERE d > 0) AS BIGINT) AS n_improve, CAST(count(*) FILTER (WHERE d < 0) AS BIGINT) AS n_worsen FROM pr GROUP BY db, a, b")
def _(spark, d):
    return stats.paired_effects(_pairs(spark, d), ["db", "a", "b"]).select("db", "a", "b", "n", *r9(mean_diff="mean_diff", d_z="d_z"), "n_improve", "n_worsen")


@query("st8_spearman", f"WITH {B.FACT}, r AS (SELECT db, method, rank() OVER (PARTITION BY db, method ORDER BY value DESC) + (count(*) OVER (PARTITION BY db, method, value) - 1) / 2 AS x, rank() OVER (PARTITION BY db, method ORDER BY before DESC) + (count(*) OVER (PARTITION BY db, method, before) - 1) / 2 AS y FROM favg) SELECT db, method, round(corr(x, y), 9) AS rho FROM r GROUP BY db, method")
def _(spark, d):
    return stats.spearman(B.seed_averages(spark, d), ["db", "method"], "value", "before").select("db", "method", *r9(rho="rho"))


@query("st8_spearman_p")
def _(spark, d):
    return stats.spearman(B.seed_averages(spark, d), ["db", "method"], "value", "before", tail=True)


@query("ag29_bootstrap")
def _(spark, d):
    return stats.bootstrap(B.seed_averages(spark, d), ["db", "method"], "value", "subject_id", rounds=1000)


@query("ag29_bootstrap_large_groups")
def _(spark, d):
    """Groups of any number of rows: no group is one array."""
    return stats.poisson_bootstrap(B.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], rounds=1000)


@query("st9_bundle")
def _(spark, d):
    """Descriptive statistics, Friedman, Nemenyi, signed ranks and effects of each database as one long table."""
    return stats.bundle(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value")


@query("st9_descriptive_and_effects", f"""WITH {PAIR}, m AS (SELECT db, method, unnest(['mean', 'sd', 'median', 'min', 'max', 'n']) AS name, unnest([avg(value), CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END, median(value), min(value), max(value), CAST(count(*) AS DOUBLE)]) AS x FROM favg GROUP BY db, method),
 v AS (SELECT p.db, p.a, p.b, x.value AS va, y.value AS vb FROM pr p JOIN favg x ON p.db = x.db AND p.subject_id = x.subject_id AND p.a = x.method JOIN favg y ON p.db = y.db AND p.subject_id = y.subject_id AND p.b = y.method)
 SELECT db, 'descriptive' AS part, method AS a, NULL AS b, name, round(x, 6) AS x FROM m
 UNION ALL SELECT db, 'cohens_d', a, b, 'cohens_d', round(CASE WHEN count(*) < 2 OR sqrt((var_samp(va) + var_samp(vb)) / 2) = 0 THEN 0 ELSE (avg(va) - avg(vb)) / sqrt((var_samp(va) + var_samp(vb)) / 2) END, 6) FROM v GROUP BY db, a, b""")
def _(spark, d):
    told = stats.bundle(B.seed_averages(spark, d), ["db"], "subject_id", "method", "value")
    return told.where("part in ('descriptive', 'cohens_d')").select("db", "part", "a", "b", "name", *r6(x="x"))


@query("st10_stars", f"WITH {PV} SELECT db, a, b, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM pv")
def _(spark, d):
    return _p_values(spark, d).select("db", "a", "b", stats.stars("p").alias("stars"))


@query("st11_p_text", f"WITH {PV} SELECT db, a, b, CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', p) END AS p_text FROM pv")
def _(spark, d):
    return _p_values(spark, d).select("db", "a", "b", stats.p_text("p").alias("p_text"))


@query("st12_test_tables")
def _(spark, d):
    """Friedman, Nemenyi where it is significant, and adjusted signed-rank tests of each database as one long table."""
    m = B.seed_averages(spark, d)
    fr = stats.friedman(m, ["db"], "subject_id", "method", "value", tail=True)
    wil = stats.holm_sidak(stats.signed_ranks(_pairs(spark, d), ["db", "a", "b"], exact=True), ["db"], "p", ["a", "b"])
    nem = stats.nemenyi(m, ["db"], "subject_id", "method", "value").join(fr.where("p < 0.05").select("db"), "db", "left_semi")
    row = lambda df, test, a, b, x, p: df.select("db", F.lit(test).alias("test"), F.col(a).alias("a") if a else F.lit(None).cast("string").alias("a"), F.col(b).alias("b") if b else F.lit(None).cast("string").alias("b"), F.col(x).cast("double").alias("statistic"), (F.col(p) if p else F.lit(None)).cast("double").alias("p"))
    return row(fr, "friedman", None, None, "chi2", "p").unionByName(row(wil, "wilcoxon", "a", "b", "w_plus", "p_adjusted")).unionByName(row(nem, "nemenyi", "a", "b", "rank_diff", None)).unionByName(row(nem.select("db", "cd").distinct(), "CD", None, None, "cd", None))


@query("snk2_g6", "SELECT p_partkey, printf('%.6g', v) AS v, printf('%.6g', w) AS w FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS v, (p_partkey % 7 - 3) * pow(10.0, p_partkey % 23 - 11) * 1.25 AS w FROM part)")
def _(spark, d):
    from kinetra.sources.results import g6

    w = (F.col("p_partkey") % 7 - 3) * F.pow(F.lit(10.0), F.col("p_partkey") % 23 - 11) * 1.25
    return B.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"), w.alias("w")).select("p_partkey", *g6("v", "w"))


@query("snk12_phantom_row", "SELECT s_suppkey FROM supplier WHERE s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def _(spark, d):
    from kinetra.sources.results import drop_phantom_row

    own = B.table(spark, d, "supplier")
    last, n = own.agg(F.max("s_suppkey"), F.count("*")).first()
    own = own.withColumn("v", F.when(F.col("s_suppkey") == last, 0.0).otherwise(1.0))  # the whole table, its last row made empty
    return drop_phantom_row(own, "s_suppkey", ["v"], rows=n).select("s_suppkey")


TABLE41 = "t AS (SELECT CAST(p_partkey // 41 AS BIGINT) AS k, p_partkey, p_size % 3 AS v, p_size % 2 AS w FROM part WHERE p_partkey % 97 <> 5)"


def _tables_of_41(spark, d):
    own = B.table(spark, d, "part").where("p_partkey % 97 <> 5")
    return own.select(F.floor(F.col("p_partkey") / 41).cast("bigint").alias("k"), "p_partkey", (F.col("p_size") % 3).alias("v"), (F.col("p_size") % 2).alias("w"))


@query("snk12_phantom_verdicts", f"WITH {TABLE41}, l AS (SELECT k, count(*) AS n, arg_max(v = 0 AND w = 0, p_partkey) AS z FROM t GROUP BY k) SELECT k, n, CASE WHEN n <> 41 THEN 'other size' WHEN z THEN 'dropped' ELSE 'last row is not empty' END AS verdict FROM l")
def _(spark, d):
    """Tables of 41 parts, some a row short: what becomes of the last row of each."""
    from kinetra.sources.results import phantom_rows

    return phantom_rows(_tables_of_41(spark, d), "p_partkey", ["v", "w"], keys=("k",)).select("k", "n", "verdict")


@query("snk12_phantom_rows", f"WITH {TABLE41}, l AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, max(p_partkey) OVER (PARTITION BY k) AS last FROM t) SELECT k, p_partkey FROM l WHERE NOT (n = 41 AND p_partkey = last AND v = 0 AND w = 0)")
def _(spark, d):
    from kinetra.sources.results import drop_phantom_row

    return drop_phantom_row(_tables_of_41(spark, d), "p_partkey", ["v", "w"], keys=("k",)).select("k", "p_partkey")


@query("so3_limits", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(spark, d):
    return B.table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey")


@query("src12_completeness", f"WITH {B.FACT}, g AS (SELECT db, method, seed FROM (SELECT DISTINCT db FROM fact), (SELECT DISTINCT method FROM fact), (SELECT DISTINCT seed FROM fact)) SELECT g.db, g.method, g.seed FROM g LEFT JOIN (SELECT DISTINCT db, method, seed FROM fact WHERE n > 3) f ON g.db = f.db AND g.method = f.method AND g.seed = f.seed WHERE f.db IS NULL")
def _(spark, d):
    from kinetra.sources.results import missing

    f = B.facts(spark, d)
    grid = f.select("db").distinct().crossJoin(f.select("method").distinct()).crossJoin(f.select("seed").distinct())
    return missing(f.where("n > 3"), grid, ["db", "method", "seed"])


@query("src13_ablation_kinds", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'window' WHEN p_type LIKE '%BRASS%' THEN 'kernels' ELSE 'reg' END AS kind FROM part")
def _(spark, d):
    t = F.col("p_type")
    return B.table(spark, d, "part").select("p_partkey", F.when(t.contains("STEEL"), "window").when(t.contains("BRASS"), "kernels").otherwise("reg").alias("kind"))


@query("src14_width_check", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def _(spark, d):
    return B.table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id")
