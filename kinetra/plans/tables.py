"""Queries on result tables: fallbacks, projections, deduplication, pooled quantiles, caps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetra.operators import stats
from kinetra.plans import bindings as B
from kinetra.plans.registry import query, r6, r9


@query("prj5_summary_fallback", "SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, m), 6) AS mean FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, d):
    means = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    given = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))
    return B.table(spark, d, "customer").join(means, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.round(F.coalesce(given, "m"), 6).alias("mean"))


@query("ag34_main_rows", f"WITH {B.FACT} SELECT db, method, round(avg(accuracy), 9) AS mean, round(avg(macro_f1), 9) AS f1, count(*) AS folds FROM fact GROUP BY db, method")
def _(spark, d):
    summary = B.facts(spark, d).groupBy("db", "method").agg(F.struct(F.avg("accuracy").alias("mean"), F.avg("macro_f1").alias("f1"), F.count("*").alias("folds")).alias("summary"))
    return summary.select("db", "method", *r9(mean="summary.mean", f1="summary.f1"), "summary.folds")


@query("w10_subject_order", f"WITH {B.FACT} SELECT db, array_to_string(list(DISTINCT subject_id ORDER BY subject_id), ',') AS subjects FROM fact WHERE method = '1' GROUP BY db")
def _(spark, d):
    ids = F.transform(F.sort_array(F.collect_set("subject_id")), lambda x: x.cast("string"))
    return B.facts(spark, d).where("method = '1'").groupBy("db").agg(F.concat_ws(",", ids).alias("subjects"))


@query("src11_latest_result", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(spark, d):
    latest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return B.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(latest.alias("o_orderkey"))


@query("src17_cache_by_settings", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 40")
def _(spark, d):
    return B.table(spark, d, "lineitem").where("l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 40").select("l_orderkey", "l_linenumber")


@query("ag28_pooled_quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def _(spark, d):
    found = stats.pooled_quantiles(B.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q50": 0.5, "q90": 0.9})
    return found.select("l_returnflag", *r6(q50="q50", q90="q90"))


@query("sp5_two_way_caps", "SELECT l_shipmode_key, CAST(greatest(100, 6000 * ns // (ns + nt)) AS BIGINT) AS source_cap, CAST(greatest(50, 6000 * nt // (ns + nt)) AS BIGINT) AS target_cap FROM (SELECT l_linenumber AS l_shipmode_key, count(*) FILTER (WHERE l_returnflag <> 'R') AS ns, count(*) FILTER (WHERE l_returnflag = 'R') AS nt FROM lineitem GROUP BY 1) WHERE ns + nt > 0")
def _(spark, d):
    n = B.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("l_shipmode_key")).agg(F.count_if(F.col("l_returnflag") != "R").alias("ns"), F.count_if(F.col("l_returnflag") == "R").alias("nt"))
    return n.selectExpr("l_shipmode_key", "greatest(100L, 6000 * ns div (ns + nt)) source_cap", "greatest(50L, 6000 * nt div (ns + nt)) target_cap")


@query("so4_sorted_grid", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 20")
def _(spark, d):
    top = B.table(spark, d, "supplier").orderBy("s_acctbal", "s_suppkey").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy("s_acctbal", "s_suppkey")).cast("bigint")).select("s_suppkey", "place")
