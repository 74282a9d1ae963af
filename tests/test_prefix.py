"""Running sums and ranks dealt by range, against window functions over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetra.operators import prefix, stats


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    out = [("hot", rnd.choice([None, 0.0, -1.5, 2.0, *range(40)]), rnd.choice([0.0, 1.0, -2.0, 3.0]), i) for i in range(3000)]
    out += [(rnd.choice(["a", "b", None]), rnd.random(), rnd.random(), i) for i in range(3000, 3400)] + [("one", 1.0, 0.0, 9999)]
    return spark.createDataFrame([(g, None if v is None else float(v), w, i) for g, v, w, i in out], "g string, v double, w double, id bigint").repartition(5).cache()


def test_running_sums_in_pieces(spark, rows):
    got = prefix.running(rows, ["g"], ["v", "id"], {"before": "id"})
    assert got.columns == ["g", "v", "w", "id", "before"]
    by = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("before", F.coalesce(F.sum("id").over(by), F.lit(0)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert prefix.running(rows.limit(0), ["g"], ["v"], {"before": "id"}).count() == 0


def test_a_group_of_all_rows_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 20_000).alias("v"), F.lit(1).alias("one"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.running(df, ["g"], ["v"], {"before": "one"})
        sizes = [n for n in got.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
        assert got.where("before <> v").count() == 0 and max(sizes) < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_no_window_over_a_whole_group(rows):
    for df in (stats.signed_ranks(rows.withColumnRenamed("v", "d"), ["g"]), stats.spearman(rows, ["g"], "v", "w")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("piece" in line or "_before" in line for line in windows)


def test_ranks_with_ties(rows):
    got = {(r.g, r.v): (r["rank"], r["count"]) for r in prefix.ranked(rows, ["g"], "v").collect()}
    want = rows.withColumn("r", stats.average_rank(["g"], "v", descending=False)).groupBy("g", "v").agg(F.max("r").alias("r"), F.count("*").alias("n"))
    assert got == {(r.g, r.v): (r.r, r.n) for r in want.collect()}


def plain_signed(values):
    some = sorted(abs(d) for d in values if d)
    rank = lambda xs, x: sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2
    return sum(rank(some, d) for d in values if d > 0), sum(rank(some, -d) for d in values if d < 0)


def test_signed_ranks_and_spearman_against_plain_sums(spark, rows):
    d = rows.select("g", F.when(F.col("g") == "hot", F.col("w")).otherwise(F.col("v") - 0.5).alias("d")).where("g is not null")
    got = {r.g: (r.w_plus, r.w_minus) for r in stats.signed_ranks(d, ["g"]).collect()}
    values = {}
    for r in d.collect():
        values.setdefault(r.g, []).append(r.d)
    want = {g: plain_signed(v) for g, v in values.items()}
    assert got.keys() == want.keys()
    assert all(got[g][k] is None and not want[g][k] or abs((got[g][k] or 0) - want[g][k]) < 1e-6 for g in got for k in (0, 1))
    pairs = rows.where("g is not null and v is not null")
    ranked = pairs.withColumns({"x": stats.average_rank(["g"], "v"), "y": stats.average_rank(["g"], "w")}).groupBy("g").agg(F.corr("x", "y").alias("rho"), F.count("*").alias("n"))
    a, b = ({r.g: (None if r.rho is None or r.rho != r.rho else round(r.rho, 9), r.n) for r in x.collect()} for x in (stats.spearman(pairs, ["g"], "v", "w"), ranked))
    assert a == b


def test_pooled_quantiles(spark, rows):
    """Equal to the exact percentile of whole groups, also in a group of nulls and over all rows."""
    df = rows.unionByName(rows.limit(2).selectExpr("'none' g", "cast(null as double) v", "w", "id"))
    got = {r.g: (r.a, r.b, r.c) for r in stats.pooled_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9, "c": 1.0}).collect()}
    want = {r.g: (r.a, r.b, r.c) for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("a", 0.5), ("b", 0.9), ("c", 1.0))]).collect()}
    assert got.keys() == want.keys() and got["none"] == (None, None, None)
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in got if g != "none")
    assert stats.pooled_quantiles(df, [], "v", {"a": 0.9}).first()[0] == pytest.approx(df.agg(F.percentile("v", F.lit(0.9))).first()[0], rel=1e-12)


def test_ranks_by_tasks_of_bounded_size(spark, rows):
    """More rows are more tasks; groups stay whole."""
    got = stats.with_average_ranks(rows, ["id"], "v", "r", rows=100)
    assert got.rdd.getNumPartitions() >= 34 and got.where("r <> 1").count() == 0
    got = {(r.g, r.id): r.r for r in stats.with_average_ranks(rows, ["g"], "v", "r", rows=100).collect()}
    assert got == {(r.g, r.id): r.r for r in rows.withColumn("r", stats.average_rank(["g"], "v")).collect()}
