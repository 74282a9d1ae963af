"""Analyses of stored results: in order, once for equal inputs, again for changed ones."""

import numpy as np
from pyspark.sql import functions as F

from kinetra.operators import analyses

FOLDS = "database string, subject_id int, method string, seed int, accuracy double, balanced_accuracy double, macro_f1 double, cov_before double, cov_after double, mmd_before double, mmd_after double, config_hash string, error string"


def test_what_has_not_changed_is_not_done_again(spark, tmp_path):
    rng, out = np.random.default_rng(0), str(tmp_path)
    rows = [(db, s, m, seed, float(rng.random()), 0.5, 0.4, 10.0, 10.0 - k * s / 9, 2.0, 1.0, "h", None) for db in ("a", "b") for s in range(1, 9) for k, m in enumerate(("raw", "coral", "sa")) for seed in (1, 2)]
    spark.createDataFrame([*rows, ("a", 1, "tca", 1, *[None] * 7, "h", "failed")], FOLDS).write.partitionBy("database").parquet(f"{out}/results")
    first = analyses.run(spark, out, ["a", "b", "none"])
    assert {(d, n) for d, n, state in first if state == "done"} == {(d, n) for d in ("a", "b") for n in ("subjects", "descriptive", "tests", "shift")}
    assert {n for d, n, state in first if state == "no input" and d == "a"} == {"kernels", "kernel_change"} and all(state == "no input" for d, _, state in first if d == "none")
    assert {state for _, _, state in analyses.run(spark, out, ["a", "b"])} == {"unchanged", "no input"}
    shift = {r.method: r for r in analyses.table(spark, out, "a", "shift").collect()}
    assert abs(shift["coral"].reduction - np.mean([s / 9 / 10 * 100 for s in range(1, 9)])) < 1e-9 and shift["coral"].n == shift["coral"].reduced == 8 and "tca" not in shift
    spark.createDataFrame([(m, s, 1, "h", k, float(k + s + (m == "coral"))) for m in ("raw", "coral") for s in (1, 2) for k in range(5)], "method string, subject_id int, seed int, config_hash string, kernel_id int, importance double").withColumn("database", F.lit("a")).write.partitionBy("database", "method").parquet(f"{out}/importance")
    spark.createDataFrame([("b", 9, "raw", 1, 0.5, 0.5, 0.4, 10.0, 9.0, 2.0, 1.0, "h", None)], FOLDS).write.mode("append").partitionBy("database").parquet(f"{out}/results")
    again = {(d, n): state for d, n, state in analyses.run(spark, out, ["a", "b"])}
    assert again["a", "kernels"] == again["a", "kernel_change"] == "done" and again["a", "tests"] == "unchanged" and again["b", "tests"] == again["b", "shift"] == "done"
    assert {r.change for r in analyses.table(spark, out, "a", "kernel_change").collect()} == {1.0}
    bad = dict(analyses.ANALYSES, descriptive=analyses.Analysis(("subjects",), lambda s: s.select("nothing")))
    told = {n: state for _, n, state in analyses.run(spark, out, ["a"], ["descriptive", "shift"], {k: v for k, v in bad.items()} | {"descriptive": analyses.Analysis(("shift",), lambda s: s.select("nothing"))})}
    assert told["descriptive"].startswith("AnalysisException") and told["shift"] == "unchanged"
