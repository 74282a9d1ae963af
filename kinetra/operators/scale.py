"""Standardisation and distances between domains over rows with an array of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long(df: DataFrame, features: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, j (feature number), v."""
    return df.select(*keys, F.posexplode(features).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def moments(df: DataFrame, features: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, j, mean, var (divided by n): partial sums by feature; the shuffle is as wide as the feature list."""
    return long(df, features, keys).groupBy(*keys, "j").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def moment_arrays(df: DataFrame, features: str, eps: float = 1e-8) -> DataFrame:
    """One row: mu and sigma arrays; a sigma below eps counts as 1."""
    sd = F.sqrt("var")
    cells = F.sort_array(F.collect_list(F.struct("j", "mean", F.when(sd < eps, 1.0).otherwise(sd).alias("sd"))))
    return moments(df, features).agg(cells.alias("c")).select(F.col("c.mean").alias("mu"), F.col("c.sd").alias("sigma"))


def standardise(df: DataFrame, fitted: DataFrame, features: str) -> DataFrame:
    """(x - mu) / sigma of each row, by moments of the source alone; fitted is one row and is broadcast."""
    z = F.zip_with(F.zip_with(features, "mu", lambda x, m: x - m), "sigma", lambda x, s: x / s)
    return df.crossJoin(F.broadcast(fitted)).withColumn(features, z).drop("mu", "sigma")


def centre(df: DataFrame, fitted: DataFrame, features: str) -> DataFrame:
    """x - mu of the source."""
    return df.crossJoin(F.broadcast(fitted)).withColumn(features, F.zip_with(features, "mu", lambda x, m: x - m)).drop("mu", "sigma")


def covariance(df: DataFrame, features: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, j, cov (divided by n - 1) of all pairs of features, for up to about 100 of them.

    The products are formed within each row and summed map-side: what is shuffled is features squared rows a task.
    Wider features go by kinetra.operators.adapt.gram.
    """
    pair = F.explode(F.flatten(F.transform(features, lambda x, i: F.transform(features, lambda y, j: F.struct(i.alias("i"), j.alias("j"), x.cast("double").alias("x"), y.cast("double").alias("y"))))))
    return df.select(*keys, pair.alias("c")).groupBy(*keys, F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.covar_samp("c.x", "c.y").alias("cov"))


def covariance_distance(a: DataFrame, b: DataFrame, features: str) -> DataFrame:
    """Frobenius norm of the difference of covariances."""
    other = covariance(b, features).withColumnRenamed("cov", "_c")
    return covariance(a, features).join(other, ["i", "j"]).agg(F.sqrt(F.sum(F.pow(F.col("cov") - F.col("_c"), 2))).alias("distance"))


def linear_mmd(a: DataFrame, b: DataFrame, features: str) -> DataFrame:
    """Squared distance of means."""
    other = moments(b, features).select("j", F.col("mean").alias("_m"))
    return moments(a, features).join(other, "j").agg(F.sum(F.pow(F.col("mean") - F.col("_m"), 2)).alias("mmd2"))
