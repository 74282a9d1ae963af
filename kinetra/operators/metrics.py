"""Classification metrics as aggregations over (y, p) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, k: int, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """Dense k x k counts: keys, y, p, n (0 where no row)."""
    spark = df.sparkSession
    grid = spark.range(k).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(k).select(F.col("id").cast("int").alias("p")))  # k * k rows
    if keys:
        grid = df.select(*keys).distinct().crossJoin(F.broadcast(grid))
    counts = df.groupBy(*keys, F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count("*").alias("n"))
    return grid.join(counts, [*keys, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class(df: DataFrame, k: int, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, class, support, predicted, hits, precision, recall, f1 for all k classes; 0 where undefined."""
    cells = confusion(df, k, y, p, keys)
    hits = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    truth = cells.groupBy(*keys, F.col("y").alias("class")).agg(F.sum("n").alias("support"), hits.alias("hits"))
    said = cells.groupBy(*keys, F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = truth.join(said, [*keys, "class"])
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return both.withColumns({"precision": precision, "recall": recall}).withColumn("f1", _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def accuracy(y: str = "y", p: str = "p") -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("int"))


def summary(df: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, balanced accuracy (mean recall of classes with support), macro F1 (classes in truth or prediction)."""
    each = per_class(df, k, keys=keys)
    return each.groupBy(*keys).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(F.col("support") + F.col("predicted") > 0, F.col("f1"))).alias("macro_f1"),
    )


def chance(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Chance level in per cent by classes present, and accuracy against it (0 without a level)."""
    base = 100.0 / F.count_distinct(y)
    acc = accuracy(y, p) * 100
    return df.agg(base.alias("chance_pct"), F.when(base > 0, acc / base).otherwise(0.0).alias("ratio_vs_chance"))


def prediction_balance(cells: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of the most predicted class, share of classes never predicted, normalised entropy of predictions."""
    said = cells.groupBy(*keys, "p").agg(F.sum("n").alias("n"))
    q = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, F.lit(0)))
    said = said.withColumn("q", q)
    return said.groupBy(*keys).agg(
        (100 * F.max("q")).alias("top_share_pct"),
        (100 * F.avg((F.col("n") == 0).cast("int"))).alias("never_pct"),
        (F.sum(F.when(F.col("n") > 0, -F.col("q") * F.ln("q")).otherwise(0.0)) / F.ln(F.lit(float(k)))).alias("entropy"),
    )


def mean_of_rows(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean over keys of row-normalised confusion matrices; empty rows stay 0."""
    total = F.sum("n").over(Window.partitionBy(*keys, "y"))
    share = cells.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))
    return share.groupBy("y", "p").agg(F.avg("share").alias("share"))


def rows_of_sum(cells: DataFrame) -> DataFrame:
    """Confusion matrices summed first, then normalised by row."""
    total = cells.groupBy("y", "p").agg(F.sum("n").alias("n"))
    return total.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("y")), F.lit(1))).drop("n")
