"""Splits by repetition, stratified samples and source pools; all draws are by hash, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed(seed: int, *columns: str) -> Column:
    """An order that looks random and that any engine can compute: md5 of seed and values, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def repetition_split(df: DataFrame, label: str, rep: str, share: float, order: Column | None = None, seed: int = 42, least: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a (keys, class, repetition): side 'held' or 'kept', and warned where the class has too few to split.

    Of a class's n repetitions max(least, round(n * share)) are held, n - least at most; Python's round to even.
    The unit is the repetition, never the window, so that overlapping windows stay on one side.
    order: what ranks the repetitions of a class (default: a hash of seed, class and repetition).
    """
    if not 0 < share < 1:
        raise ValueError("share must lie in (0, 1)")
    units = df.select(*keys, label, rep).distinct()
    by = Window.partitionBy(*keys, label)
    ranked = units.withColumns({"_n": F.count("*").over(by), "_k": F.row_number().over(by.orderBy(order if order is not None else hashed(seed, label, rep), rep))})
    held = F.least(F.greatest(F.lit(least), F.bround(F.col("_n") * share).cast("int")), F.col("_n") - least)
    short = F.col("_n") < 2 * least
    return ranked.select(*keys, label, rep, F.when(~short & (F.col("_k") <= held), "held").otherwise("kept").alias("side"), short.alias("warned"))


def seeded_split(df: DataFrame, label: str, rep: str, share: float, seeds: tuple[int, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a (keys, class, repetition) with held_seeds: the seeds in which repetition_split holds it."""
    units = df.select(*keys, label, rep).distinct()
    out = None
    for seed in seeds:
        part = repetition_split(units, label, rep, share, seed=seed, keys=keys).withColumn("_seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, label, rep).agg(F.sort_array(F.collect_set(F.when(F.col("side") == "held", F.col("_seed")))).alias("held_seeds"))


def split_summary(assigned: DataFrame, label: str, rep: str) -> DataFrame:
    """Rows, classes and repetitions of each side, of windows joined with their side."""
    return assigned.groupBy("side").agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes"), F.count_distinct(rep).alias("reps"))


def stratified(df: DataFrame, label: str, most: int, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """At most `most` rows of each keys group: floor of each class's share, one at least; all if there are no more.

    No class gives more than its first `most` rows, so these are found within salted parts of it first: a class with
    a large share of all rows is not one task's. Sizes are counts by class, joined to what is left.
    """
    part = [*keys, label]
    salt = F.pmod(F.xxhash64(*order), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = df.withColumn("_salt", salt).withColumn("_k", rank(*part, "_salt")).where(F.col("_k") <= most)
    ranked = first.withColumn("_k", rank(*part)).where(F.col("_k") <= most)
    classes = df.groupBy(*part).agg(F.count("*").alias("_c"))
    sizes = classes.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys, F.lit(0)))).select(*[F.col(c).alias(f"_of_{c}") for c in part], "_c", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part]
    quota = F.when(F.col("_n") <= most, F.lit(most)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_c") / F.col("_n") * most)))
    return ranked.join(sizes, same).where(F.col("_k") <= quota).select(*df.columns)


def exact_sample(df: DataFrame, n: int, seed: int, *identity: str) -> DataFrame:
    """n rows by hash of their identity."""
    return df.orderBy(hashed(seed, *identity), *identity).limit(n)


def source_pool(counts: DataFrame, folds: DataFrame, cap: int, subject: str = "subject_id", n: str = "n") -> DataFrame:
    """(fold, subject, n): sources of each fold in order of id until their windows reach the cap; the one that reaches it is in.

    counts: one row a subject, subjects without windows are passed over; folds: one row a held-out subject. A subject
    has a window at least, so every fold's pool lies among the first cap + (windows of the largest subject) subjects:
    these alone are summed up and broadcast, and each fold leaves its own windows out of the sums after it.
    """
    some = counts.where(F.col(n) > 0).select(subject, n)
    bound = cap + int(some.agg(F.max(n)).first()[0] or 0)
    first = some.orderBy(subject).limit(bound)
    first = first.withColumn("_before", F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(subject)) - F.col(n)).where(F.col("_before") < bound)
    own = some.select(F.col(subject).alias("fold"), F.col(n).alias("_own"))
    held = folds.join(own, "fold", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    before = F.col("_before") - F.when(F.col("fold") < F.col(subject), F.col("_own")).otherwise(0)
    return held.join(F.broadcast(first), (F.col("fold") != F.col(subject)) & (before < cap)).drop("_before", "_own")


def pack_repetitions(reps: DataFrame, keys: list[str], cap: int, order: str, size: str = "n", rep: str = "rep") -> DataFrame:
    """Greedy packing: repetitions in order are taken while they fit; one that overflows is passed over, but the first.

    An ordered fold over each group's array of (order, rep, size): no Python.
    """
    kind = T.StructType([T.StructField("total", T.LongType()), T.StructField("reps", T.ArrayType(reps.schema[rep].dataType))])
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rep).alias("r"), F.col(size).cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(kind["reps"].dataType).alias("reps"))

    def take(state: Column, x: Column) -> Column:
        fits = (F.size(state["reps"]) == 0) | (state["total"] + x["n"] <= cap)
        return F.struct(F.when(fits, state["total"] + x["n"]).otherwise(state["total"]).alias("total"), F.when(fits, F.concat(state["reps"], F.array(x["r"]))).otherwise(state["reps"]).alias("reps"))

    packed = reps.groupBy(*keys).agg(F.aggregate(rows, start, take).alias("_p"))
    return packed.select(*keys, F.col("_p.total").alias("total"), F.col("_p.reps").alias("reps"))


def leaks(side_a: DataFrame, side_b: DataFrame, label: str, rep: str) -> DataFrame:
    """(class, repetition) units on both sides: must be empty."""
    return side_a.select(label, rep).intersect(side_b.select(label, rep))
