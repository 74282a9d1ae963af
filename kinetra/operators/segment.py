"""From labelled samples to trials and overlapping windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_index(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Number the samples of each recording from 0 in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def with_trials(df: DataFrame, keys: list[str], index: str = "i", stimulus: str = "stimulus", repetition: str = "repetition") -> DataFrame:
    """df with trial_id, a running number of (stimulus, repetition) runs.

    Sample 0 counts as rest whatever its label: a recording that begins in a movement loses that sample.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    now = [F.when(F.col(index) == 0, 0).otherwise(F.col(c)) for c in (stimulus, repetition)]
    marked = df.withColumns({"_s": now[0], "_r": now[1]})
    change = (F.col(index) > 0) & ((F.col("_s") != F.lag("_s").over(w)) | (F.col("_r") != F.lag("_r").over(w)))
    return marked.withColumn("trial_id", F.sum(change.cast("int")).over(w).cast("bigint"))


def trials(df: DataFrame, keys: list[str], min_len: int = 100, index: str = "i", **columns: str) -> DataFrame:
    """One row a trial of a movement with min_len samples at least: keys, trial_id, stimulus, repetition, start, end."""
    runs = with_trials(df, keys, index, **columns).groupBy(*keys, "trial_id").agg(
        F.first("_s").alias("stimulus"), F.first("_r").alias("repetition"), F.min(index).cast("bigint").alias("start"), (F.max(index) + 1).cast("bigint").alias("end")
    )
    return runs.where((F.col("stimulus") > 0) & (F.col("end") - F.col("start") >= min_len))


def step_of(width: int, overlap: float) -> int:
    return max(1, int(width * (1 - overlap)))


def exploded_windows(df: DataFrame, width: int, overlap: float, index: str = "i") -> DataFrame:
    """Each sample once for each window it lies in: df with window_id and pos (place in the window).

    Window w spans samples w * step to w * step + width - 1. Windows at the end may be incomplete.
    """
    step = step_of(width, overlap)
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - (width - 1)) / F.lit(step))).cast("bigint")
    last = F.floor(F.col(index) / F.lit(step)).cast("bigint")
    return df.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("pos", (F.col(index) - F.col("window_id") * step).cast("int"))


def windows(df: DataFrame, keys: list[str], width: int, overlap: float, aggregates: list[Column], index: str = "i") -> DataFrame:
    """One row a complete window: keys, window_id and the aggregates (over columns of df and pos)."""
    out = exploded_windows(df, width, overlap, index).groupBy(*keys, "window_id").agg(F.count("*").alias("_n"), *aggregates)
    return out.where(F.col("_n") == width).drop("_n")


def middle_label(label: str, width: int) -> Column:
    """A window's label: that of its middle sample."""
    return F.max(F.when(F.col("pos") == width // 2, F.col(label)))


def window_arrays(trial_arrays: DataFrame, column: str, width: int, overlap: float) -> DataFrame:
    """Windows cut out of one array a trial: the samples stay in place until here, and no shuffle follows."""
    step = step_of(width, overlap)
    count = F.floor((F.size(column) - width) / F.lit(step)) + 1
    return trial_arrays.withColumn("window_id", F.explode(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)))).withColumn(column, F.slice(F.col(column), F.col("window_id") * step + 1, width))


def fit_channels(column: str, channels: int) -> Column:
    """An array cut or zero-padded to a number of channels."""
    c = F.col(column)
    return F.when(F.size(c) >= channels, F.slice(c, 1, channels)).otherwise(F.concat(c, F.array_repeat(F.lit(0.0).cast("float"), channels - F.size(c))))


EXERCISES = {"E1": (1, 17), "E2": (18, 40), "E1+E2": (1, 40)}


def exercise_filter(label: str, exercise: str) -> Column:
    """Labels of an exercise; an unknown name keeps all."""
    lo, hi = EXERCISES.get(exercise, (None, None))
    return F.lit(True) if lo is None else F.col(label).between(lo, hi)


def keep_labels(df: DataFrame, movement_map: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose label the map has, with class_idx; count of the others by label)."""
    known = F.broadcast(movement_map)  # a dimension table of the database's classes
    kept = df.join(known, df[label] == known["movement_id"]).drop("movement_id")
    dropped = df.join(known, df[label] == known["movement_id"], "left_anti").groupBy(label).agg(F.count("*").alias("dropped"))
    return kept, dropped


def group_classes(df: DataFrame, group_map: DataFrame, label: str) -> DataFrame:
    """df with group_id by the map; labels without a group go. Drop rest rows before, so that group 0 stays."""
    known = F.broadcast(group_map)
    joined = df.join(known, df[label] == known["movement_id"], "left").withColumn("group_id", F.coalesce("group_id", F.lit(-1)))
    return joined.where("group_id >= 0").drop("movement_id")


def complete_windows(n: int, width: int, overlap: float) -> int:
    """How many windows n samples give."""
    return max(0, math.floor((n - width) / step_of(width, overlap)) + 1)
