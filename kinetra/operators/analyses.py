"""Analyses of a study's stored results, each database by itself, in order of what they read; a rerun does what has changed.

An analysis is a function of tables. What it read is told by a fingerprint of their rows, and its result is kept under that
(see sources.cache): equal inputs are not analysed twice, and a result that was cut off is not there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import stats
from kinetra.operators.driver import stored
from kinetra.sources import cache


class Analysis(NamedTuple):
    """reads: stored tables (results, importance) or other analyses. make: of these tables, in that order."""

    reads: tuple[str, ...]
    make: Callable[..., DataFrame]


def by_subject(results: DataFrame) -> DataFrame:
    """Seeds averaged first: one value a (method, subject)."""
    return results.where("error is null").groupBy("config_hash", "method", "subject_id").agg(*[F.avg(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "cov_before", "cov_after", "mmd_before", "mmd_after")], F.count("*").alias("seeds"))


def shift(subjects: DataFrame) -> DataFrame:
    """Mean and spread over subjects of distances before and after, and of their relative reduction."""
    less = (F.col("cov_before") - F.col("cov_after")) / F.col("cov_before") * 100
    return subjects.groupBy("config_hash", "method").agg(F.avg("cov_before").alias("cov_before"), F.avg("cov_after").alias("cov_after"), F.avg(less).alias("reduction"), F.stddev_samp(less).alias("reduction_sd"), F.sum((less > 0).cast("bigint")).alias("reduced"), F.count("*").alias("n"))


def kernels(importance: DataFrame) -> DataFrame:
    """Each kernel's importance over folds."""
    return importance.groupBy("config_hash", "method", "kernel_id").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("sd"), F.count("*").alias("folds"))


def kernel_change(kernels: DataFrame) -> DataFrame:
    """Each method's kernels against the same kernels without adaptation."""
    raw = kernels.where("method = 'raw'").select("config_hash", "kernel_id", F.col("mean").alias("raw"))
    change = F.col("mean") - F.col("raw")
    return kernels.where("method <> 'raw'").join(raw, ["config_hash", "kernel_id"]).select("config_hash", "method", "kernel_id", change.alias("change"), (change / (F.abs("raw") + 1e-12) * 100).alias("change_pct"))


ANALYSES = {
    "subjects": Analysis(("results",), by_subject),
    "descriptive": Analysis(("subjects",), lambda s: stats.descriptive(s, ["config_hash", "method"], "accuracy")),
    "tests": Analysis(("subjects",), lambda s: stats.bundle(s, ["config_hash"], "subject_id", "method", "accuracy")),
    "shift": Analysis(("subjects",), shift),
    "kernels": Analysis(("importance",), kernels),
    "kernel_change": Analysis(("kernels",), kernel_change),
}


def fingerprint(df: DataFrame) -> str:
    """A text that changes with any row: their number and the sum of their hashes, whatever their order."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return f"{n} rows {total}"


def run(spark: SparkSession, out: str, databases: list[str], names: list[str] | None = None, analyses: dict[str, Analysis] = ANALYSES) -> list[tuple[str, str, str]]:
    """(database, analysis, 'done', 'unchanged', 'no input' or the error) of all analyses asked for and what they read."""
    told, tables, marks = [], {}, {}

    def wanted(database: str, name: str) -> bool:
        """Whether the table is there, made if it was not."""
        if (database, name) in marks:
            return marks[database, name] is not None
        marks[database, name] = None
        if name not in analyses:
            kept = stored(spark, f"{out}/{name}")
            kept = None if kept is None else kept.where(F.col("database") == database)
            if kept is not None and kept.take(1):
                tables[database, name], marks[database, name] = kept, fingerprint(kept)
            return kept is not None and marks[database, name] is not None
        one = analyses[name]
        if not all([wanted(database, r) for r in one.reads]):
            told.append((database, name, "no input"))
            return False
        given = cache.settings(database=database, fit_mode=[name, *[marks[database, r] for r in one.reads]])
        folder = f"{out}/analyses/{name}"
        try:
            found = cache.read(spark, folder, given)
            told.append((database, name, "done" if found is None else "unchanged"))
            if found is None:
                found = cache.cached(spark, folder, given, lambda: one.make(*[tables[database, r] for r in one.reads]))
        except Exception as e:  # noqa: BLE001 - told in the result; other analyses and databases go on
            told[-1:] = [(database, name, f"{type(e).__name__}: {str(e)[:200]}")]
            return False
        tables[database, name], marks[database, name] = found, fingerprint(found)
        return True

    for database in databases:
        for name in names or list(analyses):
            wanted(database, name)
    return told


def table(spark: SparkSession, out: str, database: str, name: str) -> DataFrame | None:
    """The last result of an analysis."""
    rows = cache.manifest(spark, f"{out}/analyses/{name}").where(F.col("database") == cache.settings(database=database)["database"]).orderBy(F.col("written_at").desc()).limit(1).collect()
    return spark.read.parquet(f"{out}/analyses/{name}/data/{rows[0].place}") if rows else None
