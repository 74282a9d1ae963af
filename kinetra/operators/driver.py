"""Studies of whole databases: recordings to windows, shared features, folds; a rerun takes up what is missing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra import config
from kinetra.config import Database, Study
from kinetra.durable import staged
from kinetra.operators import folds, rocket, runner, segment, split
from kinetra.sources import cache, recordings, results


def windows(samples: DataFrame, base: Database, labels: DataFrame, study: Study) -> DataFrame:
    """row_id, subject_id, y, rep and x (channels one after another) of each window of a movement's trial.

    samples: path, subject_id, sample_idx, emg, stimulus, repetition. labels: movement_id and class_idx. A trial's samples
    are one array (seconds of signal); windows are cut out of it without a shuffle. Labels that the map lacks go.
    """
    marked = segment.with_trials(samples.withColumn("emg", segment.fit_channels("emg", base.n_channels)), ["path", "subject_id"], "sample_idx").where("_s > 0")
    trials = marked.groupBy("path", "subject_id", "trial_id").agg(F.first("_s").alias("stimulus"), F.first("_r").alias("rep"), F.sort_array(F.collect_list(F.struct("sample_idx", "emg")))["emg"].alias("x"))
    known, _ = segment.keep_labels(trials.where(F.size("x") >= study.min_trial), labels, "stimulus")
    cut = segment.window_arrays(known, "x", study.width(base.sampling_rate), study.overlap)
    by_channel = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(base.n_channels - 1)), lambda c: F.transform("x", lambda v: F.get(v, c))))
    return cut.select(F.xxhash64("path", "trial_id", "window_id").alias("row_id"), F.col("subject_id").cast("int").alias("subject_id"), F.col("class_idx").alias("y"), "rep", by_channel.alias("x"))


def planned(features: DataFrame, study: Study, name: str, methods: Iterable[str], seeds: tuple[int, ...], held_out: int | None = None, kind: str = "rows") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(rows with the seeds that hold them, pool, folds) of a study over shared features (row_id, subject_id, y, rep, features).

    Each seed holds other repetitions of the target. held_out: as many subjects, the first ids, are targets; all are sources.
    A subject counts in pools with the rows that it gives to them, study.per_subject at most. The pool is None where study.pool is:
    all other subjects.
    """
    sides = split.seeded_split(features, "y", "rep", study.calibration, seeds, keys=("subject_id",))
    rows = features.join(sides, ["subject_id", "y", "rep"])
    if study.pool is None:
        subjects = rows.select("subject_id").distinct()
        targets = subjects if held_out is None else subjects.orderBy("subject_id").limit(held_out)
        return rows, None, crossed(targets, study, name, methods, seeds, kind)
    counts = folds.capped(rows.select("subject_id", "row_id", "y"), study).groupBy("subject_id").agg(F.count("*").alias("n"))
    targets = counts.select("subject_id") if held_out is None else counts.select("subject_id").orderBy("subject_id").limit(held_out)
    pool = split.source_pool(counts, targets.select(F.col("subject_id").alias("fold")), study.pool).select("fold", "subject_id")
    return rows, pool, crossed(targets, study, name, methods, seeds, kind)


def crossed(targets: DataFrame, study: Study, name: str, methods: Iterable[str], seeds: tuple[int, ...], kind: str) -> DataFrame:
    """A row a target, method and seed, with the hash of the settings."""
    grid = targets.sparkSession.createDataFrame([(m, s) for m in methods for s in seeds], "method string, seed int")
    return targets.crossJoin(F.broadcast(grid)).withColumn("config_hash", runner.config_hash(study, name, kind))


def run(features: DataFrame, study: Study, name: str, methods: Iterable[str], seeds: tuple[int, ...], done: DataFrame | None = None, held_out: int | None = None) -> DataFrame:
    """Result rows of all pending (subject, method, seed) folds, on rows: all methods, ridge by exact leave-one-out."""
    rows, pool, asked = planned(features, study, name, methods, seeds, held_out)
    if pool is None:
        return runner.run_whole(rows, runner.pending(asked, done), study)
    return runner.run_folds(rows, pool, runner.pending(asked, done), study)


def run_by_sums(features: DataFrame, study: Study, name: str, methods: Iterable[str], seeds: tuple[int, ...], values: dict[str, tuple[float, ...]] | None = None, done: DataFrame | None = None, held_out: int | None = None, kind: str = "sums") -> DataFrame:
    """The same by sums (see folds): no row is copied per fold, whatever the pool; with kernel importance. Not for TCA.

    values: for a method, the settings to run it with, all from the same sums; they stand in the results as `value`.
    """
    rows, pool, asked = planned(features, study, name, methods, seeds, held_out, kind)
    asked = runner.pending(asked, done)
    if values:
        every = [(m, float(v)) for m, vs in values.items() for v in vs]
        asked = asked.join(F.broadcast(features.sparkSession.createDataFrame(every, "method string, value double")), "method", "left")
    return folds.run_by_sums(rows, pool, asked, study)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table there, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def study_database(spark: SparkSession, database: str, folder: str, out: str, study: Study, extractor: str = "canonical", methods: tuple[str, ...] = config.METHODS, seeds: tuple[int, ...] = config.SEEDS, grouped: bool = False, held_out: int | None = None, base: Database | None = None, by_sums: bool = False) -> DataFrame:
    """A database's result rows: features are computed once and kept under out, results are added where they lack.

    Features become visible whole, by their manifest row (see sources.cache). A fold with an error is done again by a rerun; its row
    with the error is told only as long as it has no other. by_sums: folds by sums (TCA is left out), and each kernel's importance
    by fold is kept under out/importance, which a rerun takes up like the results.
    """
    base = base or config.DATABASES[database]
    labels = config.group_map(spark, database).withColumnRenamed("group_id", "class_idx") if grouped else spark.range(1, base.n_movements + 1).selectExpr("cast(id as int) movement_id", "cast(id - 1 as int) class_idx")
    name = f"{database}/{extractor}/{'grouped' if grouped else 'all'}"
    given = cache.settings(
        database=name, seed=study.seed, extractor=extractor, window_ms=study.window_ms, overlap=study.overlap, kernels=study.kernels, calibration=study.calibration,
        coral_reg=study.coral_reg, tca_components=study.tca_components, sa_components=study.sa_components, fit_mode=f"{study.min_trial} samples a trial",
    )

    def make() -> DataFrame:
        files, _ = recordings.quarantine(recordings.read(spark, folder))
        w = windows(files, base, labels, study)
        return rocket.Extractor(extractor, study.kernels, study.seed).fit(w, "x", "row_id", base.n_channels).transform(w, "x")

    features = cache.cached(spark, f"{out}/features", given, make)
    kind = "sums" if by_sums else "rows"
    done = stored(spark, f"{out}/results")
    done = None if done is None else done.where(F.col("database") == database)
    settings = spark.range(1).select(runner.config_hash(study, name, kind)).first()[0]
    if by_sums:
        fresh = staged(run_by_sums(features, study, name, [m for m in methods if m != "tca"], seeds, done=done, held_out=held_out, kind=kind))
        results.write_importance(fresh.where("error is null").select(F.lit(database).alias("database"), "method", "subject_id", "seed", "config_hash", F.posexplode("importance").alias("kernel_id", "importance")), f"{out}/importance")
        fresh = fresh.select(*[f.name for f in runner.RESULT_ARROW])
    else:
        fresh = run(features, study, name, methods, seeds, done, held_out)
    fresh.withColumn("database", F.lit(database)).write.mode("append").partitionBy("database").parquet(f"{out}/results")
    every = spark.read.parquet(f"{out}/results").where((F.col("database") == database) & (F.col("config_hash") == settings))
    good = every.where("error is null")
    fold = ["subject_id", "method", "seed"]
    return good.unionByName(every.where("error is not null").dropDuplicates(fold).join(good.select(*fold), fold, "left_anti"))


def study_all(spark: SparkSession, folders: dict[str, str], out: str, study: Study, **settings) -> dict[str, str | None]:
    """Each database's error, or None: one that fails leaves the others to run."""
    errors = {}
    for database, folder in folders.items():  # a few databases; each is a Spark job of its own
        try:
            study_database(spark, database, folder, out, study, **settings)
            errors[database] = None
        except Exception as e:  # noqa: BLE001 - told in the result, the other databases go on
            errors[database] = f"{type(e).__name__}: {str(e)[:300]}"
    return errors
