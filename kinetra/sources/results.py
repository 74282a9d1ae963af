"""Result tables: JSON, CSV and Parquet readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = {
    "subject_id": "int", "accuracy": "double", "balanced_accuracy": "double", "macro_f1": "double", "best_alpha": "double",
    "f1_per_class": "array<double>", "confusion_matrix": "array<array<bigint>>", "n_train_samples": "int", "n_test_samples": "int",
    "domain_shift": "struct<cov_before: double, cov_after: double, mmd_before: double, mmd_after: double>",
    "timing": "struct<adaptation: double, scaling: double, feature_fit: double>", "error": "string",
}
EXPERIMENT = (
    "experiment string, database string, method string, feature_extractor string, seed int, "
    "summary struct<mean: double, std: double, balanced_accuracy_mean: double, macro_f1_mean: double>, "
    f"per_subject array<struct<{', '.join(f'{k}: {v}' for k, v in FOLD.items())}>>"
)


def read_json(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Experiments, one a row. Files that are no JSON give a row of nulls and drop out."""
    return spark.read.schema(EXPERIMENT).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", glob).json(path).where("database is not null and method is not null")


def folds(experiments: DataFrame) -> DataFrame:
    """One row a fold; failed folds stay, with their error. The key holds extractor and seed too."""
    return experiments.select("database", "method", "feature_extractor", "seed", F.explode("per_subject").alias("f")).select("database", "method", "feature_extractor", "seed", "f.*")


def with_summary(experiments: DataFrame) -> DataFrame:
    """summary.mean where it is there, else the mean over per_subject, errors left out."""
    good = F.transform(F.filter("per_subject", lambda f: f["error"].isNull()), lambda f: f["accuracy"])
    return experiments.withColumn("mean_accuracy", F.coalesce("summary.mean", F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(good), F.lit(0))))


def missing(found: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Grid rows without a result."""
    return grid.join(found.select(*keys).distinct(), keys, "left_anti")


def require_complete(found: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    gone = missing(found, grid, keys).limit(5).collect()
    if gone:
        raise FileNotFoundError(f"no result for {', '.join(str(tuple(r)) for r in gone)}")
    return found


def require_same_subjects(df: DataFrame, keys: list[str], subject: str = "subject_id") -> DataFrame:
    """df, if each keys group has the same subjects within its first key."""
    sets = df.groupBy(*keys).agg(F.sort_array(F.collect_set(subject)).alias("s")).groupBy(keys[0]).agg(F.count_distinct("s").alias("n")).where("n > 1").limit(1).collect()
    if sets:
        raise ValueError(f"subjects differ within {sets[0][0]}")
    return df


def rename_shift_keys(experiments: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fields of per_subject.domain_shift under new names."""
    def one(f):
        shift = f["domain_shift"]
        kept = F.struct(*[shift[old].alias(new) for old, new in names.items()])
        return f.withField("domain_shift", F.when(shift.isNotNull(), kept))

    return experiments.withColumn("per_subject", F.transform("per_subject", one))


def g6(*columns: str) -> list:
    """Doubles as text with six significant digits, without trailing zeros; beyond 1e-4 and 1e6 with an exponent."""

    def text(c: str):
        parts = F.split(F.format_string("%.5e", c), "e")  # 1.25000e+02
        bare = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
        out = F.concat(bare(parts[0]), F.lit("e"), parts[1])
        for e in range(-4, 6):
            out = F.when(parts[1].cast("int") == e, bare(F.format_string(f"%.{5 - e}f", c))).otherwise(out)
        return F.when(F.col(c) == 0, F.lit("0")).otherwise(out).alias(c)

    return [text(c) for c in columns]


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Small result tables as one CSV with a fixed field order; other columns stay out; nothing for no rows."""
    if df.take(1):
        df.select(*fields).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature cache: Parquet by configuration, so that a reader prunes to its own."""
    df.write.mode("append").partitionBy("config_hash", "role").parquet(path)


def read_features(spark: SparkSession, path: str, config_hash: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("config_hash") == config_hash)


def latex(df: DataFrame, caption: str, p: str | None = None, best: str | None = None, most: int = 200) -> str:
    """A small table as LaTeX: an em dash for null and NaN, stars after column p, the row with the greatest `best` in bold.

    More than `most` rows are an error: such a table is no page's.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    stars = lambda x: "".join("*" for cut in (0.05, 0.01, 0.001) if x < cut)
    top = max((r[best] for r in rows if r[best] is not None), default=None) if best else None

    def cell(name: str, x, bold: bool) -> str:
        if x is None or x != x:
            return "---"
        text = ("$<$0.001" if x < 0.001 else f"{x:.3f}") + stars(x) if name == p else f"{x:.2f}" if isinstance(x, float) else str(x).replace("_", r"\_")
        return rf"\textbf{{{text}}}" if bold else text

    body = " \\\\\n".join(" & ".join(cell(c, r[c], top is not None and r[best] == top) for c in df.columns) for r in rows)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(c.replace('_', ' ') for c in df.columns)} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}\n"


def read_per_class(spark: SparkSession, path: str) -> DataFrame:
    """A per-class table: CSV with a header, one row a class; cells that are no number are null."""
    return spark.read.option("header", "true").option("inferSchema", "true").option("mode", "PERMISSIVE").csv(path)


def phantom_rows(df: DataFrame, order: str, values: list[str], rows: int = 41, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, verdict of each table of rows: 'dropped' (it has `rows` rows and its last holds only zeros), 'last row is not
    empty' (as many rows, another last one), or 'other size'."""
    zero = F.lit(True)
    for v in values:
        zero &= F.coalesce(F.col(v) == 0, F.lit(False))
    last = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by(zero, order).alias("_zero"), F.max(order).alias("_last"))
    verdict = F.when(F.col("n") != rows, "other size").when(F.col("_zero"), "dropped").otherwise("last row is not empty")
    return last.select(*keys, "n", "_last", verdict.alias("verdict"))


def drop_phantom_row(df: DataFrame, order: str, values: list[str], rows: int = 41, keys: tuple[str, ...] = ()) -> DataFrame:
    """df without the last row of each table (keys) that has `rows` rows and whose last row holds only zeros."""
    gone = phantom_rows(df, order, values, rows, keys).where("verdict = 'dropped'").select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], "_last")
    return df.join(gone, [*[F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)], F.col(order) == F.col("_last")], "left_anti")


def write_experiments(folds: DataFrame, path: str, *keys: str) -> None:
    """Experiments as JSON lines: one a group of keys, with its summary over folds without an error and its folds."""
    good = lambda c: F.when(F.col("error").isNull(), F.col(c))
    summary = F.struct(F.avg(good("accuracy")).alias("mean"), F.stddev_pop(good("accuracy")).alias("std"), F.avg(good("balanced_accuracy")).alias("balanced_accuracy_mean"), F.avg(good("macro_f1")).alias("macro_f1_mean"))
    own = [c for c in folds.columns if c not in keys]
    folds.groupBy(*keys).agg(summary.alias("summary"), F.sort_array(F.collect_list(F.struct(*own))).alias("per_subject")).write.mode("overwrite").json(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """Kernel importance by fold: zstd Parquet, one folder a database and method; folds are added to those that are there."""
    importance.write.mode("append").option("compression", "zstd").partitionBy("database", "method").parquet(path)
