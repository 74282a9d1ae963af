"""Caches that are either whole or absent: a manifest row makes an attempt's files visible, and readers compare it.

An attempt writes under a name of its own; nobody looks there. Its manifest row, written last and in one file, holds all
settings, the files and the rows. A job that dies in between leaves files that no row names, which clearing removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The settings that a fold's features depend on (fixed names); a reader compares every one.
FIELDS = ("database", "subject_id", "seed", "extractor", "window_ms", "overlap", "kernels", "calibration", "coral_reg", "tca_components", "sa_components", "fit_mode")
MANIFEST = ", ".join(["config_hash string", *(f"{f} string" for f in FIELDS), "place string", "files array<string>", "n_rows bigint", "written_at timestamp"])


def settings(**given) -> dict[str, str]:
    """All fields as JSON text, null where not given; an unknown name is an error."""
    unknown = set(given) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {f: json.dumps(given.get(f)) for f in FIELDS}


def config_hash(fields: dict):
    """A column: sha256 of the settings, in the order of FIELDS. A setting is JSON text, or a column of it where rows differ in it."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{f}="), F.lit(fields[f]) if isinstance(fields[f], str) else fields[f]) for f in FIELDS]), 256)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All manifest rows; none before the first write."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _listing(spark: SparkSession, path: str) -> set[str]:
    """Names of the data files under path, by the file system's own listing; none where it does not exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return set()
    found, each = set(), fs.listFiles(root, True)
    while each.hasNext():
        name = each.next().getPath()
        if name.getName().startswith("part-"):
            found.add(name.toString().split(path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1])
    return found


def write(df: DataFrame, folder: str, fields: dict[str, str]) -> str:
    """Write df and then its manifest row; returns the place. The row is the commit: without it nothing is visible."""
    spark, place = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/data/{place}")
    commit(spark, folder, fields, place)
    return place


def commit(spark: SparkSession, folder: str, fields: dict[str, str], place: str) -> None:
    """Make what stands at a place visible under these settings."""
    files = sorted(_listing(spark, f"{folder}/data/{place}"))
    rows = spark.read.parquet(f"{folder}/data/{place}").count() if files else 0
    own = spark.range(1).select(config_hash(fields).alias("config_hash"), *[F.lit(fields[f]).alias(f) for f in FIELDS], F.lit(place).alias("place"), F.array(*map(F.lit, files)).cast("array<string>").alias("files"), F.lit(rows).cast("bigint").alias("n_rows"), F.current_timestamp().alias("written_at"))
    own.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, fields: dict[str, str]) -> DataFrame | None:
    """What was last written under exactly these settings, or None: no row, another value of any setting, or a file that is gone."""
    same = F.lit(True)
    for f in FIELDS:
        same &= F.col(f) == F.lit(fields[f])
    kept = manifest(spark, folder).where((F.col("config_hash") == config_hash(fields)) & same).orderBy(F.col("written_at").desc(), "place")
    for row in kept.limit(8).collect():  # attempts of one setting
        if set(row.files) and set(row.files) <= _listing(spark, f"{folder}/data/{row.place}"):
            return spark.read.parquet(f"{folder}/data/{row.place}")
    return None


def cached(spark: SparkSession, folder: str, fields: dict[str, str], make) -> DataFrame:
    """The table under these settings, made by make() only where it is not there whole."""
    found = read(spark, folder, fields)
    if found is None:
        write(make(), folder, fields)
        found = read(spark, folder, fields)
    return found


def stale(spark: SparkSession, folder: str) -> DataFrame:
    """place, reason of what may be cleared: places that no manifest row names, rows that a later write of the same settings
    replaced, and rows whose files are gone. Folders of other names under data are not the cache's and are left alone."""
    rows = manifest(spark, folder)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    ours = [n for n in names if len(n) == 32 and set(n) <= set("0123456789abcdef")]
    there = spark.createDataFrame([(n,) for n in ours], "place string")
    orphan = there.join(rows, "place", "left_anti").select("place", F.lit("no manifest row").alias("reason"))
    last = rows.groupBy("config_hash").agg(F.max(F.struct("written_at", "place")).alias("last"))
    replaced = rows.join(last, "config_hash").where("place <> last.place").join(there, "place", "left_semi").select("place", F.lit("replaced").alias("reason"))
    return orphan.unionByName(replaced)


def clear(spark: SparkSession, folder: str, dry_run: bool = True) -> list[tuple[str, str]]:
    """The stale places and why; removed unless dry_run. What is named by a current row is never touched."""
    found = [(r.place, r.reason) for r in stale(spark, folder).orderBy("place").collect()]
    if not dry_run:
        jvm = spark._jvm
        for place, _ in found:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/data/{place}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found
