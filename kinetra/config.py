"""Databases, defaults and switches of the studies. Constants of published datasets and defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

METHODS = ("raw", "centering", "coral", "tca", "sa")
#: Centering changes nothing once features are standardised; tests between methods leave it out.
INFERENTIAL = ("raw", "coral", "tca", "sa")
SEEDS = (42, 123, 2024, 7, 999)
CORAL_GRID = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5)
COMPONENT_GRID = (10, 25, 50, 100, 200)
WINDOW_GRID_MS = (100, 200, 400, 800)
SAMPLE_GRID = (10_000, 25_000, 50_000)
#: What of a target's data each method may see.
PARADIGM = {"raw": "source only", "centering": "source only", "coral": "transductive", "tca": "transductive", "sa": "transductive"}


@dataclass(frozen=True)
class Database:
    """A database of recordings: its size, classes (ids 1..n_movements), channels, rate, and which files count."""

    n_subjects: int
    n_movements: int
    n_channels: int
    sampling_rate: int
    first_exercise_only: bool = False
    groups: dict[int, int] = field(default_factory=dict)


#: Functional group of each of 17 movements: grasp, wrist, rotation, precision, pinch, thumb (fixed values).
FUNCTIONS = (0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 5)

DATABASES = {
    "db7": Database(22, 40, 12, 2000),
    "db3": Database(11, 17, 12, 2000, first_exercise_only=True, groups=dict(zip(range(1, 18), FUNCTIONS, strict=True))),
    "db2": Database(40, 49, 12, 2000),
}


@dataclass(frozen=True)
class Study:
    """Settings of a run. Paths come from the session's configuration, kinetra.path.<database>.

    pool None: each fold on rows learns from all rows of all other subjects, whatever per_subject, tca_rows and ridge_rows say.
    """

    window_ms: int = 200
    overlap: float = 0.5
    min_trial: int = 100
    kernels: int = 10_000
    coral_reg: float = 1e-3
    tca_components: int = 50
    tca_mu: float = 1.0
    tca_rows: int = 6000
    sa_components: int = 50
    calibration: float = 0.5
    test_share: float = 0.2
    per_subject: int = 5000
    pool: int | None = 50_000
    ridge_rows: int = 8000
    seed: int = 42

    def width(self, rate: int) -> int:
        """Samples in a window: four at least."""
        return max(4, int(rate * self.window_ms / 1000))


def path(spark: SparkSession, database: str) -> str:
    found = spark.conf.get(f"kinetra.path.{database}", "")
    if not found:
        raise FileNotFoundError(f"set kinetra.path.{database}")
    return found


def validated(spark: SparkSession, database: str) -> tuple[bool, str]:
    """(whether a database's recordings can be read, why not). With kinetra.cache.only set nothing is looked for: features come
    from the cache alone. The folder is asked of its own file system, whatever that is."""
    if spark.conf.get("kinetra.cache.only", "").lower() in ("1", "true"):
        return True, "cache only"
    if database not in DATABASES:
        return False, f"unknown database {database}: one of {', '.join(DATABASES)}"
    try:
        where = path(spark, database)
    except FileNotFoundError as e:
        return False, str(e)
    root = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return False, f"{where} does not exist"
    return (True, where) if fs.getFileStatus(root).isDirectory() else (False, f"{where} is no folder")


def movement_map(spark: SparkSession, database: str) -> DataFrame:
    """movement_id -> class_idx of a database, as a dimension table."""
    return spark.range(1, DATABASES[database].n_movements + 1).selectExpr("cast(id as int) movement_id", "cast(id - 1 as int) class_idx")


def group_map(spark: SparkSession, database: str) -> DataFrame:
    """movement_id -> group_id of a database with functional groups."""
    return spark.createDataFrame(sorted(DATABASES[database].groups.items()), "movement_id int, group_id int")
