"""Validation of a database's folder, and per-class tables."""

from kinetra import config
from kinetra.sources import results


def test_a_path_is_looked_for_unless_the_cache_alone_counts(spark, tmp_path):
    spark.conf.unset("kinetra.path.db7")
    assert config.validated(spark, "db7") == (False, "set kinetra.path.db7") and not config.validated(spark, "db9")[0]
    spark.conf.set("kinetra.path.db7", str(tmp_path / "none"))
    assert config.validated(spark, "db7") == (False, f"{tmp_path}/none does not exist")
    (tmp_path / "file").write_text("x")
    spark.conf.set("kinetra.path.db7", str(tmp_path / "file"))
    assert config.validated(spark, "db7")[1].endswith("is no folder")
    spark.conf.set("kinetra.path.db7", str(tmp_path))
    assert config.validated(spark, "db7") == (True, str(tmp_path))
    spark.conf.set("kinetra.path.db7", str(tmp_path / "none"))
    spark.conf.set("kinetra.cache.only", "1")
    assert config.validated(spark, "db7") == (True, "cache only")
    for key in ("kinetra.cache.only", "kinetra.path.db7"):
        spark.conf.unset(key)


def test_per_class_tables(spark, tmp_path):
    for name, n, last in (("whole", 40, "7,0.5,0.5"), ("phantom", 41, "41,0,0"), ("full", 41, "41,0.2,0")):
        (tmp_path / f"{name}.csv").write_text("class,raw,coral\n" + "".join(f"{i},0.{i % 9},0.3\n" for i in range(1, n)) + last + "\n")
    for name, verdict, left in (("whole", "other size", 40), ("phantom", "dropped", 40), ("full", "last row is not empty", 41)):
        df = results.read_per_class(spark, str(tmp_path / f"{name}.csv"))
        assert results.phantom_rows(df, "class", ["raw", "coral"]).first().verdict == verdict
        assert results.drop_phantom_row(df, "class", ["raw", "coral"]).count() == left
