"""Caches: whole or absent, equal in every setting, cleared without touching what is current."""

import pytest

from kinetra.sources import cache


def fields(**more):
    return cache.settings(**({"database": "db7", "subject_id": 3, "seed": 42, "extractor": "canonical", "window_ms": 200, "overlap": 0.5, "kernels": 84, "calibration": 0.5, "coral_reg": 1e-3, "tca_components": 50, "sa_components": 50, "fit_mode": "full_train"} | more))


def test_a_table_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(100)

    for _ in range(3):
        assert cache.cached(spark, str(tmp_path), fields(), make).count() == 100
    assert len(made) == 1
    for name, value in (("seed", 7), ("overlap", 0.25), ("fit_mode", "sampled"), ("subject_id", None)):
        assert cache.read(spark, str(tmp_path), fields(**{name: value})) is None
    (row,) = cache.manifest(spark, str(tmp_path)).collect()
    assert row.n_rows == 100 and row.seed == "42" and len(row.config_hash) == 64 and row.written_at is not None
    with pytest.raises(ValueError, match="unknown settings: kernel"):
        cache.settings(kernel=3)


def test_a_killed_job_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(cache, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed between write and commit")))
        with pytest.raises(RuntimeError, match="killed"):
            cache.write(spark.range(5), folder, fields())
    assert cache.read(spark, folder, fields()) is None and cache.manifest(spark, folder).count() == 0
    assert cache.cached(spark, folder, fields(), lambda: spark.range(7)).count() == 7
    assert [r for _, r in cache.clear(spark, folder)] == ["no manifest row"]


def test_a_lost_file_is_a_miss(spark, tmp_path):
    folder = str(tmp_path)
    place = cache.write(spark.range(50).repartition(3), folder, fields())
    next((tmp_path / "data" / place).glob("part-*")).unlink()
    assert cache.read(spark, folder, fields()) is None
    assert cache.cached(spark, folder, fields(), lambda: spark.range(50)).count() == 50


def test_clearing_leaves_current_and_foreign_files(spark, tmp_path):
    folder = str(tmp_path)
    old, other = cache.write(spark.range(1), folder, fields()), cache.write(spark.range(2), folder, fields(seed=7))
    new = cache.write(spark.range(3), folder, fields())
    (tmp_path / "data" / "notes").mkdir()
    assert cache.clear(spark, folder) == [(old, "replaced")] and cache.read(spark, folder, fields()).count() == 3
    assert (tmp_path / "data" / old).exists()  # a dry run
    assert cache.clear(spark, folder, dry_run=False) == [(old, "replaced")]
    assert {p.name for p in (tmp_path / "data").iterdir()} == {new, other, "notes"} and cache.clear(spark, folder) == []
    assert cache.read(spark, folder, fields(seed=7)).count() == 2
