"""Folds by sums against the same folds on rows."""

import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.config import Study
from kinetra.operators import adapt, folds, ridge, runner, split
from kinetra.plans import models
from kinetra.plans.registry import QUERIES

STUDY = Study(per_subject=40, pool=130, sa_components=4, coral_reg=1e-3)
METHODS = ("raw", "centering", "coral", "sa")


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(4)
    rows = []
    for subject, n in ((1, 60), (2, 30), (3, 50), (4, 55), (5, 1), (7, 45)):
        y = rng.integers(0, 4, n)
        x = rng.normal(size=(n, 9)) @ (np.eye(9) + 0.1 * subject * np.ones((9, 9))) + np.eye(9)[y] * 2 + subject / 3
        rows += [(subject, subject * 1000 + i, int(c), v.tolist(), [s for s in (42, 7) if rng.random() < 0.5]) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "subject_id int, row_id long, y int, features array<double>, held_seeds array<int>").repartition(5).cache()
    return df, rows


def plain_pool(rows, fold, study=STUDY):
    """Each subject's first rows of each class by hash, subjects until the cap, then the pool's first rows of each class."""
    key = lambda r: (hashlib.md5(f"{study.seed}:{r[1]}".encode()).hexdigest(), r[1])

    def stratified(some, most):
        if len(some) <= most:
            return some
        share = {c: max(1, int(np.floor(sum(r[2] == c for r in some) / len(some) * most))) for c in {r[2] for r in some}}
        return [r for c in share for r in sorted((r for r in some if r[2] == c), key=key)[: share[c]]]

    pool, before = [], 0
    for subject in sorted({r[0] for r in rows} - {fold}):
        if before >= study.pool:
            break
        mine = stratified([r for r in rows if r[0] == subject], study.per_subject)
        pool, before = pool + mine, before + len(mine)
    return stratified(pool, study.pool)


def pool_of(df):
    counts = folds.capped(df, STUDY).groupBy("subject_id").count().withColumnRenamed("count", "n")
    return split.source_pool(counts, df.selectExpr("subject_id fold").distinct(), STUDY.pool).select("fold", "subject_id")


def test_pools_are_those_of_rows(study):
    df, rows = study
    capped, pool = folds.capped(df, STUDY).cache(), pool_of(df)
    less = {(r.fold, r.row_id) for r in folds.dropped(capped, pool, STUDY).collect()}
    got = {}
    for r in pool.join(capped, "subject_id").collect():
        if (r.fold, r.row_id) not in less:
            got.setdefault(r.fold, set()).add(r.row_id)
    assert got == {f: {r[1] for r in plain_pool(rows, f)} for f in {r[0] for r in rows}} and less


def test_pool_sums_equal_row_sums(spark, study):
    df, rows = study
    wanted = spark.createDataFrame([(f, 42) for f in (1, 3, 7)], "fold int, seed int")
    sums = folds.fold_sums(df, pool_of(df), wanted, STUDY, 4).collect()
    for fold in (1, 3, 7):
        got = folds.assembled([(r.sign, r.tile, np.array(r.v)) for r in sums if r.fold == fold and r.kind == "source"])
        u = np.array([[1, *r[3], *np.eye(4)[r[2]]] for r in plain_pool(rows, fold)])
        assert np.allclose(got, u.T @ u, rtol=1e-9, atol=1e-9)
        for kind, held in (("calibration", True), ("final", False)):
            got = folds.assembled([(r.sign, r.tile, np.array(r.v)) for r in sums if r.fold == fold and r.kind == kind])
            u = np.array([[1, *r[3], *np.eye(4)[r[2]]] for r in rows if r[0] == fold and (42 in r[4]) == held])
            assert np.allclose(got, u.T @ u, rtol=1e-9)


def plain_fold(rows, fold, seed, method):
    """A fold on rows: adapt, standardise, measure, ridge on all rows by generalised cross-validation."""
    pool, own = plain_pool(rows, fold), [r for r in rows if r[0] == fold]
    xs, ys = np.array([r[3] for r in pool]), np.array([r[2] for r in pool])
    xc, xt = (np.array([r[3] for r in own if (seed in r[4]) == held]) for held in (True, False))
    yt = np.array([r[2] for r in own if seed not in r[4]])

    def z(a, b):
        sd = a.std(axis=0)
        return (a - a.mean(axis=0)) / sd, (b - a.mean(axis=0)) / sd

    before, a, t = runner.shift(*z(xs, xt)), xs, xt
    if method == "centering":
        a, t = xs - xs.mean(axis=0), xt - xs.mean(axis=0)
    elif method == "coral":
        a = (xs - xs.mean(axis=0)) @ adapt.coral_weights(np.cov(xs, rowvar=False), np.cov(xc, rowvar=False), STUDY.coral_reg) + xc.mean(axis=0)
    elif method == "sa":
        ps, pt = (adapt.subspace(np.cov(x, rowvar=False), 4) for x in (xs, xc))
        a, t = (xs - xs.mean(axis=0)) @ ps @ (ps.T @ pt), (xt - xc.mean(axis=0)) @ pt
    a, t = z(a, t)
    classes = np.unique(ys)
    target = np.where(ys[:, None] == classes, 1.0, -1.0)
    yc, best = target - target.mean(axis=0), None
    for alpha in ridge.ALPHAS:
        hat = a @ np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T)
        error = ((yc - hat @ yc) ** 2).sum() / len(a) / (1 - (np.trace(hat) + 1) / len(a)) ** 2
        if best is None or error < best[0]:
            best = (error, alpha, np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ yc))
    p = classes[np.argmax(t @ best[2] + target.mean(axis=0), axis=1)]
    after = runner.shift(a, t)
    return (*runner.scores(yt, p), best[1], before[0], after[0], before[1], after[1], len(xs), len(xc), len(xt)), np.abs(best[2]).mean(axis=1)


def test_results_equal_those_on_rows(spark, study):
    df, rows = study
    grid = [(f, m, s, "h") for f in (1, 2, 7) for m in METHODS for s in (42, 7)] + [(5, "coral", 42, "h")]
    wanted = spark.createDataFrame(grid, "subject_id int, method string, seed int, config_hash string")
    got = {(r.subject_id, r.method, r.seed): r for r in folds.run_by_sums(df, pool_of(df), wanted, STUDY).collect()}
    assert got.keys() == {g[:3] for g in grid}
    for f, m, s, _ in grid[:-1]:
        want, importance = plain_fold(rows, f, s, m)
        r = got[(f, m, s)]
        assert r.error is None and np.allclose([r[c] for c in runner.RESULT_ARROW.names[3:14]], want, rtol=1e-8, atol=1e-8), (f, m, s, r, want)
        assert np.allclose(r.importance, importance, rtol=1e-8)
    assert "too few rows" in got[(5, "coral", 42)].error


def test_wide_rows_come_in_tiles(spark):
    """More columns than a tile, and groups dealt over parts."""
    x = np.random.default_rng(2).normal(size=(60, 300))
    df = spark.createDataFrame([(int(i > 20), i % 3, v.tolist()) for i, v in enumerate(x)], "g int, y int, features array<double>").repartition(4)
    sums = folds.grams(df, ["g"], 3, most=10).collect()
    for g, keep in ((0, slice(0, 21)), (1, slice(21, 60))):
        u = np.concatenate((np.ones((60, 1)), x, np.eye(3)[np.arange(60) % 3]), axis=1)[keep]
        tiles = [(1.0, r.tile, np.array(r.v)) for r in sums if r.g == g]
        assert len(tiles) == 2 and np.allclose(folds.assembled(tiles), u.T @ u)


def test_folds_on_rows_share_their_pool(spark, monkeypatch):
    """Folds whose pools are alike take QR factors once, in place of a ridge each; results are those of each fold by itself."""
    rng = np.random.default_rng(8)
    rows = [(s, s * 100 + i, int(rng.integers(0, 3)), [42] if i % 3 == 0 else [], (rng.normal(size=6) * (1 + s / 9) + s / 5 + i % 3).tolist()) for s in range(14) for i in range(12)]
    df = spark.createDataFrame(rows, "subject_id int, row_id bigint, y int, held_seeds array<int>, features array<double>")
    study = Study(per_subject=10, pool=40, ridge_rows=30, tca_rows=36, tca_components=3, sa_components=3)
    counts = folds.capped(df.select("subject_id", "row_id", "y"), study).groupBy("subject_id").agg(F.count("*").alias("n"))
    pool = split.source_pool(counts, counts.select(F.col("subject_id").alias("fold")), study.pool).select("fold", "subject_id")
    methods = ("raw", "centering", "coral", "tca", "sa")
    asked = spark.createDataFrame([(s, m, seed) for s in range(14) for m in methods for seed in (42, 7)], "subject_id int, method string, seed int").withColumn("config_hash", F.lit("h"))
    taken, used = folds.capped(df, study).collect(), pool.collect()
    left = {(r.fold, r.row_id) for r in folds.dropped(folds.capped(df.select("subject_id", "row_id", "y"), study), pool, study).collect()}
    for at_once in (1, 10**6):
        got = {(r.subject_id, r.method, r.seed): r for r in runner.run_folds(df, pool, asked, study, at_once).collect()}
        assert len(got) == 14 * 10
        for (fold, method, seed), r in got.items():
            of = {u.subject_id for u in used if u.fold == fold}
            src = sorted((t for t in taken if t.subject_id in of and (fold, t.row_id) not in left), key=lambda t: t.row_id)
            own = [t for t in rows if t[0] == fold]
            cal, final = ([t for t in own if (seed in t[3]) == held] for held in (True, False))
            x = lambda part: np.array([t[4] for t in part], float).reshape(-1, 6)
            args = x(src), np.array([t.y for t in src]), x(cal), x(final), np.array([t[2] for t in final]), method, replace(study, seed=seed)
            if len(cal) < 2 and method in ("coral", "tca", "sa"):
                assert "too few" in r.error
                continue
            want = runner.evaluate(*args)
            assert r.error is None and all(np.isclose(r[k], v, rtol=1e-6, atol=1e-8) for k, v in want.items()), (fold, method, seed)
    made, plain = [], ridge.Factored.__init__
    monkeypatch.setattr(ridge.Factored, "__init__", lambda self, *a: (made.append(1), plain(self, *a))[1])
    monkeypatch.setattr(ridge, "fit", lambda *a, **k: pytest.fail("a ridge on a fold's own copy of its pool"))
    source = runner.Source(*args[:2])
    for method in methods:
        assert np.isclose(runner.evaluated(source, x(own), x(own), np.array([t[2] for t in own]), method, study)["n_train"], len(src))
    assert len(made) == 1


def test_folds_without_a_cap_learn_from_all_rows_of_all_others(spark):
    """Every value equals a fold on all rows by itself, whatever the blocks; rows that repeat across subjects count each."""
    rng = np.random.default_rng(9)
    rows = [(s, s * 100 + i, int(rng.integers(0, 3)), [42] if i % 3 == 0 else [], (rng.normal(size=6) * (1 + s / 9) + s / 5 + i % 3).tolist()) for s in range(9) for i in range(12)]
    rows += [(s, s * 100 + 50 + i, y, [7], x) for s in (2, 3, 20) for i, (_, _, y, _, x) in enumerate(rows[:5])] + [(30, 3000, 1, [], [0.0] * 6)]
    df = spark.createDataFrame(rows, "subject_id int, row_id bigint, y int, held_seeds array<int>, features array<double>").repartition(3)
    study, methods = Study(pool=None, per_subject=5, tca_rows=20, ridge_rows=20, tca_components=3, sa_components=3), ("raw", "centering", "coral", "tca", "sa")
    asked = spark.createDataFrame([(s, m, seed) for s in sorted({r[0] for r in rows}) for m in methods for seed in (42, 7)], "subject_id int, method string, seed int").withColumn("config_hash", F.lit("h"))
    every = replace(study, tca_rows=10**6, ridge_rows=10**6)
    for at_once, rows_at_once in ((512, 8192), (2, 25)):
        got = {(r.subject_id, r.method, r.seed): r for r in runner.run_whole(df, asked, study, at_once, rows_at_once).collect()}
        assert len(got) == 11 * 10
        for (fold, method, seed), r in got.items():
            src = sorted((t for t in rows if t[0] != fold), key=lambda t: t[1])
            own = [t for t in rows if t[0] == fold]
            cal, final = ([t for t in own if (seed in t[3]) == held] for held in (True, False))
            x = lambda part: np.array([t[4] for t in part], float).reshape(-1, 6)
            if not final or (len(cal) < 2 and method in ("coral", "tca", "sa")):
                assert "too few" in r.error
                continue
            want = runner.evaluate(x(src), np.array([t[2] for t in src]), x(cal), x(final), np.array([t[2] for t in final]), method, replace(every, seed=seed))
            assert r.error is None and r.n_train == len(rows) - len(own)
            assert all(v != v if r[k] is None else np.isclose(r[k], v, rtol=1e-6, atol=1e-8) for k, v in want.items()), (fold, method, seed, r, want)


def test_leave_one_subject_out_takes_pools_of_more_than_2000_rows(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(s, s * 1000 + i, int(rng.integers(0, 3)), 1 + i % 4, rng.normal(size=5).round(3).tolist()) for s in range(5) for i in range(600)]
    df = spark.createDataFrame(rows, "subject_id int, row_id bigint, y int, rep int, features array<double>")
    monkeypatch.setattr(models, "_features", lambda spark, d: df)
    got = QUERIES["ex1_leave_one_subject_out"](spark, "").collect()
    assert len(got) == 5 * 4 and all(r.error is None and r.n_train == 2400 and r.n_calibration + r.n_test == 600 for r in got)
