"""Queries that SQL cannot say, against plain numpy on the same rows."""

import math

import numpy as np
import pytest

from kinetra.config import INFERENTIAL, Study
from kinetra.functions import special
from kinetra.operators import adapt, folds, ridge, rocket, runner, stats
from kinetra.plans import bindings as B
from kinetra.plans import evaluation, models  # noqa: F401
from kinetra.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    rows = B.embeddings(spark, SF).orderBy("vec_id").collect()
    return {r: (np.array([x.vec_id for x in rows if x.role == r]), np.array([x.features for x in rows if x.role == r], float), np.array([x.y for x in rows if x.role == r])) for r in ("source", "calibration", "final")}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def by_id(rows, role=None):
    return {r.vec_id: np.array(r.features) for r in rows if role is None or r.role == role}


def stacked(rows, ids):
    return np.array([rows[i] for i in ids])


def test_coral(spark, sides):
    (ids, xs, _), (_, xc, _) = sides["source"], sides["calibration"]
    got = stacked(by_id(run(spark, "ml15_coral")), ids)
    want = (xs - xs.mean(axis=0)) @ adapt.coral_weights(np.cov(xs, rowvar=False), np.cov(xc, rowvar=False), 1e-3) + xc.mean(axis=0)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(got.mean(axis=0), xc.mean(axis=0))


def test_subspace_alignment(spark, sides):
    (ids, xs, _), (calibrated, xc, _) = sides["source"], sides["calibration"]
    rows = run(spark, "ml17_subspace_alignment")
    ps, pt = (np.linalg.eigh(np.cov(x, rowvar=False))[1][:, ::-1][:, :16] for x in (xs, xc))
    got = stacked(by_id(rows, "calibration"), calibrated)
    assert np.allclose(np.abs(got - xc.mean(axis=0)[:16]), np.abs((xc - xc.mean(axis=0)) @ pt), atol=1e-6)
    a = stacked(by_id(rows, "source"), ids) - xc.mean(axis=0)[:16]
    want = (xs - xs.mean(axis=0)) @ ps @ (ps.T @ pt)
    assert np.allclose(np.abs(a), np.abs(want), atol=1e-6)


def test_transfer_components(spark, sides):
    (ids, xs, _), (calibrated, xc, _) = sides["source"], sides["calibration"]
    rows = run(spark, "ml16_tca")
    mean, sd, w = adapt.transfer_components(xs, xc, 16, 1.0)
    for role, at, x in (("source", ids, xs), ("calibration", calibrated, xc)):
        assert np.allclose(np.abs(stacked(by_id(rows, role), at)), np.abs((x - mean) / sd @ w), rtol=1e-5, atol=1e-5)


def test_gaussian_transfer_components(spark, sides):
    (ids, xs, _), (calibrated, xc, _) = sides["source"], sides["calibration"]
    rows = run(spark, "ml16_tca_gaussian")
    got = np.concatenate([stacked(by_id(rows, r), at) for r, at in (("source", ids), ("calibration", calibrated))])
    x = np.concatenate((xs, xc))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d2 = ((z[:, None] - z) ** 2).sum(axis=2)
    gamma = 1 / (2 * np.median(np.sqrt(d2[d2 > 1e-9])) ** 2 + 1e-12)
    w = adapt._components(np.exp(-gamma * d2), len(xs), 16, 1.0)
    want = np.exp(-gamma * d2) @ w
    q, r = np.linalg.qr(got)[0], np.linalg.qr(want)[0]
    assert got.shape == want.shape and np.linalg.norm(q - r @ (r.T @ q), 2) < 1e-4


def test_ridges(spark, sides):
    (_, xs, ys), (ids, xt, _) = sides["source"], sides["final"]
    p = dict(zip(ids.tolist(), ridge.fit(xs, ys).predict(xt).tolist(), strict=True))
    for name in ("ml9_ridge", "ml9_ridge_every_row"):  # fewer rows than the draw: both take all
        assert {r.vec_id: r.p for r in run(spark, name)} == p
    importance = np.abs(ridge.fit(xs, ys).coef).mean(axis=1)
    assert np.allclose([r.importance for r in sorted(run(spark, "ml24_kernel_importance"), key=lambda r: r.kernel_id)], importance, rtol=1e-6)
    classes = np.unique(ys)
    target, x = np.where(ys[:, None] == classes, 1.0, -1.0), xs - xs.mean(axis=0)
    best = None
    for a in ridge.ALPHAS:
        hat = x @ np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T)
        yc = target - target.mean(axis=0)
        error = ((yc - hat @ yc) ** 2).sum() / len(x) / (1 - (np.trace(hat) + 1) / len(x)) ** 2
        if best is None or error < best[0]:
            best = (error, np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T @ yc), target.mean(axis=0))
    want = classes[np.argmax((xt - xs.mean(axis=0)) @ best[1] + best[2], axis=1)]
    assert {r.vec_id: r.p for r in run(spark, "ml8_ridge_all_rows")} == dict(zip(ids.tolist(), want.tolist(), strict=True))


def test_dispatch_and_shift(spark, sides):
    (_, xs, _), (_, xc, _), (_, xt, _) = (sides[r] for r in ("source", "calibration", "final"))
    got = {(r.method, r.side): r for r in run(spark, "ml18_dispatch")}
    moved = (xs - xs.mean(axis=0)) @ adapt.coral_weights(np.cov(xs, rowvar=False), np.cov(xc, rowvar=False), 1e-3) + xc.mean(axis=0)
    for key, want in ((("raw", "source"), xs), (("raw", "target"), xt), (("centering", "target"), xt - xs.mean(axis=0)), (("coral", "source"), moved), (("coral", "target"), xt)):
        assert (got[key].n, got[key].width) == want.shape and np.allclose([got[key].total, got[key].squares], [want.sum(), (want**2).sum()], atol=1e-3)
    assert len(got) == 10 and {r.width for k, r in got.items() if k[0] in ("tca", "sa")} == {8}
    stage = {r.stage: r for r in run(spark, "ml21_shift_before_after")}
    for name, a in (("before", xs), ("after", moved)):
        assert np.isclose(stage[name].distance, np.linalg.norm(np.cov(a, rowvar=False) - np.cov(xt, rowvar=False))) and np.isclose(stage[name].mmd2, ((a.mean(axis=0) - xt.mean(axis=0)) ** 2).sum())


@pytest.mark.parametrize("name, extractor, kernels", [("ml3_custom_features", "custom_ppv", 64), ("ml5_canonical_features", "canonical", 168)])
def test_kernel_features(spark, name, extractor, kernels):
    windows = models._windows(spark, SF)
    got = {r.row_id: r.features for r in run(spark, name)}
    bank = rocket.Extractor(extractor, kernels).fit(windows, "x", "row_id", 2).bank
    for r in windows.orderBy("row_id").limit(20).collect():
        x = np.array(r.x, float).reshape(2, -1)
        for k in range(0, kernels, 7):
            signal, reach = x[bank.uses[k]].sum(axis=0), 8 * int(bank.dilation[k])
            signal = np.pad(signal, reach // 2) if bank.padded[k] else signal
            conv = [sum(bank.weights[k][j] * signal[i + j * int(bank.dilation[k])] for j in range(9)) for i in range(len(signal) - reach)]
            assert not conv or abs(got[r.row_id][k] - np.mean(np.array(conv) + bank.bias[k] > 0)) < 0.15  # a value at the very bias may fall to either side
            assert not conv or min(np.abs(np.array(conv) + bank.bias[k])) < 1e-4 or abs(got[r.row_id][k] - np.mean(np.array(conv) + bank.bias[k] > 0)) < 1e-6


def test_a_fold_of_the_study(spark):
    """Held against evaluate() on rows gathered one by one."""
    f = models._features(spark, SF)
    study = Study(tca_components=8, sa_components=8, tca_rows=600, pool=2000)
    from kinetra.operators import driver

    rows, pool, _ = driver.planned(f, study, "custom_ppv", INFERENTIAL, (42,))
    table = {r.row_id: r for r in rows.collect()}
    given = folds.capped(rows.select("subject_id", "row_id", "y", "features"), study).collect()
    of = {}
    for r in pool.collect():
        of.setdefault(r.fold, set()).add(r.subject_id)
    got = {(r.subject_id, r.method): r for r in run(spark, "ex1_leave_one_subject_out")}
    fold = min(k[0] for k, r in got.items() if r.error is None and k[1] == "coral")
    order = sorted(r.row_id for r in given if r.subject_id in of[fold])
    own = sorted(i for i, r in table.items() if r.subject_id == fold)
    x = lambda ids: np.array([table[i].features for i in ids], float)
    y = lambda ids: np.array([table[i].y for i in ids])
    c, t = ([i for i in own if (42 in table[i].held_seeds) == held] for held in (True, False))
    for method in ("raw", "coral", "sa"):
        want = runner.evaluate(x(order), y(order), x(c), x(t), y(t), method, study)
        r = got[(fold, method)]
        assert np.allclose([r[k] for k in ("accuracy", "balanced_accuracy", "macro_f1", "best_alpha", "mmd_before")], [want[k] for k in ("accuracy", "balanced_accuracy", "macro_f1", "best_alpha", "mmd_before")], rtol=1e-6)
        assert (r.n_train, r.n_calibration, r.n_test) == (len(order), len(c), len(t))


def test_distributions_by_integration():
    t = np.linspace(0, 60, 600_001)
    for df in (3, 11.0, 40):
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + t**2 / df) ** (-(df + 1) / 2)
        for x in (0.7, 2.2):
            assert abs(special.t_tail(x, df) - 2 * (0.5 - np.trapezoid(density[t <= x + 1e-12], t[t <= x + 1e-12]))) < 1e-6
        assert abs(special.t_tail(special.t_quantile(0.975, df), df) - 0.05) < 1e-9
    u = np.linspace(1e-9, 400, 4_000_001)
    d1, d2 = 4.0, 96.0
    density = np.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2) + (d1 / 2 - 1) * np.log(u) - (d1 + d2) / 2 * np.log1p(d1 * u / d2))
    for x in (0.5, 2.4, 5.0):
        assert abs(special.f_tail(x, d1, d2) - np.trapezoid(density[u >= x], u[u >= x])) < 1e-5


def test_studentised_range():
    for k, q in stats.NEMENYI_Q.items():
        assert abs(special.range_quantile(0.95, k) / math.sqrt(2) - q) < 1e-3
    assert abs(special.range_quantile(0.95, 20) - 5.01) < 5e-3  # tabulated
    draws = np.random.default_rng(3).normal(size=(200_000, 50))
    assert abs(special.range_cdf(special.range_quantile(0.95, 50), 50) - 0.95) < 1e-9
    assert abs(np.mean(np.ptp(draws, axis=1) <= special.range_quantile(0.95, 50)) - 0.95) < 2e-3
    assert special.range_cdf(0, 5) == 0 and abs(special.range_cdf(1.0, 2) - math.erf(0.5)) < 1e-9  # two means: |N(0, 2)|


def test_nemenyi_of_any_number_of_methods(spark):
    rng = np.random.default_rng(0)
    rows = [("g", s, f"m{m:02d}", float(rng.normal() + m / 4)) for s in range(30) for m in range(12)]
    df = spark.createDataFrame(rows, "db string, subject int, method string, value double")
    got = stats.nemenyi(df, ["db"], "subject", "method", "value", tail=True).collect()
    cd = special.range_quantile(0.95, 12) / math.sqrt(2) * math.sqrt(12 * 13 / (6 * 30))
    assert len(got) == 66 and all(abs(r.cd - cd) < 1e-9 and r.significant == (r.p < 0.05) for r in got)


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, size=20_000)
    rows = [("big", i, float(v)) for i, v in enumerate(x)] + [("one", 1, 3.0), ("none", 2, None), ("none", 3, float("nan"))]
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(6)
    got = {r.g: r for r in stats.poisson_bootstrap(df, ["g"], "v", ["id"], rounds=2000).collect()}
    exact = np.quantile([rng.choice(x, len(x)).mean() for _ in range(2000)], [0.025, 0.975])
    width = exact[1] - exact[0]
    assert got.keys() == {"big", "one"} and np.allclose([got["big"].ci_low, got["big"].ci_high], exact, atol=0.1 * width) and got["big"].n == 20_000
    assert (got["one"].ci_low, got["one"].ci_high) == (3.0, 3.0)
    again = {r.g: r for r in stats.poisson_bootstrap(df.repartition(2), ["g"], "v", ["id"], rounds=2000).collect()}
    assert np.allclose([again["big"].ci_low, again["big"].ci_high], [got["big"].ci_low, got["big"].ci_high])
    plan = stats.poisson_bootstrap(df, ["g"], "v", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    w = stats.poisson_weights(np.arange(4000), 500, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_bootstrap_and_intervals(spark):
    rows = B.seed_averages(spark, SF).collect()
    values = {}
    for r in rows:
        values.setdefault((r.db, r.method), []).append(r.value)
    for r in run(spark, "ag29_bootstrap"):
        v = np.array(values[(r.db, r.method)])
        se = v.std() / math.sqrt(len(v))
        assert r.ci_low <= v.mean() <= r.ci_high and abs((r.ci_high - r.ci_low) - 2 * 1.96 * se) < 0.25 * 2 * 1.96 * se + 1e-12
    for r in run(spark, "st8_spearman_p"):
        if r.rho is not None and abs(r.rho) < 1:
            assert abs(r.p - special.t_tail(r.rho * math.sqrt((r.n - 2) / (1 - r.rho**2)), r.n - 2)) < 1e-9


def test_bundle_has_every_part(spark):
    rows = run(spark, "st9_bundle")
    fr = {r.db: r.p for r in run(spark, "st1_iman_davenport_p")}
    told = {(r.db, r.part) for r in rows}
    assert {d for d, part in told if part == "nemenyi"} == {d for d, p in fr.items() if p is not None and p < 0.05}
    assert {part for _, part in told} >= {"descriptive", "friedman", "wilcoxon", "cohens_d"}
    p = {(r.db, r.a, r.b): r.p for r in run(spark, "st3_wilcoxon_exact_p")}
    assert all(math.isclose(r.x, p[(r.db, r.a, r.b)], rel_tol=1e-9) for r in rows if r.part == "wilcoxon" and r.name == "p")


def test_within_subject_groups_span_batches(spark):
    """One result a subject and seed, whatever batches its rows come in; equal to the ridge on its rows alone."""
    from kinetra.operators import ridge, runner

    rng, rows = np.random.default_rng(3), []
    for subject, n in ((1, 70), (2, 3), (3, 90), (4, 1)):
        for seed in (42, 7):
            y = rng.integers(0, 3, n)
            rows += [(subject, seed, int(c), "held" if i % 4 == 1 else "kept", (rng.normal(size=5) + np.eye(5)[c]).tolist()) for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, "subject_id int, seed int, y int, side string, features array<double>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        plan = runner.within_subject(df)
        got = {(r.subject_id, r.seed): r for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 8 and "MapInArrow" in plan._jdf.queryExecution().toString() and got[(4, 7)].error
    for key in ((1, 42), (3, 7)):
        own = [r for r in rows if r[:2] == key]
        train, test = ([r for r in own if (r[3] == "held") == held] for held in (False, True))
        x, t = (np.array([r[4] for r in part]) for part in (train, test))
        model = ridge.fit((x - x.mean(axis=0)) / x.std(axis=0), np.array([r[2] for r in train]), ridge.FINE_ALPHAS, by_accuracy=True)
        hit = (model.predict((t - x.mean(axis=0)) / x.std(axis=0)) == np.array([r[2] for r in test])).mean()
        r = got[key]
        assert r.error is None and (r.n_train, r.n_test) == (len(train), len(test)) and abs(r.accuracy - hit) < 1e-12 and r.best_alpha == model.alpha
