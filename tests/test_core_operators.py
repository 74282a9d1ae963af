"""Properties of the operators that SQL cannot check, and small cases with known answers."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetra.config import Database, Study
from kinetra.functions import special
from kinetra.operators import adapt, driver, ridge, rocket, runner, segment, split, stats
from kinetra.sources import recordings, results


def frame(spark, x, **extra):
    rows = [(i, v.tolist(), *[c[i] for c in extra.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id int, features array<double>", *[f"{k} int" for k in extra]]))


def matrix(df):
    return np.array([r.features for r in df.orderBy("id").collect()])


def test_a_recording_that_begins_in_a_movement_loses_its_first_sample(spark):
    rows = [(1, i, s, 1) for i, s in enumerate([2] * 5 + [0] * 3 + [3] * 4 + [1] * 2)]
    df = spark.createDataFrame(rows, "subject int, i int, stimulus int, repetition int")
    got = [(r.stimulus, r.start, r.end) for r in segment.trials(df, ["subject"], 3).orderBy("start").collect()]
    assert got == [(2, 1, 5), (3, 8, 12)]


@pytest.mark.parametrize(("n", "width", "overlap"), [(1000, 400, 0.5), (399, 400, 0.5), (17, 4, 0.9), (8, 8, 0.0)])
def test_windows_agree_with_slices(spark, n, width, overlap):
    df = spark.range(n).selectExpr("1 as s", "cast(id as int) as i")
    step, want = segment.step_of(width, overlap), segment.complete_windows(n, width, overlap)
    got = sorted(tuple(r) for r in segment.windows(df, ["s"], width, overlap, [F.min("i").alias("lo"), F.max("i").alias("hi")]).select("window_id", "lo", "hi").collect())
    assert got == [(k, k * step, k * step + width - 1) for k in range(want)]
    arrays = spark.createDataFrame([(list(range(n)),)], "x array<int>")
    assert sorted(r.x[0] for r in segment.window_arrays(arrays, "x", width, overlap).collect()) == [k * step for k in range(want)]


def test_repetition_split_rounds_to_even_and_never_leaks(spark):
    for reps, held in ((1, 0), (2, 1), (3, 2), (5, 2), (7, 4)):
        df = spark.createDataFrame([(0, r) for r in range(reps) for _ in range(3)], "y int, rep int")
        sides = split.repetition_split(df, "y", "rep", 0.5).collect()
        assert sum(s.side == "held" for s in sides) == held and len(sides) == reps
    with pytest.raises(ValueError):
        split.repetition_split(df, "y", "rep", 1.0)


def test_greedy_packing_passes_over_what_overflows(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 1), (2, 0, 9), (2, 1, 1)], "s int, rep int, n int")
    got = {r.s: (r.total, r.reps) for r in split.pack_repetitions(df, ["s"], 6, "rep").collect()}
    assert got == {1: (6, [0, 2]), 2: (9, [0])}


def test_coral_takes_on_mean_and_covariance(spark):
    rng = np.random.default_rng(0)
    xs, xt = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 1, rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    moved = matrix(adapt.coral(frame(spark, xs), frame(spark, xt), "features", 1e-6))
    assert np.allclose(moved.mean(axis=0), xt.mean(axis=0))
    assert np.allclose(np.cov(moved, rowvar=False), np.cov(xt, rowvar=False), atol=1e-2)


def test_gram_in_tiles(spark):
    x = np.random.default_rng(1).normal(size=(300, 20))
    n, mean, cov = adapt.gram(frame(spark, x), "features", tile=7)
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x, rowvar=False))


def test_transfer_components_solve_the_generalised_problem():
    rng = np.random.default_rng(2)
    s, t = rng.normal(size=(40, 5)), rng.normal(size=(30, 5)) + 1
    mean, sd, p = adapt.transfer_components(s, t, 3, 1.0)
    gap = lambda a, b: abs(a.mean(axis=0) - b.mean(axis=0)).max()
    assert p.shape == (5, 3) and gap((s - mean) / sd @ p, (t - mean) / sd @ p) < gap((s - mean) / sd, (t - mean) / sd)


def test_subspaces_are_orthonormal_and_target_is_projected(spark):
    rng = np.random.default_rng(3)
    xs, xt = rng.normal(size=(200, 8)), rng.normal(size=(150, 8)) * np.arange(1, 9)
    a, b = adapt.subspace_alignment(frame(spark, xs), frame(spark, xt), "features", 3)
    axes = adapt.subspace(np.cov(xt, rowvar=False), 3)
    assert np.allclose(axes.T @ axes, np.eye(3)) and matrix(a).shape == (200, 3)
    assert np.allclose(matrix(b), (xt - xt.mean(axis=0)) @ axes + xt.mean(axis=0)[:3])


def test_ridge_leave_one_out_is_exact():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 60)), rng.integers(0, 3, 40)
    target, errors = np.where(y[:, None] == np.arange(3), 1.0, -1.0), []
    for a in (0.1, 10.0):
        one = []
        for i in range(40):
            keep = np.arange(40) != i
            xc, yc = x[keep] - x[keep].mean(axis=0), target[keep] - target[keep].mean(axis=0)
            w = np.linalg.solve(xc.T @ xc + a * np.eye(60), xc.T @ yc)
            one.append((target[i] - target[keep].mean(axis=0) - (x[i] - x[keep].mean(axis=0)) @ w) ** 2)
        errors.append(np.mean(one))
    assert ridge.fit(x, y, np.array([0.1, 10.0])).alpha == (0.1, 10.0)[int(np.argmin(errors))]
    assert (ridge.fit(x[:, :5] + 5 * np.eye(3, 5)[y], y).predict(x[:, :5] + 5 * np.eye(3, 5)[y]) == y).mean() > 0.9


def test_convolution_by_hand():
    x, w = np.random.default_rng(5).normal(size=(2, 3, 30)), (2.0, -1, -1, 2, -1, -1, -1, -1, 2)
    for dilation, padded in ((1, False), (3, False), (2, True)):
        got, reach = rocket.convolve(x, w, dilation, padded, (0, 2)), 8 * dilation
        signal = x[:, 0] + x[:, 2]
        signal = np.pad(signal, ((0, 0), (reach // 2,) * 2)) if padded else signal
        want = [[sum(w[j] * s[t + j * dilation] for j in range(9)) for t in range(len(s) - reach)] for s in signal]
        assert np.allclose(got, want)


def test_kernel_banks():
    assert rocket.custom_dilations(400) == [1, 2, 4, 8, 16]
    sample = np.random.default_rng(6).normal(size=(20, 2, 400))
    bank = rocket.canonical_bank(10_000, 2, sample)
    assert len(bank.bias) == 9996
    assert sorted(set(bank.dilation.tolist())) == [*range(1, 11), 12, 14, 16, 18, 20, 23, 26, 30, 34, 38, 43, 49]
    custom = rocket.with_median_bias(rocket.custom_bank(50, 2, 400), sample)
    assert abs(rocket.features(custom, sample).mean() - 0.5) < 0.05
    with pytest.raises(ValueError):
        rocket.Extractor("other")


def test_special_functions():
    assert abs(special.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert abs(special.f_tail(4.0, 3, 20) - 0.022084) < 1e-5
    assert abs(special.t_tail(2.0, 5) - 0.101939) < 1e-5
    assert special.signed_rank_p(0, 5, 55) == 2 / 32 and special.signed_rank_p(7.5, 5, 54.5) == 1.0


def test_statistics_on_known_rows(spark):
    df = spark.createDataFrame([(s, m, float(v)) for s, row in enumerate([(3, 2, 1), (6, 5, 4), (9, 7, 8), (4, 3, 1)]) for m, v in zip("abc", row, strict=True)], "subject int, method string, v double")
    f = stats.friedman(df, [], "subject", "method", "v").first()
    assert (f.n, f.k) == (4, 3) and abs(f.chi2 - 6.5) < 1e-9
    p = spark.createDataFrame([("x", p, str(i)) for i, p in enumerate([0.04, 0.01, None, 0.03])], "g string, p double, t string")
    got = {r.t: r.p_adjusted for r in stats.holm_sidak(p, ["g"], "p", ["t"]).collect()}
    assert got["2"] is None and abs(got["1"] - (1 - 0.99**3)) < 1e-12 and abs(got["0"] - got["3"]) < 1e-12


def test_folds_resume(spark):
    rng = np.random.default_rng(7)
    rows = [(s, s * 100 + i, i % 2, "held" if i % 4 < 2 else "kept", (rng.normal(size=4) + 3 * (i % 2)).tolist()) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id int, row_id bigint, y int, side string, features array<double>")
    study = Study(tca_components=2, sa_components=2, tca_rows=100)
    pool = spark.createDataFrame([(a, b) for a in range(3) for b in range(3) if a != b], "fold int, subject_id int")
    folds = spark.createDataFrame([(s, m, 42) for s in range(3) for m in ("raw", "coral", "tca", "sa", "none")], "subject_id int, method string, seed int").withColumn("config_hash", runner.config_hash(study))
    first = runner.run_folds(df, pool, folds, study).cache()
    got = {(r.subject_id, r.method): r for r in first.collect()}
    assert len(got) == 15 and all((r.error is not None) == (m == "none") for (_, m), r in got.items())
    assert all(r.accuracy > 0.8 for (_, m), r in got.items() if m != "none")
    assert runner.pending(folds, first).count() == 3


def mat5(**arrays):
    out = b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM"
    for name, a in arrays.items():
        part = lambda kind, b: struct.pack("<II", kind, len(b)) + b + b"\0" * (-len(b) % 8)
        body = part(6, struct.pack("<II", 6, 0)) + part(5, np.array(a.shape, "<i4").tobytes()) + part(1, name.encode()) + part(9, a.astype("<f8").tobytes(order="F"))
        out += struct.pack("<II", 14, len(body)) + body
    return out


def test_recordings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    emg = np.arange(40.0).reshape(20, 2)
    (tmp_path / "sub" / "S7_E1_A1.mat").write_bytes(mat5(emg=emg, restimulus=np.repeat([0, 3], 10)[:, None], repetition=np.ones((20, 1)), fs=np.array([[1000.0]])))
    (tmp_path / "S8_E1.mat").write_bytes(b"broken")
    good, bad = recordings.quarantine(recordings.read(spark, str(tmp_path)))
    rows = good.orderBy("sample_idx").collect()
    assert len(rows) == 20 and rows[5].emg == [10.0, 11.0] and rows[15].stimulus == 3 and rows[0].fs == 1000 and rows[0].subject_id == 7
    assert bad.count() == 1


def test_a_study_from_recordings_is_taken_up_where_results_are_missing(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "in").mkdir()
    for s in range(1, 4):
        label = np.concatenate([[0] * 5, np.tile(np.repeat([1, 0, 2, 0], [40, 5, 40, 5]), 4)])
        rep = np.concatenate([[0] * 5, np.repeat([1, 2, 3, 4], 90)])
        emg = rng.normal(size=(len(label), 2)) * np.where(label == 2, 6.0, 1.0)[:, None]
        (tmp_path / "in" / f"S{s}_E1_A1.mat").write_bytes(mat5(emg=emg, restimulus=label[:, None], repetition=rep[:, None]))
    base, out = Database(3, 2, 2, 100), str(tmp_path / "out")
    study = Study(kernels=32, min_trial=20, sa_components=2)
    go = lambda methods, seeds: driver.study_database(spark, "small", str(tmp_path / "in"), out, study, "custom_ppv", methods, seeds, base=base).collect()
    first = go(("raw",), (42,))
    assert len(first) == 3 and all(r.error is None and r.n_train == 2 * 24 and r.n_calibration + r.n_test == 24 for r in first)
    again = go(("raw", "coral"), (42, 7))
    assert len(again) == 12 and {(r.subject_id, r.method, r.seed) for r in again} == {(s, m, k) for s in (1, 2, 3) for m in ("raw", "coral") for k in (42, 7)}
    failing = lambda: driver.study_database(spark, "small", str(tmp_path / "in"), out, study, "custom_ppv", ("raw", "unheard"), (42,), base=base)
    failing()
    assert sorted(r.method for r in failing().collect() if r.error) == ["unheard"] * 3
    sums = lambda: driver.study_database(spark, "small", str(tmp_path / "in"), out, study, "custom_ppv", ("raw", "coral", "tca"), (42,), base=base, by_sums=True).collect()
    told = sums()
    assert {(r.subject_id, r.method) for r in told} == {(s, m) for s in (1, 2, 3) for m in ("raw", "coral")} and all(r.error is None for r in told)
    importance = spark.read.parquet(f"{out}/importance")
    assert importance.count() == 6 * 32 and importance.where("importance > 0").count() > 32 and set(importance.columns) == {"database", "method", "subject_id", "seed", "config_hash", "kernel_id", "importance"}
    assert len(sums()) == 6 and spark.read.parquet(f"{out}/importance").count() == 6 * 32  # nothing is done twice
    errors = driver.study_all(spark, {"none": str(tmp_path / "in")}, out, study)
    assert errors["none"].startswith("KeyError")


def test_seeds_hold_their_own_repetitions(spark):
    df = spark.createDataFrame([(s, y, r) for s in (1, 2) for y in (0, 1) for r in range(6)], "subject int, y int, rep int")
    rows = split.seeded_split(df, "y", "rep", 0.5, (42, 7, 123), ("subject",)).collect()
    for seed in (42, 7, 123):
        held = {(r.subject, r.y, r.rep) for r in rows if seed in r.held_seeds}
        one = split.repetition_split(df, "y", "rep", 0.5, seed=seed, keys=("subject",)).where("side = 'held'").collect()
        assert held == {(r.subject, r.y, r.rep) for r in one}


@pytest.mark.parametrize("rank", [6, 4])
def test_transfer_components_in_features_equal_those_of_the_kernel(rank):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, rank)) @ rng.normal(size=(rank, 6))
    source, target = x[:60], x[60:] + 1.0
    _, _, got = adapt.transfer_components(source, target, 3, 1.0)
    _, _, z = adapt._jointly(source, target)
    want = z.T @ adapt._components(z @ z.T, 60, 3, 1.0)
    assert np.allclose(np.abs(z @ got), np.abs(z @ want), atol=1e-6)


def test_bootstrap_blocks_change_nothing(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(9)] + [("b", 1, 2.0)], "g string, i int, v double")
    run = lambda block: sorted(map(tuple, stats.bootstrap(df, ["g"], "v", "i", rounds=70, block=block).collect()))
    assert run(100) == run(16) == run(1) and run(16)[1] == ("b", 2.0, 2.0)


def test_result_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"database": "db7", "method": "raw", "seed": 1, "per_subject": [{"subject_id": 1, "accuracy": 0.5, "domain_shift": {"cov_before": 2.0}}, {"subject_id": 2, "accuracy": 0.7}, {"subject_id": 3, "error": "x"}]}')
    (tmp_path / "b.json").write_text("{broken")
    e = results.read_json(spark, str(tmp_path))
    assert abs(results.with_summary(e).first().mean_accuracy - 0.6) < 1e-12
    assert results.folds(e).where("error is null").count() == 2
    assert results.rename_shift_keys(e, {"cov_before": "before"}).select("per_subject.domain_shift").first()[0][0].before == 2.0
    grid = spark.createDataFrame([("db7", "raw"), ("db7", "sa")], "database string, method string")
    with pytest.raises(FileNotFoundError):
        results.require_complete(e, grid, ["database", "method"])
    results.write_csv(results.folds(e), str(tmp_path / "out"), ["subject_id", "accuracy"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 3
    assert "accuracy" in results.latex(results.folds(e).select("subject_id", "accuracy"), "c")


def test_count_windows_on_a_stream(spark, tmp_path):
    from kinetra.streaming.windows import count_windows

    rows = spark.range(50).selectExpr("id as event_id", "id % 2 as user_id", "timestamp_seconds(id) as ts", "cast(id as double) as value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = count_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 8, 4)
    q = stream.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.window_id): r["mean"] for r in spark.sql("select * from counted").collect()}
    assert len(got) == 2 * 5 and got[(0, 1)] == np.mean(np.arange(0, 50, 2)[4:12])


#: dimensions, source rows, target rows, mean offset, spreads of both sides, seed -> covariance distance before, after (fixed published values)
SYNTHETIC = [
    (8, 20000, 20000, 1.0, 1.0, 1.6, 0, 96.4995, 1.27837),
    (20, 20000, 5000, 2.0, 1.0, 1.5, 1, 261.934, 20.074),
    (100, 20000, 5000, 1.0, 1.0, 2.5, 2, 8536.75, 1260.75),
    (200, 20000, 5000, 0.5, 0.5, 1.2, 3, 5342.43, 1148.95),
    (100, 20000, 3000, 3.0, 0.3, 3.0, 4, 12599.1, 2392.33),
]


@pytest.mark.parametrize("case", SYNTHETIC)
def test_coral_meets_the_published_synthetic_distances(spark, case):
    d, ns, nt, offset, spread_s, spread_t, seed, want_before, want_after = case
    rng = np.random.RandomState(seed)
    roots = [rng.standard_normal((d, d)) * spread for spread in (spread_s, spread_t)]
    cs, ct = (a @ a.T + 0.01 * np.eye(d) for a in roots)
    xs, xc, xt = (rng.multivariate_normal(np.full(d, m), c, n) for m, c, n in ((0, cs, ns), (offset, ct, nt), (offset, ct, nt)))
    frame = lambda x: spark.createDataFrame(pa.table({"features": adapt.lists(x)}))
    source, target = frame(xs), adapt.gram(frame(xt), "features")[2]
    distance = lambda df: float(np.linalg.norm(adapt.gram(df, "features")[2] - target))
    after = distance(adapt.coral(source, frame(xc), "features", 1e-3))
    assert abs(distance(source) / want_before - 1) < 1e-4 and abs(after / want_after - 1) < 1e-3


def test_ridge_on_all_rows_is_the_ridge_of_its_strength(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 6)) + np.eye(6)[y] * 2
    df = spark.createDataFrame(pa.table({"features": adapt.lists(x), "y": pa.array(y)}))
    model = ridge.fit_all(df, alphas=np.array([2.0]))
    plain = ridge.fit(x, y, np.array([2.0]))
    assert np.allclose(model.coef, plain.coef) and np.allclose(model.intercept, plain.intercept)
    t = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    hat = lambda a: (c := x - x.mean(axis=0)) @ np.linalg.solve(c.T @ c + a * np.eye(6), c.T) + 1 / 300
    gcv = lambda a: (((t - hat(a) @ t) ** 2).sum() / 300) / (1 - np.trace(hat(a)) / 300) ** 2
    assert ridge.fit_all(df).alpha == min(ridge.ALPHAS, key=gcv)
    left = [ridge.fit(np.delete(x, i, 0), np.delete(y, i), np.array([5.0])).predict(x[i : i + 1])[0] == y[i] for i in range(300)]
    c = x - x.mean(axis=0)
    h = np.diag(hat(5.0))
    loo = t - (t - hat(5.0) @ t) / (1 - h)[:, None]
    assert abs(np.mean(left) - (loo.argmax(axis=1) == y).mean()) < 0.01 and len(c)


def test_gaussian_transfer_components(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 5)), rng.normal(1, 2, size=(30, 5))
    frame = lambda x, s: spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x)) + s), "features": adapt.lists(x)}))
    s, t = adapt.tca_gaussian(frame(a, 0), frame(b, 100), "features", "id", 3)
    got = np.array([r.features for r in s.unionByName(t).orderBy("id").collect()])
    x = np.concatenate((a, b))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.array([[np.linalg.norm(p - q) for q in z] for p in z])
    k = np.exp(-d**2 / (2 * np.median(d[d > 0]) ** 2))
    e = np.array([1 / 40] * 40 + [-1 / 30] * 30)
    low = np.linalg.cholesky(k @ np.outer(e, e) @ k + np.eye(70))
    centre = np.eye(70) - 1 / 70
    values, vectors = np.linalg.eigh(np.linalg.solve(low, np.linalg.solve(low, (k @ centre @ k).T).T))
    want = k @ np.linalg.solve(low.T, vectors[:, -3:])  # the leading ones, in ascending order
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_signed_rank_p_by_enumeration_and_with_ties():
    from itertools import product

    for n, w in ((4, 1), (8, 9), (10, 20)):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
        assert abs(special.signed_rank_p(w, n, n * (n + 1) * (2 * n + 1) / 6) - min(1, 2 * np.mean([x <= w for x in sums]))) < 1e-12
    ranks = [1.5, 1.5, 3, 4.5, 4.5, 6]
    z = (4.5 - 10.5) / (sum(r * r for r in ranks) / 4) ** 0.5
    assert abs(special.signed_rank_p(4.5, 6, sum(r * r for r in ranks)) - special.normal_tail(z)) < 1e-12
    assert 0 < special.signed_rank_p(4_000_000, 5000, 5000 * 5001 * 10001 / 6) < 1


def test_latex_and_experiment_files(spark, tmp_path):
    df = spark.createDataFrame([("raw", 20.5, 0.2), ("coral", 22.25, 0.0004), ("sa", float("nan"), None)], "method string, acc double, p double")
    text = results.latex(df, "c", p="p", best="acc")
    assert r"\textbf{22.25}" in text and "$<$0.001***" in text and "0.200" in text and text.count("---") == 2
    with pytest.raises(ValueError):
        results.latex(spark.range(300), "c")
    folds = spark.createDataFrame([("db7", "raw", 1, 0.5, 0.4, 0.3, None), ("db7", "raw", 2, None, None, None, "bad")], "database string, method string, subject_id int, accuracy double, balanced_accuracy double, macro_f1 double, error string")
    results.write_experiments(folds, str(tmp_path / "e"), "database", "method")
    row = spark.read.json(str(tmp_path / "e")).first()
    assert row.summary.mean == 0.5 and len(row.per_subject) == 2


def test_stratified_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, 2, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "y string, k int, i int")
    for most in (40, 1000):
        want = []
        for k in (1, 2, None):
            group = [r for r in rows if r[1] == k]
            for y in ("a", "b", None):
                own = [r[2] for r in group if r[0] == y]
                want += own if len(group) <= most else own[: max(1, int(len(own) / len(group) * most))]
        assert sorted(r.i for r in split.stratified(df, "y", most, ["i"], ("k",)).collect()) == sorted(want)


def test_source_pool_against_brute_force(spark):
    rnd = random.Random(2)
    sizes = [(i, rnd.randrange(9)) for i in rnd.sample(range(1000), 120)]
    counts = spark.createDataFrame(sizes, "subject_id int, n bigint")
    got = split.source_pool(counts, counts.selectExpr("subject_id as fold"), 30).select("fold", "subject_id", "n")
    want = []
    for fold, _ in sizes:
        taken = 0
        for i, n in sorted(sizes):
            if i != fold and n and taken < 30:
                want.append((fold, i, n))
                taken += n
    assert sorted(map(tuple, got.collect())) == sorted(want)
