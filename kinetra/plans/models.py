"""Queries on features: scaling, distances between domains, adaptation, classifiers, kernels, studies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinetra.config import COMPONENT_GRID, CORAL_GRID, INFERENTIAL, SEEDS, Study
from kinetra.durable import staged
from kinetra.operators import adapt, driver, folds, ridge, rocket, runner, scale, split
from kinetra.plans import bindings as B
from kinetra.plans.registry import query, r6, rounded
from kinetra.sources import cache

MOM = f"{B.LE}, mo AS (SELECT j, avg(v) AS m, CASE WHEN sqrt(var_pop(v)) < 1e-8 THEN 1 ELSE sqrt(var_pop(v)) END AS s FROM le WHERE vec_id % 4 < 2 GROUP BY j)"


#: Methods whose folds follow from sums.
BY_SUMS = ("raw", "centering", "coral", "sa")


def _role(spark, d, role):
    return B.embeddings(spark, d).where(F.col("role") == role)


@query("ag26_column_moments", f"WITH {B.LE} SELECT CAST(j AS INT) AS j, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM le WHERE vec_id % 4 < 2 GROUP BY j")
def _(spark, d):
    return scale.moments(_role(spark, d, "source"), "features").select("j", *r6(mean="mean", var="var"))


@query("ag27_covariance", f"WITH {B.LE} SELECT CAST(a.j AS INT) AS i, CAST(b.j AS INT) AS j, round(covar_samp(a.v, b.v), 6) AS cov FROM le a JOIN le b ON a.vec_id = b.vec_id WHERE a.vec_id % 4 = 2 GROUP BY a.j, b.j")
def _(spark, d):
    return scale.covariance(_role(spark, d, "calibration"), "features").select("i", "j", *r6(cov="cov"))


@query("ml13_standardise", f"WITH {MOM} SELECT vec_id, round(sum((v - m) / s), 4) AS total, round(max((v - m) / s), 5) AS most FROM le JOIN mo ON le.j = mo.j WHERE vec_id % 4 = 3 GROUP BY vec_id")
def _(spark, d):
    z = scale.standardise(_role(spark, d, "final"), scale.moment_arrays(_role(spark, d, "source"), "features"), "features")
    return z.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max("features"), 5).alias("most"))


@query("ml14_centre", f"WITH {MOM} SELECT vec_id, round(sum(v - m), 4) AS total FROM le JOIN mo ON le.j = mo.j WHERE vec_id % 4 = 3 GROUP BY vec_id")
def _(spark, d):
    z = scale.centre(_role(spark, d, "final"), scale.moment_arrays(_role(spark, d, "source"), "features"), "features")
    return z.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("ml19_covariance_distance", f"WITH {B.LE}, c AS (SELECT a.vec_id % 4 = 3 AS f, a.j AS i, b.j AS j, covar_samp(a.v, b.v) AS c FROM le a JOIN le b ON a.vec_id = b.vec_id WHERE a.vec_id % 4 <> 2 GROUP BY 1, 2, 3) SELECT round(sqrt(sum(power(x.c - y.c, 2))), 6) AS distance FROM c x JOIN c y ON x.i = y.i AND x.j = y.j AND x.f AND NOT y.f")
def _(spark, d):
    return scale.covariance_distance(_role(spark, d, "source"), _role(spark, d, "final"), "features").select(*r6(distance="distance"))


@query("ml20_linear_mmd", f"WITH {B.LE}, m AS (SELECT j, avg(v) FILTER (WHERE vec_id % 4 < 2) AS a, avg(v) FILTER (WHERE vec_id % 4 = 3) AS b FROM le GROUP BY j) SELECT round(sum(power(a - b, 2)), 6) AS mmd2 FROM m")
def _(spark, d):
    return scale.linear_mmd(_role(spark, d, "source"), _role(spark, d, "final"), "features").select(*r6(mmd2="mmd2"))


@query("ml15_coral")
def _(spark, d):
    return adapt.coral(_role(spark, d, "source"), _role(spark, d, "calibration"), "features")


@query("ml17_subspace_alignment")
def _(spark, d):
    a, b = adapt.subspace_alignment(_role(spark, d, "source"), _role(spark, d, "calibration"), "features", 16)
    return a.unionByName(b)


@query("ml16_tca")
def _(spark, d):
    """Fitted on all rows of both sides."""
    a, b = adapt.tca(_role(spark, d, "source"), _role(spark, d, "calibration"), "features", "vec_id", 16, most=None)
    return a.unionByName(b)


@query("ml16_tca_gaussian")
def _(spark, d):
    """The kernel is on 6,000 rows at most, the published bound."""
    a, b = adapt.tca_gaussian(_role(spark, d, "source"), _role(spark, d, "calibration"), "features", "vec_id", 16)
    return a.unionByName(b)


@query("ml8_ridge_all_rows")
def _(spark, d):
    """Fitted on all source rows by sums on Spark; no sample."""
    return ridge.predict(_role(spark, d, "final"), ridge.fit_all(_role(spark, d, "source")), keep=("vec_id", "y"))


@query("ml18_dispatch")
def _(spark, d):
    """Each method's adapted rows of both sides: their number, width, and sums of values and squares."""
    s, c, t = (_role(spark, d, r) for r in ("source", "calibration", "final"))
    out = None
    for method in ("raw", "centering", "coral", "tca", "sa"):
        for side, df in zip(("source", "target"), adapt.adapt(method, s, c, t, "vec_id", Study(tca_components=8, sa_components=8)), strict=True):
            total = lambda f: F.sum(F.aggregate("features", F.lit(0.0), lambda a, v: a + f(v.cast("double"))))  # noqa: E731, B023
            part = df.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), total(lambda v: v).alias("total"), total(lambda v: v * v).alias("squares"))
            part = part.select(F.lit(method).alias("method"), F.lit(side).alias("side"), "n", "width", *r6(total="total", squares="squares"))
            out = part if out is None else out.unionByName(part)
    return out


@query("ml21_shift_before_after")
def _(spark, d):
    s, c, t = (_role(spark, d, r) for r in ("source", "calibration", "final"))
    moved = adapt.coral(s, c, "features")
    row = lambda name, a: scale.covariance_distance(a, t, "features").crossJoin(scale.linear_mmd(a, t, "features")).withColumn("stage", F.lit(name))
    return row("before", s).unionByName(row("after", moved))


@query("ml9_ridge")
def _(spark, d):
    """The published draw of 8,000 rows, each left out once; the rows stay in tasks."""
    rows = split.exact_sample(_role(spark, d, "source"), Study().ridge_rows, 42, "vec_id").select("features", "y")
    return ridge.predict(_role(spark, d, "final"), ridge.fit_rows(rows), keep=("vec_id", "y"))


@query("ml9_ridge_every_row")
def _(spark, d):
    """The same on all source rows."""
    return ridge.predict(_role(spark, d, "final"), ridge.fit_rows(_role(spark, d, "source")), keep=("vec_id", "y"))


def _windows(spark, d):
    return B.channels(spark, d).withColumn("row_id", F.col("subject_id") * 100_000 + F.col("window_id"))


@query("ml3_custom_features")
def _(spark, d):
    w = _windows(spark, d)
    return rocket.Extractor("custom_ppv", 64).fit(w, "x", "row_id", 2).transform(w, "x")


@query("ml5_canonical_features")
def _(spark, d):
    w = _windows(spark, d)
    return rocket.Extractor("canonical", 168).fit(w, "x", "row_id", 2).transform(w, "x")


@query("ml3_single_kernel", f"WITH {B.SIG}, {B.WIN}, x AS (SELECT subject_id, window_id, i - window_id * 8 AS pos, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM ex), k AS (SELECT a.subject_id, a.window_id, a.pos AS t, sum(CASE WHEN b.pos - a.pos = 1 THEN b.v ELSE -b.v END) AS c FROM x a JOIN x b ON a.subject_id = b.subject_id AND a.window_id = b.window_id AND b.pos BETWEEN a.pos AND a.pos + 8 WHERE a.pos <= 7 GROUP BY 1, 2, 3) SELECT k.subject_id, k.window_id, round(avg(CASE WHEN c + 100 > 0 THEN 1.0 ELSE 0.0 END), 6) AS ppv FROM k JOIN win ON k.subject_id = win.subject_id AND k.window_id = win.window_id GROUP BY 1, 2")
def _(spark, d):
    """One kernel in column expressions: taps -1 but for the second, dilation 1, bias 100, first channel."""
    v = F.slice("x", 1, B.W)
    conv = F.transform(F.sequence(F.lit(1), F.lit(B.W - 8)), lambda t: F.aggregate(F.transform(F.slice(v, t, 9), lambda a, j: F.when(j == 1, a.cast("double")).otherwise(-a.cast("double"))), F.lit(0.0), lambda s, a: s + a))
    share = F.aggregate(conv, F.lit(0.0), lambda s, c: s + F.when(c + 100 > 0, 1.0).otherwise(0.0)) / (B.W - 8)
    return B.channels(spark, d).select("subject_id", "window_id", F.round(share, 6).alias("ppv"))


def _features(spark, d, kernels=32):
    w = staged(_windows(spark, d).where("y > 0"))
    f = rocket.Extractor("custom_ppv", kernels).fit(w, "x", "row_id", 2).transform(w, "x")
    return staged(f.withColumns({"subject_id": F.col("subject_id").cast("int"), "y": (F.col("y") - 1).cast("int")}))  # studies read it many times


@query("ex1_leave_one_subject_out")
def _(spark, d):
    """On all rows of all other subjects, with transfer components; ridge leaves out each row of each pool."""
    return driver.run(_features(spark, d), Study(tca_components=8, sa_components=8, pool=None), "custom_ppv", INFERENTIAL, (Study().seed,))


@query("ex1_by_sums")
def _(spark, d):
    """Every subject, pools of 50,000 rows and the published defaults: all methods that follow from sums."""
    return driver.run_by_sums(_features(spark, d), Study(), "custom_ppv", BY_SUMS, (Study().seed,)).drop("importance")


POOL = Study(per_subject=12, pool=200)
STATS = ("mean", "sd", "k_mean")


@query("ex1_pool_statistics", f"""WITH {B.SIG}, {B.WIN},
 f AS (SELECT subject_id, window_id, CAST(y AS INT) AS y, {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in STATS)}, md5('42:' || CAST(subject_id * 100000 + window_id AS VARCHAR)) AS h, subject_id * 100000 + window_id AS row_id FROM win WHERE y > 0),
 c AS (SELECT *, row_number() OVER (PARTITION BY subject_id, y ORDER BY h, row_id) AS k, count(*) OVER (PARTITION BY subject_id, y) AS nc, count(*) OVER (PARTITION BY subject_id) AS n FROM f),
 g AS (SELECT * FROM c WHERE n <= 12 OR k <= greatest(1, floor(nc / n * 12))),
 s AS (SELECT subject_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.subject_id AS fold, b.subject_id, b.n, sum(b.n) OVER (PARTITION BY a.subject_id ORDER BY b.subject_id) - b.n AS before FROM s a JOIN s b ON a.subject_id <> b.subject_id),
 r AS (SELECT p.fold, g.*, count(*) OVER (PARTITION BY p.fold) AS pn, count(*) OVER (PARTITION BY p.fold, g.y) AS pc, row_number() OVER (PARTITION BY p.fold, g.y ORDER BY g.h, g.row_id) AS pk FROM p JOIN g ON p.subject_id = g.subject_id WHERE p.before < 200),
 q AS (SELECT * FROM r WHERE pn <= 200 OR pk <= greatest(1, floor(pc / pn * 200)))
 SELECT fold, count(*) AS n, count(DISTINCT y) AS classes, {", ".join(f"round(avg({c}), 6) AS {c}" for c in STATS)}, round(covar_samp(mean, sd), 4) AS cov_mean_sd, round(covar_samp(mean, k_mean), 4) AS cov_mean_k, round(var_samp(sd), 4) AS var_sd FROM q GROUP BY fold""")
def _(spark, d):
    """Size, classes, means and covariances of every fold's pool, from sums over prefixes of the subjects."""
    w = staged(B.windows(spark, d).where("y > 0").select(F.col("subject_id").cast("int").alias("subject_id"), (F.col("subject_id") * 100_000 + F.col("window_id")).alias("row_id"), F.col("y").cast("int").alias("y"), F.array(*[F.col(c).cast("float") for c in STATS]).alias("features")))
    counts = folds.capped(w, POOL).groupBy("subject_id").agg(F.count("*").alias("n"))
    pool = split.source_pool(counts, counts.select(F.col("subject_id").alias("fold")), POOL.pool).select("fold", "subject_id")
    wanted = counts.select(F.col("subject_id").alias("fold"), F.lit(42).alias("seed"))
    sums = folds.fold_sums(w.withColumn("held_seeds", F.array().cast("array<int>")), pool, wanted, POOL, len(B.STIMULI), kinds=("source",))
    tile = sums.where("kind = 'source'").select("fold", F.posexplode(F.transform("v", lambda v: v * F.col("sign"))).alias("j", "v")).groupBy("fold", "j").agg(F.sum("v").alias("v"))
    m = tile.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))  # one small matrix
    size = 1 + len(STATS) + len(B.STIMULI)
    at = lambda i, j: F.element_at("m", F.lit(i * size + j))
    n, mean = at(0, 0), lambda i: at(0, i) / at(0, 0)
    cov = lambda i, j: (at(i, j) - n * mean(i) * mean(j)) / (n - 1)
    classes = sum((F.round(at(0, 1 + len(STATS) + k)) > 0).cast("bigint") for k in range(len(B.STIMULI)))
    return m.select("fold", F.round(n).cast("bigint").alias("n"), classes.alias("classes"), *r6(**{c: mean(i + 1) for i, c in enumerate(STATS)}), *rounded(4, {"cov_mean_sd": cov(1, 2), "cov_mean_k": cov(1, 3), "var_sd": cov(2, 2)}))


@query("ex7_multi_seed")
def _(spark, d):
    """Per method: each seed's mean over subjects, then mean and spread over seeds. A seed draws the held repetitions."""
    rows = driver.run_by_sums(_features(spark, d), Study(), "custom_ppv", BY_SUMS, SEEDS).where("error is null")
    return rows.groupBy("method", "seed").agg(F.avg("accuracy").alias("a")).groupBy("method").agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("sd"), F.count("*").alias("seeds"))


@query("ex6_within_subject")
def _(spark, d):
    """Every subject and split seed: repetitions of each class are held out, never single windows."""
    f = _features(spark, d)
    sides = split.seeded_split(f, "y", "rep", Study().test_share, SEEDS, keys=("subject_id",))
    rows = f.join(sides, ["subject_id", "y", "rep"]).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    side = F.when(F.array_contains("held_seeds", F.col("seed")), "held").otherwise("kept")
    return runner.within_subject(rows.select("subject_id", "seed", "y", side.alias("side"), "features"))


@query("ex8_sensitivity")
def _(spark, d):
    """All published values of CORAL's regularisation and of aligned components, from one set of sums."""
    rows = driver.run_by_sums(_features(spark, d), Study(), "custom_ppv", ("coral", "sa"), (Study().seed,), {"coral": CORAL_GRID, "sa": COMPONENT_GRID})
    return rows.where("error is null").groupBy("method", "value").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd"), F.count("*").alias("n"))


@query("ex9_kernel_importance")
def _(spark, d):
    """Each kernel's importance over all folds, by method: mean, spread, number of folds."""
    rows = driver.run_by_sums(_features(spark, d), Study(), "custom_ppv", ("raw", "coral"), (Study().seed,)).where("error is null")
    each = rows.select("method", F.posexplode("importance").alias("kernel_id", "v"))
    return each.groupBy("method", "kernel_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").alias("folds"))


GIVEN = {"extractor": "canonical", "window_ms": 200, "overlap": 0.5, "kernels": 10_000, "calibration": 0.5, "coral_reg": 0.001, "tca_components": 50, "sa_components": 50, "fit_mode": "full_train"}
HASHED = " || chr(10) || ".join({"database": "'database=\"' || db || '\"'", "subject_id": "'subject_id=' || CAST(subject_id AS VARCHAR)", "seed": "'seed=' || CAST(seed AS VARCHAR)"}.get(f, f"'{f}={json.dumps(GIVEN.get(f))}'") for f in cache.FIELDS)


@query("ex2_manifest_hash", f"WITH {B.FACT} SELECT db, method, subject_id, seed, sha256({HASHED}) AS config_hash FROM fact")
def _(spark, d):
    """The manifest's hash of all twelve settings, of each database, subject and seed of the facts."""
    own = {"database": F.concat(F.lit('"'), F.col("db"), F.lit('"')), "subject_id": F.col("subject_id").cast("string"), "seed": F.col("seed").cast("string")}
    return B.facts(spark, d).select("db", "method", "subject_id", "seed", cache.config_hash(cache.settings(**GIVEN) | own).alias("config_hash"))


@query("ml15_coral_means", f"WITH {B.LE} SELECT CAST(j AS INT) AS j, round(avg(v), 6) AS mean FROM le WHERE vec_id % 4 = 2 GROUP BY j")
def _(spark, d):
    """Adapted source rows have the mean of the calibration rows."""
    return scale.moments(adapt.coral(_role(spark, d, "source"), _role(spark, d, "calibration"), "features"), "features").select("j", *r6(mean="mean"))


@query("ml24_kernel_importance")
def _(spark, d):
    """Mean size of each feature's coefficients in one ridge on all source rows; ex9_kernel_importance has it by fold."""
    model = ridge.fit_rows(_role(spark, d, "source"))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(abs(model.coef).mean(axis=1))], "kernel_id int, importance double")  # a row a feature


@query("ex2_config_hash")
def _(spark, d):
    return B.table(spark, d, "region").select("r_regionkey", runner.config_hash(Study(), "custom_ppv").alias("config_hash"))


@query("stream_count_windows_batch", f"WITH {B.SIG}, {B.WIN} SELECT subject_id, window_id, round(mean, 6) AS mean FROM win WHERE mean > 0")
def _(spark, d):
    return B.windows(spark, d).where("mean > 0").select("subject_id", "window_id", *r6(mean="mean"))


@query("stream_time_windows", "SELECT user_id, date_trunc('day', ts) AS start, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    from kinetra.streaming.windows import time_windows

    return time_windows(B.table(spark, d, "events"), "1 day", "1 day", "2 hours").select("user_id", "start", *r6(mean="mean"), "n")
