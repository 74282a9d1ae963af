"""Leave-one-subject-out studies: a fold table, shared features, and a result table that a rerun takes up."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.config import Study
from kinetra.durable import durable, staged
from kinetra.operators import adapt as A
from kinetra.operators import folds as by_sums
from kinetra.operators import ridge, tall
from kinetra.operators.adapt import matrix

RESULT = "subject_id int, method string, seed int, accuracy double, balanced_accuracy double, macro_f1 double, best_alpha double, cov_before double, cov_after double, mmd_before double, mmd_after double, n_train int, n_calibration int, n_test int, config_hash string, error string"
RESULT_ARROW = pa.schema([(n, {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (c.split() for c in RESULT.split(", "))])


def config_hash(study: Study, *inputs: str):
    """A column: sha256 of the settings that a stage's result depends on, and of what it reads."""
    return F.sha2(F.lit(json.dumps([asdict(study), inputs], sort_keys=True)), 256)


def pending(folds: DataFrame, done: DataFrame | None) -> DataFrame:
    """Fold rows that the result table lacks; rows with an error are done again."""
    return folds if done is None else folds.join(done.where("error is null"), ["subject_id", "method", "seed", "config_hash"], "left_anti")


def scores(y: np.ndarray, p: np.ndarray) -> tuple[float, float, float]:
    labels = np.union1d(y, p)
    hit = np.array([((y == c) & (p == c)).sum() for c in labels])
    support, said = np.array([(y == c).sum() for c in labels]), np.array([(p == c).sum() for c in labels])
    return float((y == p).mean()), float((hit / np.maximum(support, 1))[support > 0].mean()), float((2 * hit / np.maximum(support + said, 1)).mean())


def shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Covariance distance and linear mean discrepancy."""
    cov = np.linalg.norm(np.cov(a, rowvar=False) - np.cov(b, rowvar=False)) if min(len(a), len(b)) > 2 else float("nan")
    return float(cov), float(((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum())


def evaluate(xs: np.ndarray, ys: np.ndarray, xc: np.ndarray, xt: np.ndarray, yt: np.ndarray, method: str, study: Study) -> dict:
    """One fold and method on bounded arrays: adapt, standardise by the source, measure the shift, classify, score.

    The plain form, against which evaluated() is held.
    """
    def z(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, sd = source.mean(axis=0), source.std(axis=0)
        sd = np.where(sd < 1e-8, 1, sd)
        return (source - mean) / sd, (target - mean) / sd

    if min(len(xs), len(xt)) < 1 or (method in ("coral", "sa", "tca") and min(len(xs), len(xc)) < 2):
        raise ValueError(f"too few rows for {method}: {len(xs)} source, {len(xc)} calibration, {len(xt)} final")
    before = shift(*z(xs, xt))
    a, t = xs, xt
    if method == "centering":
        a, t = xs - xs.mean(axis=0), xt - xs.mean(axis=0)
    elif method == "coral":
        a = (xs - xs.mean(axis=0)) @ A.coral_weights(np.cov(xs, rowvar=False), np.cov(xc, rowvar=False), study.coral_reg) + xc.mean(axis=0)
    elif method == "tca":
        rng = np.random.default_rng(study.seed)
        n = len(xs) + len(xc)
        cs, cc = (len(xs), len(xc)) if n <= study.tca_rows else (max(100, study.tca_rows * len(xs) // n), max(50, study.tca_rows * len(xc) // n))
        pick = lambda x, k: x[rng.choice(len(x), min(k, len(x)), replace=False)]
        mean, sd, w = A.transfer_components(pick(xs, cs), pick(xc, cc), min(study.tca_components, xs.shape[1]), study.tca_mu)
        a, t = (xs - mean) / sd @ w, (xt - mean) / sd @ w
    elif method == "sa":
        k = min(study.sa_components, xs.shape[1])
        ps, pt = A.subspace(np.cov(xs, rowvar=False), k), A.subspace(np.cov(xc, rowvar=False), k)
        k = min(ps.shape[1], pt.shape[1])  # axes beyond the rank of either side are rounding
        ps, pt = ps[:, :k], pt[:, :k]
        a, t = (xs - xs.mean(axis=0)) @ ps @ (ps.T @ pt), (xt - xc.mean(axis=0)) @ pt
    elif method != "raw":
        raise ValueError(f"unknown method {method}")
    a, t = z(a, t)
    rows = np.random.default_rng(study.seed).permutation(len(a))[: study.ridge_rows]
    model = ridge.fit(a[rows], ys[rows])
    acc, bal, f1 = scores(yt, model.predict(t))
    after = shift(a, t)
    return {"accuracy": acc, "balanced_accuracy": bal, "macro_f1": f1, "best_alpha": model.alpha, "cov_before": before[0], "cov_after": after[0], "mmd_before": before[1], "mmd_after": after[1], "n_train": len(xs), "n_calibration": len(xc), "n_test": len(xt)}


class Source:
    """A fold's source rows, and what follows from them alone: worked out once for all folds, methods and seeds that share them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self._known = x, y, {}

    def once(self, key, make):
        if key not in self._known:
            self._known[key] = make()
        return self._known[key]

    def mean(self) -> np.ndarray:
        return self.once("mean", lambda: self.x.mean(axis=0))

    def cov(self) -> np.ndarray:
        return self.once("cov", lambda: np.atleast_2d(np.cov(self.x, rowvar=False)))

    def rows(self, study: Study) -> ridge.Factored:
        """The rows that ridge learns from: all, or those that a seed draws."""
        if len(self.x) <= study.ridge_rows:
            return self.once("rows", lambda: ridge.Factored(self.x, self.y))
        some = lambda: np.random.default_rng(study.seed).permutation(len(self.x))[: study.ridge_rows]
        return self.once(("rows", study.seed), lambda: (lambda at: ridge.Factored(self.x[at], self.y[at]))(some()))

    def triangle(self, study: Study) -> np.ndarray:
        """R of all rows about their mean: R W has the lengths and angles of the rows moved by W."""
        return self.rows(study).r if len(self.x) <= study.ridge_rows else self.once("triangle", lambda: np.linalg.qr(self.x - self.mean(), mode="r"))

    def fitted(self, w: np.ndarray, study: Study) -> tuple[np.ndarray, np.ndarray, ridge.Ridge]:
        """(spread, covariance, ridge) of the rows moved by W, standardised."""
        moved = self.triangle(study) @ w
        sd = np.sqrt((moved**2).sum(axis=0) / len(self.x))
        sd = np.where(sd < 1e-8, 1, sd)
        moved, drawn = moved / sd, self.rows(study)
        model = drawn.fit(w / sd)
        return sd, moved.T @ moved / max(len(self.x) - 1, 1), ridge.Ridge(model.classes, model.coef, model.intercept - (drawn.mean - self.mean()) @ (w / sd) @ model.coef, model.alpha)


def evaluated(source: Source, xc: np.ndarray, xt: np.ndarray, yt: np.ndarray, method: str, study: Study) -> dict:
    """evaluate() with what follows from the source alone shared: every method moves the source's rows by a matrix W, so that
    spread, covariance and ridge follow from the source's QR factors."""
    xs = source.x
    if min(len(xs), len(xt)) < 1 or (method in ("coral", "sa", "tca") and min(len(xs), len(xc)) < 2):
        raise ValueError(f"too few rows for {method}: {len(xs)} source, {len(xc)} calibration, {len(xt)} final")
    plain = source.once(("plain", study.seed), lambda: source.fitted(np.eye(xs.shape[1]), study))

    def shifted(cov: np.ndarray, t: np.ndarray) -> tuple[float, float]:
        """shift() between standardised source rows and t."""
        far = np.linalg.norm(cov - np.cov(t, rowvar=False)) if min(len(xs), len(t)) > 2 else float("nan")
        return float(far), float((t.mean(axis=0) ** 2).sum())

    t = (xt - source.mean()) / plain[0]
    before = shifted(plain[1], t)
    if method in ("raw", "centering"):  # a shift goes with the mean
        (_, _, model), after = plain, before
    else:
        if method == "coral":
            w, mean, t = A.coral_weights(source.cov(), np.atleast_2d(np.cov(xc, rowvar=False)), study.coral_reg), xc.mean(axis=0), xt
        elif method == "tca":
            rng = np.random.default_rng(study.seed)
            n = len(xs) + len(xc)
            cs, cc = (len(xs), len(xc)) if n <= study.tca_rows else (max(100, study.tca_rows * len(xs) // n), max(50, study.tca_rows * len(xc) // n))
            pick = lambda x, k: x[rng.choice(len(x), min(k, len(x)), replace=False)]
            both, sd, w = A.transfer_components(pick(xs, cs), pick(xc, cc), min(study.tca_components, xs.shape[1]), study.tca_mu)
            w = w / sd[:, None]
            mean, t = (source.mean() - both) @ w, (xt - both) @ w
        elif method == "sa":
            k = min(study.sa_components, xs.shape[1])
            ps, pt = source.once(("axes", k), lambda: A.subspace(source.cov(), k)), A.subspace(np.atleast_2d(np.cov(xc, rowvar=False)), k)
            k = min(ps.shape[1], pt.shape[1])  # axes beyond the rank of either side are rounding
            ps, pt = ps[:, :k], pt[:, :k]
            w, mean, t = ps @ (ps.T @ pt), np.zeros(k), (xt - xc.mean(axis=0)) @ pt
        else:
            raise ValueError(f"unknown method {method}")
        sd, cov, model = source.fitted(w, study)
        t = (t - mean) / sd
        after = shifted(cov, t)
    acc, bal, f1 = scores(yt, model.predict(t))
    return {"accuracy": acc, "balanced_accuracy": bal, "macro_f1": f1, "best_alpha": model.alpha, "cov_before": before[0], "cov_after": after[0], "mmd_before": before[1], "mmd_after": after[1], "n_train": len(xs), "n_calibration": len(xc), "n_test": len(xt)}


def run_folds(features: DataFrame, pool: DataFrame, folds: DataFrame, study: Study, at_once: int = 1000) -> DataFrame:
    """Result rows of (subject_id, method, seed, config_hash) folds.

    features: subject_id, row_id, y, features, and side (held: calibration, kept: final) or, where that depends on the
    seed, held_seeds: the seeds in which a row is held. A fold's seed also draws the rows for ridge and TCA. pool: fold, subject_id pairs, the
    sources of each fold: the first subjects, less the fold's own (see split.source_pool). A subject gives study.per_subject rows at most and a pool
    has study.pool at most, by class shares. Folds whose pools end alike share the rows up to that end: a group is these and about at_once rows of
    folds' own, or one fold; what follows from the pool alone is worked out once a group. The pool's cap and at_once bound a group.
    An error is a row, not a failed job. Folds with nothing pending are sent no rows.
    """
    seeded = "held_seeds" in features.columns
    held = F.col("held_seeds") if seeded else F.when(F.col("side") == "held", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    held = F.coalesce(held.cast("array<int>"), F.array().cast("array<int>"))
    asked = folds.select(F.col("subject_id").alias("fold"), "method", "seed", "config_hash")
    asked = asked.groupBy("fold").agg(F.collect_list(F.struct("method", "seed", "config_hash")).alias("grid"))  # a few methods and seeds
    own_pool = pool.join(asked.select("fold"), "fold", "left_semi")
    given = staged(by_sums.capped(features.select("subject_id", "row_id", "y", "features"), study))
    ends = durable(own_pool.groupBy("fold").agg(F.max("subject_id").alias("last")))
    buckets = max(1, -(-features.count() // at_once))
    less = by_sums.dropped(given.drop("features"), own_pool, study).groupBy("fold").agg(F.collect_list("row_id").alias("less"))  # about two subjects' rows
    nowhere = F.lit(-(1 << 31)).cast("int")  # the end of an empty pool
    asked = asked.join(ends, "fold", "left").join(less, "fold", "left").withColumn("last", F.coalesce(F.col("last").cast("int"), nowhere)).withColumn("bucket", F.pmod(F.xxhash64("fold"), F.lit(buckets)).cast("int"))
    asked = staged(asked)
    where = asked.select("fold", "last", "bucket")
    groups = where.select("last", "bucket").distinct()
    shared = given.join(F.broadcast(groups), F.col("subject_id") <= F.col("last")).select("last", "bucket", "subject_id", "row_id", "y", "features")
    shared = shared.unionByName(asked.select("last", "bucket", "fold", "grid", "less"), allowMissingColumns=True)
    own = features.select(F.col("subject_id").alias("fold"), "row_id", "y", "features", held.alias("held")).join(where, "fold").select("last", "bucket", "fold", "row_id", "y", "features", "held")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def fold(number: int, grid: list[dict], source: Source | ValueError, mine: pa.Table) -> list[dict]:
        """A fold's result rows."""
        failed, results = source if isinstance(source, ValueError) else None, []
        y, seeds = mine.column("y").to_numpy(), mine.column("held").to_pylist()
        try:
            x = matrix(mine.column("features").combine_chunks())
        except ValueError as e:  # rows of unequal width
            failed = e
        for a in sorted(grid, key=lambda a: (a["method"], a["seed"])):
            out = dict.fromkeys(names) | {"subject_id": number, **a}
            try:
                if failed:
                    raise failed
                calibration = np.array([bool(h) and (not seeded or a["seed"] in h) for h in seeds], bool)
                out |= evaluated(source, x[calibration], x[~calibration], y[~calibration], a["method"], replace(study, seed=a["seed"]))
            except (ValueError, np.linalg.LinAlgError, IndexError) as e:
                out["error"] = str(e)[:200]
            results.append({k: None if v != v else v for k, v in out.items()})  # what too few rows leave undefined is null
        return results

    def one(key: tuple, given: pa.Table, sent: pa.Table) -> pa.Table:
        grids = {f: (g, tuple(sorted(n or ()))) for f, g, n in zip(*(given.column(c).to_pylist() for c in ("fold", "grid", "less")), strict=True) if g is not None}
        rows = given.filter(pc.is_valid(given.column("row_id"))).combine_chunks().sort_by("row_id")  # draws of rows agree between runs
        of, ids, ys = (rows.column(c).to_numpy() for c in ("subject_id", "row_id", "y"))
        try:
            xs = matrix(rows.column("features").combine_chunks())
        except ValueError as e:  # rows of unequal width
            xs = e
        sent = sent.combine_chunks().sort_by([("fold", "ascending"), ("row_id", "ascending")])
        numbers, known, results = sent.column("fold").to_numpy(), {}, []
        for number, (grid, less) in sorted(grids.items()):
            mine = sent.slice(lo := int(np.searchsorted(numbers, number)), int(np.searchsorted(numbers, number, side="right")) - lo)
            source = xs
            if not isinstance(xs, ValueError):
                beyond = number > key[0].as_py()  # most folds: their pools leave out the same rows
                source = known.get(less) if beyond else None
                if source is None:
                    some = (of != number) & ~np.isin(ids, less)
                    source = Source(xs[some], ys[some])
                    if beyond and not known:
                        known[less] = source
            results += fold(number, grid, source, mine)
        return pa.Table.from_pylist(results, RESULT_ARROW)

    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of its own
    dealt = lambda df: apart(df).repartition(buckets, "last", "bucket").groupBy("last", "bucket")
    return dealt(shared).cogroup(dealt(own)).applyInArrow(one, RESULT)


def run_whole(features: DataFrame, folds: DataFrame, study: Study, at_once: int = 512, rows_at_once: int = 8192) -> DataFrame:
    """Result rows of folds that learn from all rows of all other subjects: run_folds() without any cap.

    features: subject_id, row_id, y, features, held_seeds (the seeds in which a row calibrates). A pool's sums are those of all
    rows less the fold's own (see folds), and every method moves the pool by a matrix that follows from them. What does not is the
    strength of ridge: every row of every pool is left out once. For that, blocks of about at_once folds meet blocks of about
    rows_at_once rows; rows alike in class and features are one with their number. Errors are summed by fold; a second pass fits
    with the strength of least error. An error is a row, not a failed job. Work grows with folds times rows that differ.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]
    mean = tall.moments(features, "features")[1] if features.head(1) else np.zeros(1)
    shift = features.sparkSession.sparkContext.broadcast(mean)  # near it sums lose no digits; no result depends on it

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], A.lists(matrix(batch.column(4)) - shift.value)], names=["fold", "row_id", "y", "held", "features"])

    held = F.coalesce(F.col("held_seeds").cast("array<int>"), F.array().cast("array<int>")).alias("held")
    rows = features.select(F.col("subject_id").cast("int").alias("fold"), F.col("row_id").cast("bigint").alias("row_id"), F.col("y").cast("int").alias("y"), held, F.col("features").cast("array<double>").alias("features"))
    rows = rows.mapInArrow(centred, "fold int, row_id bigint, y int, held array<int>, features array<double>")
    rows = staged(rows.withColumn("same", F.unhex(F.md5(F.concat_ws(",", F.col("y").cast("string"), F.col("features").cast("array<string>"))))))
    classes = int(rows.agg(F.max("y")).first()[0] or 0) + 1
    tiles = staged(by_sums.grams(rows.select(F.lit(0).alias("all"), "y", "features"), ["all"], classes).select("tile", "v"))
    alike = staged(rows.groupBy("same").agg(F.first("y").alias("y"), F.first("features").alias("features"), F.count(F.lit(1)).alias("times")))
    asked = folds.select(F.col("subject_id").cast("int").alias("fold"), "method", "seed", "config_hash").groupBy("fold").agg(F.collect_list(F.struct("method", "seed", "config_hash")).alias("grid"))  # a few methods and seeds
    asked = staged(asked)
    cores = features.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-alike.count() // rows_at_once))
    buckets = max(1, -(-(several := asked.count()) // at_once), min(several, -(-3 * cores // blocks)))
    bucket = F.pmod(F.xxhash64("fold"), F.lit(buckets)).cast("int").alias("bucket")
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = rows.join(asked, "fold").select(bucket, "fold", "row_id", "y", "held", "features", "same", "grid")
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of its own

    def each(tiles: list[np.ndarray], at: list[int], own: pa.Table) -> Iterator[tuple]:
        """(fold, grid, its rows' places, x, y, held, sums of its pool) of each fold there."""
        total = by_sums.assembled([(1.0, i, v) for i, v in zip(at, tiles, strict=True)])
        own = own.combine_chunks().sort_by([("fold", "ascending"), ("row_id", "ascending")])
        numbers = own.column("fold").to_numpy()
        for number in np.unique(numbers):
            lo, hi = np.searchsorted(numbers, number), np.searchsorted(numbers, number, side="right")
            mine = own.slice(lo, hi - lo)
            x, y = matrix(mine.column("features").combine_chunks()), mine.column("y").to_numpy()
            u = np.concatenate((np.ones((len(x), 1)), x, y[:, None] == np.arange(classes)), axis=1)
            yield int(number), mine.column("grid")[0].as_py(), mine, x, y, mine.column("held").to_pylist(), by_sums.Sums(total - u.T @ u, classes)

    def sides(x: np.ndarray, held: list[list[int]], seed: int) -> tuple[np.ndarray, by_sums.Sums, by_sums.Sums]:
        """(final or not, sums of the calibration rows, of the final ones)."""
        final = np.array([seed not in h for h in held], bool)
        return final, by_sums.Sums.of(x[~final], classes), by_sums.Sums.of(x[final], classes)

    FAULTS = (ValueError, np.linalg.LinAlgError, IndexError)

    def leave_out(key: tuple, pool: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        at, values = pool.column("tile").to_pylist(), pool.column("v").combine_chunks()
        tiles = [(i, np.asarray(v.values)) for i, v in zip(at, values, strict=True) if i is not None]
        pool = pool.filter(pc.is_valid(pool.column("same"))).combine_chunks().sort_by("same")
        xs, ys, times = matrix(pool.column("features").combine_chunks()), pool.column("y").to_numpy(), pool.column("times").to_numpy().astype(float)
        place = {s: i for i, s in enumerate(pool.column("same").to_pylist())}
        targets = np.where(ys[:, None] == np.arange(classes), 1.0, -1.0)
        for number, grid, mine, x, _, held, s in each([v for _, v in tiles], [i for i, _ in tiles], own) if len(pool) and tiles else ():
            weights = times.copy()
            for k in mine.column("same").to_pylist():
                if k in place:
                    weights[place[k]] -= 1
            known = {}
            for a in sorted(grid, key=lambda a: (a["method"], a["seed"])):
                _, c, t = sides(x, held, a["seed"])
                alone = a["method"] in ("raw", "centering")  # follows from the pool, and a shift changes nothing
                try:
                    by_sums.checked(a["method"], s, c, t)
                    errors = known.get("pool") if alone else None
                    if errors is None:
                        turned, values, uy = by_sums.turned(a["method"], s, c, replace(study, seed=a["seed"]))
                        errors = weights @ ridge.left_out((xs - s.mean) @ turned, targets - s.ymean, values, uy, s.n)
                        if alone:
                            known["pool"] = errors
                except FAULTS:
                    continue  # told by the second pass
                out.append({"fold": number, "method": a["method"], "seed": a["seed"], "block": key[1].as_py(), "errors": errors.tolist()})
        return pa.Table.from_pylist(out, pa.schema([("fold", pa.int32()), ("method", pa.string()), ("seed", pa.int32()), ("block", pa.int32()), ("errors", pa.list_(pa.float64()))]))

    block = F.pmod(F.xxhash64("same"), F.lit(blocks)).cast("int").alias("block")
    given = alike.select(block, "same", "y", "features", "times").select(every("bucket", buckets), "*")
    given = given.unionByName(tiles.select(every("block", blocks), "*").select(every("bucket", buckets), "*"), allowMissingColumns=True)
    met = apart(given).repartition(blocks * buckets, "bucket", "block").groupBy("bucket", "block").cogroup(apart(own.select("*", every("block", blocks))).repartition(blocks * buckets, "bucket", "block").groupBy("bucket", "block"))
    errors = staged(met.applyInArrow(leave_out, "fold int, method string, seed int, block int, errors array<double>"))

    def fit(key: tuple, given: pa.Table, own: pa.Table) -> pa.Table:
        results, tiles, sums = [], [], {}
        given = given.combine_chunks().sort_by("block")  # sums agree between runs
        for number, method, seed, e, tile, v in zip(*(given.column(c).to_pylist() for c in ("fold", "method", "seed", "errors", "tile")), given.column("v").combine_chunks(), strict=True):
            if tile is not None:
                tiles.append((tile, np.asarray(v.values)))
            else:
                sums[number, method, seed] = sums.get((number, method, seed), 0) + np.array(e)
        for number, grid, _, x, y, held, s in each([v for _, v in tiles], [i for i, _ in tiles], own) if len(own) else ():
            for a in sorted(grid, key=lambda a: (a["method"], a["seed"])):
                out = dict.fromkeys(names) | {"subject_id": number, **a}
                final, c, t = sides(x, held, a["seed"])
                try:
                    by_sums.checked(a["method"], s, c, t)
                    best = ridge.ALPHAS[int(np.argmin(sums[number, a["method"], a["seed"]]))]
                    model = by_sums.fitted(a["method"], s, c, t, replace(study, seed=a["seed"]), (best,))
                    some = np.flatnonzero(np.round(s.counts) > 0)
                    p = some[np.argmax((x[final] @ model.pop("slope") + model.pop("const"))[:, some], axis=1)]
                    out |= model | dict(zip(("accuracy", "balanced_accuracy", "macro_f1"), scores(y[final], p), strict=True))
                except (*FAULTS, KeyError) as e:
                    out["error"] = str(e)[:200]
                results.append({k: None if isinstance(v, float) and v != v else v for k, v in out.items() if k in names})
        return pa.Table.from_pylist(results, RESULT_ARROW)

    given = errors.select(bucket, "*").unionByName(tiles.select(every("bucket", buckets), "*"), allowMissingColumns=True)
    return apart(given).groupBy("bucket").cogroup(apart(own).groupBy("bucket")).applyInArrow(fit, RESULT)


WITHIN = "subject_id int, seed int, accuracy double, balanced_accuracy double, macro_f1 double, best_alpha double, n_train int, n_test int, error string"


def within_subject(rows: DataFrame) -> DataFrame:
    """One result a (subject, split seed): a ridge on the subject's kept rows, tested on its held ones.

    rows: subject_id, seed, y, side (held: tested), features. Scaled by the kept rows; the strength by leave-one-out
    accuracy over the fine grid. Sorted tasks hold one subject's recording and one batch at a time. An error is a row, not a
    failed job.
    """
    names = [c.split()[0] for c in WITHIN.split(", ")]
    schema = pa.schema([(n, {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (c.split() for c in WITHIN.split(", "))])

    def told(subject: int, seed: int, got: pa.Table) -> dict:
        out = dict.fromkeys(names) | {"subject_id": subject, "seed": seed}
        x, y = matrix(got.column("features").combine_chunks()), got.column("y").to_numpy()
        side = np.array(got.column("side").to_pylist())
        train, test = side == "kept", side == "held"
        out |= {"n_train": int(train.sum()), "n_test": int(test.sum())}
        if not test.any() or len(np.unique(y[train])) < 2:
            return out | {"error": "too few rows or classes to split"}
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        sd = np.where(sd < 1e-8, 1, sd)
        model = ridge.fit((x[train] - mean) / sd, y[train], ridge.FINE_ALPHAS, by_accuracy=True)
        acc, bal, f1 = scores(y[test], model.predict((x[test] - mean) / sd))
        return out | {"accuracy": acc, "balanced_accuracy": bal, "macro_f1": f1, "best_alpha": model.alpha}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            at, results = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), []
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts and at[a] != now:
                    results.append(told(*now, pa.Table.from_batches(parts)))
                    parts = []
                now = at[a]
                parts.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_pylist(results, schema)
        if parts:
            yield pa.RecordBatch.from_pylist([told(*now, pa.Table.from_batches(parts))], schema)

    by = ["subject_id", "seed"]
    return rows.select(*by, "y", "side", "features").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, WITHIN)
