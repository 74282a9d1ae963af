"""Leave-one-subject-out folds by sums: features are added up once, and a fold's pool follows by adding and subtracting.

A row u = (1, x, its class as 0/1) adds u u' to its groups. Source pools are prefixes of one list of subjects less the fold's own, so
that a pool's sum is that of the prefix, less the subject's own rows, less what the pool's cap leaves out. From the sums
follow means, covariances, CORAL, principal axes, ridge and the distances between domains: rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.config import Study
from kinetra.durable import durable, staged
from kinetra.operators import adapt as A
from kinetra.operators import ridge, split
from kinetra.operators.adapt import matrix

#: A tile is so many rows of a matrix at most, and so many numbers about: Parquet and the sort hold a hundred rows at a time.
TILE, NUMBERS = 256, 1 << 17


def capped(features: DataFrame, study: Study) -> DataFrame:
    """The rows that a subject gives to others' pools: at most study.per_subject, by class shares; with _h, their order."""
    rows = features.withColumn("_h", split.hashed(study.seed, "row_id"))
    return split.stratified(rows, "y", study.per_subject, ["_h", "row_id"], keys=("subject_id",))


def dropped(rows: DataFrame, pool: DataFrame, study: Study) -> DataFrame:
    """(fold, row_id) of capped rows that a fold's pool leaves out where it has more than study.pool rows.

    Of each class floor(share * cap) rows stay, one at least: the first by hash. Only the last rows of each class of a prefix of
    subjects can be left out, so that a fold is matched with about as many rows as it drops and has itself.
    """
    ends = durable(pool.groupBy("fold").agg(F.max("subject_id").alias("last")))
    own = rows.groupBy(F.col("subject_id").alias("fold"), "y").agg(F.count(F.lit(1)).alias("own"))
    ids = rows.select("subject_id", "row_id", "y", "_h")
    lasts = ends.select("last").distinct()
    # A pool's cap bounds these: cap and one subject's rows for each distinct end of a pool.
    prefix = ids.join(F.broadcast(lasts), F.col("subject_id") <= F.col("last"))
    ranked = durable(prefix.withColumn("back", F.row_number().over(Window.partitionBy("last", "y").orderBy(F.col("_h").desc(), F.col("row_id").desc()))))
    counts = ranked.groupBy("last", "y").agg(F.count(F.lit(1)).alias("all"))
    sized = ends.join(counts, "last").join(own, ["fold", "y"], "left").withColumn("own", F.when(F.col("fold") <= F.col("last"), F.coalesce("own", F.lit(0))).otherwise(0))
    sized = sized.withColumn("c", F.col("all") - F.col("own")).withColumn("n", F.sum("c").over(Window.partitionBy("fold")))
    quota = F.greatest(F.lit(1), F.floor(F.col("c") / F.col("n") * study.pool))
    asked = sized.where(F.col("n") > study.pool).withColumn("less", F.greatest(F.lit(0), F.col("c") - quota)).where("less > 0")
    deepest = asked.groupBy("last", "y").agg(F.max(F.col("less") + F.col("own")).alias("_most"))  # a row an end and class
    last = ranked.join(F.broadcast(deepest), ["last", "y"]).where(F.col("back") <= F.col("_most")).drop("_most")  # ids of about two subjects an end
    near = asked.select("fold", "last", "y", "less", "own").join(F.broadcast(last), ["last", "y"]).where((F.col("back") <= F.col("less") + F.col("own")) & (F.col("subject_id") != F.col("fold")))
    k = F.row_number().over(Window.partitionBy("fold", "y").orderBy("back"))
    return near.withColumn("_k", k).where("_k <= less").select("fold", "row_id")


def grams(rows: DataFrame, keys: list[str], classes: int, most: int = 16_384) -> DataFrame:
    """keys, tile, v: the summed u u' of each group's rows (keys, y, features), by tiles of rows from the diagonal on.

    A group of more than `most` rows is dealt over parts, which meet by tiles. A task holds one matrix, of the group it is in.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = rows.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("features", "y"), F.ceil(F.col("_n") / most).cast("bigint")).cast("int"))
    schema = ", ".join([f"`{c}` {dict(rows.dtypes)[c]}" for c in keys]) + ", tile int, v array<double>"
    kinds = [rows.schema[c].dataType for c in keys]

    def told(key: tuple, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        step = max(1, min(TILE, NUMBERS // len(total)))
        for i in range(0, len(total), step):
            v = total[i : i + step, i:].ravel()
            yield pa.RecordBatch.from_arrays([*[pa.array([k], to_arrow_type(t)) for k, t in zip(key, kinds, strict=True)], pa.array([i], pa.int32()), A.lists(v[None])], names=[*keys, "tile", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]  # keys and part
            at = list(zip(*columns, strict=True))
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
            x, y = matrix(batch.column(len(keys) + 2)), batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            u = np.concatenate((np.ones((len(x), 1)), x, y[:, None] == np.arange(classes)), axis=1)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and at[a] != now:
                    yield from told(now[:-1], total)
                    total = None
                now, add = at[a], u[a:b].T @ u[a:b]
                total = add if total is None else total + add
        if now is not None:
            yield from told(now[:-1], total)

    dealt = parts.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").select(*keys, "_part", "y", "features")
    return added(dealt.mapInArrow(run, schema), keys)


def added(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tile, v: tiles of one group and place added up."""
    schema = ", ".join(f"`{c}` {t}" for c, t in tiles.select(*keys, "tile", "v").dtypes)

    def add(key: tuple, got: pa.Table) -> pa.Table:
        v = got.column("v").combine_chunks()
        one = A.lists(np.asarray(v.flatten()).reshape(len(v), -1).sum(axis=0)[None])
        return pa.table({**{c: got.column(c).slice(0, 1) for c in keys}, "tile": got.column("tile").slice(0, 1), "v": one})

    return tiles.select(*keys, "tile", "v").groupBy(*keys, "tile").applyInArrow(add, schema)


class Sums:
    """n, mean, cov (divided by n - 1), x'y about the means and class counts of a group, from its summed u u'."""

    def __init__(self, total: np.ndarray, classes: int):
        p = len(total) - 1 - classes
        self.n, s, self.counts = total[0, 0], total[0, 1 : p + 1], total[0, p + 1 :]
        self.mean = s / max(self.n, 1)
        self.cov = (total[1 : p + 1, 1 : p + 1] - np.outer(s, self.mean)) / max(self.n - 1, 1)
        # Sides of +-1: twice the 0/1 column, less 1.
        self.ymean = 2 * self.counts / max(self.n, 1) - 1
        self.xy = 2 * total[1 : p + 1, p + 1 :] - s[:, None] - np.outer(s, self.ymean)
        self._known: dict = {}

    def once(self, key, make):
        """What follows from these sums alone is worked out once, for all methods, seeds and folds that share them."""
        if key not in self._known:
            self._known[key] = make()
        return self._known[key]

    def subspace(self, k: int) -> np.ndarray:
        return self.once(("axes", k), lambda: A.subspace(self.cov, k))

    @classmethod
    def of(cls, x: np.ndarray, classes: int) -> Sums:
        """Of a few rows at hand: n, mean and covariance without a difference of sums, so that no axis is rounding alone."""
        out = cls(np.zeros((1 + x.shape[1] + classes,) * 2), classes)
        out.n = float(len(x))
        if len(x):
            out.mean = x.mean(axis=0)
        if len(x) > 1:
            out.cov = np.atleast_2d(np.cov(x, rowvar=False))
        return out


def assembled(tiles: list[tuple[float, int, np.ndarray]]) -> np.ndarray | None:
    """The whole symmetric matrix of (sign, tile, values)."""
    if not tiles:
        return None
    first, starts = next(len(v) for _, i, v in tiles if i == 0), sorted({i for _, i, _ in tiles})
    size = first // starts[1] if len(starts) > 1 else int(np.sqrt(first))
    total = np.zeros((size, size))
    for sign, i, v in tiles:
        rows = v.reshape(-1, size - i)
        total[i : i + len(rows), i:] += sign * rows
    for i in range(size):  # mirrored in place
        total[i + 1 :, i] = total[i, i + 1 :]
    return total


def maps(method: str, s: Sums, c: Sums, study: Study) -> tuple[tuple, tuple]:
    """(shift, weights or None, offset) of source and of target rows: x goes to (x - shift) W + offset."""
    zero = np.zeros(len(s.mean))
    if method == "raw":
        return (zero, None, zero), (zero, None, zero)
    if method == "centering":
        return (s.mean, None, zero), (s.mean, None, zero)
    if method == "coral":
        return (s.mean, A.coral_weights(s.cov, c.cov, study.coral_reg), c.mean), (zero, None, zero)
    if method == "sa":
        ps, pt = s.subspace(study.sa_components), c.subspace(study.sa_components)
        k = min(ps.shape[1], pt.shape[1])
        ps, pt = ps[:, :k], pt[:, :k]
        return (s.mean, ps @ (ps.T @ pt), c.mean[:k]), (c.mean, pt, c.mean[:k])
    if method == "tca":
        mean, w = A.transfer_by_sums((s.n, s.mean, s.cov), (c.n, c.mean, c.cov), min(study.tca_components, len(s.mean)), study.tca_mu)
        return (mean, w, np.zeros(w.shape[1])), (mean, w, np.zeros(w.shape[1]))
    raise ValueError(f"{method} does not follow from sums")


def checked(method: str, s: Sums, c: Sums, t: Sums) -> None:
    if min(s.n, t.n) < 1 or (method in ("coral", "sa", "tca") and min(s.n, c.n) < 2):
        raise ValueError(f"too few rows for {method}: {s.n:.0f} source, {c.n:.0f} calibration, {t.n:.0f} final")


def spread(cov: np.ndarray, n: float) -> np.ndarray:
    """The deviations (divided by n) of a covariance's columns, 1 where a column does not vary."""
    sd = np.sqrt(np.maximum(np.diag(cov), 0) * (n - 1) / n)
    return np.where(sd < 1e-8, 1, sd)


def fitted(method: str, s: Sums, c: Sums, t: Sums, study: Study, alphas: Iterable[float] = ridge.ALPHAS) -> dict:
    """A fold's model by one method: coefficients of target rows as they are, the strength, distances before and after.

    Ridge is on all rows of the pool; of alphas the strength has the least generalised cross-validation error, which sums suffice for.
    """
    checked(method, s, c, t)

    def moved(x: Sums, to: tuple) -> tuple[np.ndarray, np.ndarray]:
        shift, w, offset = to
        return (x.mean - shift + offset, x.cov) if w is None else ((x.mean - shift) @ w + offset, w.T @ x.cov @ w)

    def distances(a: tuple, b: tuple, sd: np.ndarray) -> tuple[float | None, float]:
        cov = float(np.linalg.norm((a[1] - b[1]) / np.outer(sd, sd))) if min(s.n, t.n) > 2 else None
        return cov, float((((a[0] - b[0]) / sd) ** 2).sum())

    before = distances((s.mean, s.cov), (t.mean, t.cov), spread(s.cov, s.n))
    source, target = maps(method, s, c, study)
    a, b = moved(s, source), moved(t, target)
    sd = spread(a[1], s.n)
    after = distances(a, b, sd)
    xy = (s.xy if source[1] is None else source[1].T @ s.xy) / sd[:, None]
    solved = lambda: ridge.by_sums(a[1] / np.outer(sd, sd) * (s.n - 1), xy, (1 - s.ymean**2).sum() * s.n, s.n, alphas)
    alpha, coef = s.once("ridge", solved) if source[1] is None else solved()  # a shift changes neither
    model = coef / sd[:, None]
    slope = model if target[1] is None else target[1] @ model
    const = s.ymean + (target[2] - a[0]) @ model - target[0] @ slope
    return {"slope": slope, "const": const, "best_alpha": alpha, "importance": np.abs(coef).mean(axis=1), "cov_before": before[0], "mmd_before": before[1], "cov_after": after[0], "mmd_after": after[1], "n_train": int(s.n), "n_calibration": int(c.n), "n_test": int(t.n)}


def turned(method: str, s: Sums, c: Sums, study: Study) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, values, P'X'Y): by P source rows about their mean are adapted, standardised and turned to the axes of their ridge, where X'X
    has these values on its diagonal."""
    (_, w, _), _ = maps(method, s, c, study)
    w = np.eye(len(s.mean)) if w is None else w
    cov = w.T @ s.cov @ w
    w = w / spread(cov, s.n)
    cov = w.T @ s.cov @ w
    values, vectors = np.linalg.eigh((cov + cov.T) / 2 * (s.n - 1))
    return w @ vectors, np.maximum(values, 0), vectors.T @ (w.T @ s.xy)


def summed_prefixes(features: DataFrame, pool: DataFrame, study: Study, classes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(capped rows; fold, last: the last subject of each fold's pool; last, tile, v: the sums of all subjects up to it)."""
    rows = staged(capped(features.select("subject_id", "row_id", "y", "features"), study))
    ends = durable(pool.groupBy("fold").agg(F.max("subject_id").alias("last")))
    lasts = ends.select("last").distinct()
    # Subjects between two ends of pools are one bucket; a prefix is the sum of its buckets.
    buckets = rows.select("subject_id").distinct().join(F.broadcast(lasts), F.col("subject_id") <= F.col("last")).groupBy("subject_id").agg(F.min("last").alias("bucket"))
    by_bucket = staged(grams(rows.join(buckets, "subject_id").select("bucket", "y", "features"), ["bucket"], classes))
    met = by_bucket.join(F.broadcast(lasts), F.col("bucket") <= F.col("last"))  # ends times ends, whatever the folds
    prefixes = staged(added(met, ["last"]))
    return rows, ends, prefixes


def fold_sums(features: DataFrame, pool: DataFrame, wanted: DataFrame, study: Study, classes: int, kinds: tuple[str, ...] = ("source", "calibration", "final")) -> DataFrame:
    """fold, seed, kind, sign, tile, v: the sums of which each fold's source, calibration and final rows are made.

    features: subject_id, row_id, y, features, held_seeds (the seeds in which a row calibrates). wanted: fold, seed. Sums with a null
    seed serve all seeds of their fold. A pool is the sum of kind 'source': prefixes with sign 1, what they have too much with -1.
    """
    rows, ends, prefixes = summed_prefixes(features, pool, study, classes)
    folds = wanted.select("fold").distinct()
    own = grams(rows.join(folds.join(ends, "fold").where("fold <= last"), rows.subject_id == F.col("fold")).select("fold", "y", "features"), ["fold"], classes)
    out = dropped(rows, pool.join(folds, "fold", "left_semi"), study)
    less = grams(rows.join(out, "row_id").select("fold", "y", "features"), ["fold"], classes)
    none = F.lit(None).cast("int").alias("seed")
    made = lambda df, kind, sign, seed=none: df.select("fold", seed, F.lit(kind).alias("kind"), F.lit(float(sign)).alias("sign"), "tile", "v")
    parts = made(folds.join(ends, "fold").join(prefixes, "last"), "source", 1).unionByName(made(own, "source", -1)).unionByName(made(less, "source", -1))
    sides = features.withColumnRenamed("subject_id", "fold").join(wanted, "fold").withColumn("held", F.array_contains("held_seeds", F.col("seed")))
    for kind, of in (("calibration", F.col("held")), ("final", ~F.col("held"))):
        if kind in kinds:
            parts = parts.unionByName(made(grams(sides.where(of).select("fold", "seed", "y", "features"), ["fold", "seed"], classes), kind, 1, F.col("seed")))
    return staged(parts)


RESULT = "subject_id int, method string, seed int, accuracy double, balanced_accuracy double, macro_f1 double, best_alpha double, cov_before double, cov_after double, mmd_before double, mmd_after double, n_train int, n_calibration int, n_test int, config_hash string, error string, value double, importance array<double>"


def run_by_sums(features: DataFrame, pool: DataFrame, folds: DataFrame, study: Study, at_once: int = 1 << 20) -> DataFrame:
    """Result rows, with each kernel's importance (mean size of its coefficients), of (subject_id, method, seed, config_hash) folds.

    features: subject_id, row_id, y, features, held_seeds. pool: fold, subject_id. Methods: raw, centering, coral, sa. folds may have
    `value`: the regularisation of coral or the components of sa in that row, in place of the study's, from the same sums.
    Subjects are sent as rows, once for all seeds, since most have fewer numbers than features x features. Folds whose pools end alike
    share the prefix: a group has about at_once numbers of their rows, or one subject, and a few matrices of features x
    features; what follows from the pool alone is worked out once a group. An error is a row.
    """
    from kinetra.operators.runner import scores

    width, n = features.agg(F.max(F.size("features")), F.count(F.lit(1))).first()
    classes = int(features.agg(F.max("y")).first()[0] or 0) + 1
    value = F.col("value").cast("double") if "value" in folds.columns else F.lit(None).cast("double").alias("value")
    rows, ends, prefixes = summed_prefixes(features, pool, study, classes)
    nowhere = F.lit(-(1 << 31)).cast("int")  # the end of an empty pool
    buckets = max(1, -(-int(n) * int(width or 1) // at_once))
    asked = folds.select(F.col("subject_id").alias("fold"), "method", "seed", "config_hash", value)
    asked = asked.groupBy("fold").agg(F.collect_list(F.struct("method", "seed", "config_hash", "value")).alias("grid"))  # a few methods, seeds and values
    asked = durable(asked.join(ends, "fold", "left").withColumn("last", F.coalesce("last", nowhere)).withColumn("bucket", F.pmod(F.xxhash64("fold"), F.lit(buckets)).cast("int")))
    where = asked.select("fold", "last", "bucket")
    given = prefixes.join(F.broadcast(where.select("last", "bucket").distinct()), "last").unionByName(asked, allowMissingColumns=True)
    given = given.select(*[F.col(c).alias(c) for c in ("last", "bucket", "fold", "grid", "tile", "v")])  # columns of its own, apart from sent's
    none = F.lit(None).cast("array<int>").alias("held_seeds")
    # What a pool's prefix has too much: the fold's own rows, and those that the pool's cap leaves out.
    own = rows.join(where.where("fold <= last"), rows.subject_id == F.col("fold")).select("last", "bucket", "fold", "row_id", "y", "features", none)
    out = dropped(rows, pool.join(where, "fold", "left_semi"), study).join(where, "fold")
    less = rows.drop("subject_id").join(out, "row_id").select("last", "bucket", "fold", "row_id", "y", "features", none)
    held = F.coalesce("held_seeds", F.array().cast("array<int>")).alias("held_seeds")
    sent = features.withColumnRenamed("subject_id", "fold").join(where, "fold").select("last", "bucket", "fold", "row_id", "y", "features", held).unionByName(own).unionByName(less)
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RESULT.split(", ")])

    def fold(number: int, grid: list[dict], s: Sums, u: np.ndarray, y: np.ndarray, seeds: list[list[int]], nothing: Sums) -> list[dict]:
        """A fold's result rows, of its own rows u = (1, x, class as 0/1)."""
        out, x = [], u[:, 1 : u.shape[1] - classes]
        for seed in sorted({g["seed"] for g in grid}):
            final = np.array([seed not in h for h in seeds], bool)
            c, t = (Sums(u[some].T @ u[some], classes) if some.any() else nothing for some in (~final, final))
            for a in sorted((g for g in grid if g["seed"] == seed), key=lambda g: (g["method"], g["value"] or 0)):
                own = study
                if a["value"] is not None:
                    own = replace(study, coral_reg=a["value"]) if a["method"] == "coral" else replace(study, sa_components=int(a["value"]))
                told = dict.fromkeys(names) | {"subject_id": number, **a}
                try:
                    model = fitted(a["method"], s, c, t, own)
                    some = np.flatnonzero(s.counts > 0)
                    p = some[np.argmax((x[final] @ model.pop("slope") + model.pop("const"))[:, some], axis=1)]
                    told |= model | dict(zip(("accuracy", "balanced_accuracy", "macro_f1"), scores(y[final], p), strict=True))
                except (ValueError, np.linalg.LinAlgError, IndexError) as e:
                    told["error"] = str(e)[:200]
                out.append({k: None if isinstance(v, float) and v != v else v for k, v in told.items() if k in names})
        return out

    def one(key: tuple, given: pa.Table, sent: pa.Table) -> pa.Table:
        grids, tiles = {}, []
        for number, grid, tile, v in zip(*(given.column(c).to_pylist() for c in ("fold", "grid", "tile")), given.column("v").combine_chunks(), strict=True):
            if grid is not None:
                grids[number] = grid
            elif tile is not None:
                tiles.append((1.0, tile, np.asarray(v.values)))
        prefix = assembled(tiles)
        of, ids = sent.column("fold").to_numpy(), sent.column("row_id").to_numpy()
        order = np.lexsort((ids, of))
        of, ids, sent = of[order], ids[order], sent.take(pa.array(order))
        size = 1 + classes + (len(sent.column("features")[0]) if len(sent) else 0) if prefix is None else len(prefix)
        empty = np.zeros((size, size))
        nothing, shared, results = Sums(empty, classes), {}, []
        for number in sorted(grids):
            mine = sent.slice(lo := int(np.searchsorted(of, number)), int(np.searchsorted(of, number, side="right")) - lo)
            x, y, seeds = matrix(mine.column("features").combine_chunks()), mine.column("y").to_numpy(), mine.column("held_seeds").to_pylist()
            u = np.concatenate((np.ones((len(x), 1)), x if len(x) else np.empty((0, size - 1 - classes)), y[:, None] == np.arange(classes)), axis=1)
            extra = np.array([h is None for h in seeds], bool)
            same = tuple(ids[lo : lo + len(u)][extra].tolist())  # most folds lie beyond their pool and leave out the same rows
            s = shared.get(same)
            if s is None:
                s = Sums((empty if prefix is None else prefix) - u[extra].T @ u[extra], classes)
                if len(shared) < 4:
                    shared[same] = s
            results += fold(number, grids[number], s, u[~extra], y[~extra], [h for h in seeds if h is not None], nothing)
        return pa.Table.from_pylist(results, schema)

    return given.groupBy("last", "bucket").cogroup(sent.groupBy("last", "bucket")).applyInArrow(one, RESULT)
