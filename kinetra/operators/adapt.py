"""Domain adaptation: statistics are summed on Spark, small matrices are solved once, rows are mapped in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(column: pd.Series | pa.Array) -> np.ndarray:
    """Equal-length lists as rows: an Arrow column's values lie in one buffer already."""
    if isinstance(column, pa.Array):
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    """Rows as an Arrow column of lists."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).ravel()))


def gram(df: DataFrame, features: str, tile: int = 1024) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) by partial sums of X and X'X a task, added up by row tiles of the matrix on Spark.

    What a task emits and the driver gets is features squared, whatever the rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            if total is None:
                total, square = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
            n, total = n + len(x), total + x.sum(axis=0)
            square += x.T @ x
        if total is not None:
            rows = [(-1, [float(n), *total])] + [(i, square[i : i + tile].ravel().tolist()) for i in range(0, len(total), tile)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["tile", "v"])

    def add(key: tuple, got: pa.Table) -> pa.Table:
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.sum(got.column("v").to_pylist(), axis=0)], pa.list_(pa.float64()))})

    sums = {r[0]: np.array(r[1]) for r in df.select(features).mapInArrow(part, "tile int, v array<double>").groupBy("tile").applyInArrow(add, "tile int, v array<double>").collect()}
    n, mean = int(sums[-1][0]), sums[-1][1:] / sums[-1][0]
    square = np.concatenate([sums[k] for k in sorted(sums) if k >= 0]).reshape(len(mean), -1)
    return n, mean, (square - n * np.outer(mean, mean)) / (n - 1)


def affine(df: DataFrame, features: str, shift: np.ndarray, weights: np.ndarray, offset: np.ndarray) -> DataFrame:
    """(x - shift) W + offset of each row; a broadcast of features times components."""
    held = df.sparkSession.sparkContext.broadcast((shift, weights, offset))
    at = df.columns.index(features)
    schema = ", ".join(f"`{c}` {'array<double>' if c == features else t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w, b = held.value
        for batch in batches:
            x = matrix(batch.column(at))
            y = (x - a) @ w + b if len(x) else x
            columns = list(batch.columns)
            columns[at] = lists(y)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def _cholesky(c: np.ndarray) -> np.ndarray:
    """Lower factor; up to twenty larger and larger jitters, then by eigenvalues."""
    jitter = 1e-10
    for _ in range(20):
        try:
            return np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            c, jitter = c + jitter * np.eye(len(c)), jitter * 10
    values, vectors = np.linalg.eigh(c)
    return vectors * np.sqrt(np.maximum(values, 1e-12))


def coral_weights(source: np.ndarray, target: np.ndarray, reg: float) -> np.ndarray:
    """W = Ls^-T Lt^T from the Cholesky factors of the regularised covariances."""
    eye = reg * np.eye(len(source))
    return np.linalg.solve(_cholesky(source + eye).T, _cholesky(target + eye).T)


def coral(source: DataFrame, calibration: DataFrame, features: str, reg: float = 1e-3) -> DataFrame:
    """Source rows with mean and covariance of the calibration rows; target rows stay as they are."""
    (_, ms, cs), (_, mt, ct) = gram(source, features), gram(calibration, features)
    return affine(source, features, ms, coral_weights(cs, ct, reg), mt)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive: eigenvectors have no sign of their own."""
    if not vectors.size:
        return vectors
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)


def subspace(cov: np.ndarray, k: int) -> np.ndarray:
    """The k leading axes, none beyond the rank: what lies there is rounding, not the data's."""
    values, vectors = np.linalg.eigh(cov)
    best = np.argsort(-values, kind="stable")[:k]
    return signed(vectors[:, best[values[best] > max(values.max(), 0) * len(cov) * 1e-13]])


def principal_axes(df: DataFrame, features: str, k: int, dense: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of the rows: from the summed covariance up to `dense` features, by block Lanczos (no covariance) beyond."""
    width = df.select(F.size(features)).first()
    if width is None or width[0] <= dense:
        _, mean, cov = gram(df, features)
        return mean, subspace(cov, min(k, len(mean)))
    from kinetra.operators import tall

    mean, values, axes = tall.principal(df, features, min(k, width[0]))
    return mean, signed(axes[:, values > values.max() * width[0] * 1e-13])


def aligned(source: DataFrame, target: DataFrame, features: str, components: int) -> tuple[tuple, tuple]:
    """What affine() needs for both sides: the source's principal axes turned to the target's."""
    (ms, ps), (mt, pt) = principal_axes(source, features, components), principal_axes(target, features, components)
    k = min(ps.shape[1], pt.shape[1])
    ps, pt = ps[:, :k], pt[:, :k]
    return (ms, ps @ (ps.T @ pt), mt[:k]), (mt, pt, mt[:k])


def subspace_alignment(source: DataFrame, target: DataFrame, features: str, components: int = 50) -> tuple[DataFrame, DataFrame]:
    """(source, target) in k dimensions: the source's principal axes turned to the target's, k the lesser rank at most."""
    a, b = aligned(source, target, features, components)
    return affine(source, features, *a), affine(target, features, *b)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def transfer_components(source: np.ndarray, target: np.ndarray, k: int, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, sd, projection) of transfer component analysis with a linear kernel on a bounded sample of both sides; the projection X'W serves all rows.

    With fewer features than rows the same problem is solved in the features: the kernel's range is that of X, so with
    G = X'X the projection is G^1/2 q of G^1/2 X'HX G^1/2 q = l (G^1/2 X'LX G^1/2 + mu) q.
    """
    mean, sd, z = _jointly(source, target)
    if z.shape[1] >= len(z):
        return mean, sd, z.T @ _components(z @ z.T, len(source), k, mu)
    values, vectors = np.linalg.eigh(z.T @ z)
    half = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    gap = half @ (z[: len(source)].mean(axis=0) - z[len(source) :].mean(axis=0))
    spread = half @ (z - z.mean(axis=0)).T
    return mean, sd, half @ _leading(np.outer(gap, gap) + mu * np.eye(len(half)), spread @ spread.T, k)


def transfer_by_sums(source: tuple, target: tuple, k: int, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, W) of transfer_components() on all rows of both sides, from n, mean and covariance (divided by n - 1) of each: x goes
    to (x - mean) W. Of the rows it needs no more than Z'Z and the gap of the means."""
    (ns, ms, cs), (nt, mt, ct) = source, target
    n, between = ns + nt, ms - mt
    total = cs * (ns - 1) + ct * (nt - 1) + np.outer(between, between) * (ns * nt / n)  # about the joint mean
    sd = np.sqrt(np.maximum(np.diag(total), 0) / n)
    sd[sd < 1e-8] = 1
    g, gap = total / np.outer(sd, sd), between / sd
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    half = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    gap = half @ gap
    return (ns * ms + nt * mt) / n, half @ _leading(np.outer(gap, gap) + mu * np.eye(len(half)), half @ g @ half, k) / sd[:, None]


def transfer_axes(source: DataFrame, target: DataFrame, features: str, k: int, mu: float, seed: int = 42, dense: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """transfer_components() on all rows of both sides: no kernel is formed and no row leaves its task.

    With G = Z'Z and the gap g of the sides' means the projection is P = G c of G G c = l (mu I + g g'G) c. Up to `dense` features G is
    summed in one pass and solved. Beyond that G is never formed: the problem is symmetric in the inner product of
    mu G + G g g'G, and block Lanczos finds c with two passes over the rows a round.
    """
    from kinetra.operators import tall

    both = source.select(features).unionByName(target.select(features))
    _, mean, sd = tall.moments(both, features)
    sd = np.where(sd < 1e-8, 1, sd)
    gap = (tall.moments(source, features)[1] - tall.moments(target, features)[1]) / sd
    total = lambda c: tall.products(both, features, c, mean, sd)
    if len(mean) <= dense:
        g = total(np.eye(len(mean)))
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        half = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
        return mean, sd, half @ _leading(np.outer(half @ gap, half @ gap) + mu * np.eye(len(half)), half @ g @ half, k)
    gg = total(gap[:, None])[:, 0]

    def apply(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gc = total(c)
        cgc = total(gc)
        inverse = (cgc - np.outer(gap, (gg @ cgc) / (mu + gap @ gg))) / mu  # (mu I + g (G g)')^-1 by the rank of one
        return inverse, mu * gc + np.outer(gg, gap @ gc)

    start = np.random.default_rng(seed).normal(size=(len(mean), min(k + 8, len(mean))))
    _, c = tall.leading(apply, start, k)
    return mean, sd, signed(total(c[:, ::-1]))


def _jointly(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and standardised rows of both sides together."""
    x = np.concatenate((source, target))
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-8] = 1
    return mean, sd, (x - mean) / sd


def _components(kernel: np.ndarray, n_source: int, k: int, mu: float) -> np.ndarray:
    """The leading vectors of B w = l A w, reduced by the Cholesky factor of A."""
    n, n_target = len(kernel), len(kernel) - n_source
    e = np.concatenate((np.full(n_source, 1 / n_source), np.full(n_target, -1 / n_target)))
    a = kernel @ np.outer(e, e) @ kernel + mu * np.eye(n)
    centred = kernel - kernel.mean(axis=0)
    b = centred.T @ centred
    return _leading(a, b, k)


def _leading(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k vectors of B w = l A w with the greatest l, in ascending order of l, by the Cholesky factor of A."""
    r = _cholesky((a + a.T) / 2)
    half = np.linalg.solve(r, (b + b.T) / 2)
    values, vectors = np.linalg.eigh((lambda m: (m + m.T) / 2)(np.linalg.solve(r, half.T)))
    return signed(np.linalg.solve(r.T, vectors[:, np.sort(np.argsort(-values, kind="stable")[:k])]))


def gaussian_components(source: np.ndarray, target: np.ndarray, k: int, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """(mean, sd, sample, gamma, weights) with a Gaussian kernel, as wide as the median distance of sampled rows."""
    mean, sd, z = _jointly(source, target)
    d2 = squared_distances(z, z)
    np.fill_diagonal(d2, 0)
    some = d2[d2 > 1e-9]
    gamma = float(1 / (2 * np.median(np.sqrt(some)) ** 2 + 1e-12)) if len(some) else 1.0
    return mean, sd, z, gamma, _components(np.exp(-gamma * d2), len(source), k, mu)


def kernel_axes(spark: SparkSession, source: np.ndarray, target: np.ndarray, k: int, mu: float, seed: int = 42, tile: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """gaussian_components() without the kernel of all pairs: tasks form `tile` of its rows anew for each pass.

    The median distance is found by counting the distances' leading bits, 16 at a time. With g = K e of the sides' signs e the
    problem K H K w = l (mu I + g g') w is symmetric in the inner product of mu I + g g', and block Lanczos solves it with two
    passes a round. The driver holds rows times a few columns.
    """
    from kinetra.operators import tall

    mean, sd, z = _jointly(source, target)
    n = len(z)
    tiles, rows = spark.range(0, n, tile, -(-n // tile)), spark.sparkContext.broadcast(z)

    def distances(z: np.ndarray, i: int) -> np.ndarray:
        d2 = squared_distances(z[i : i + tile], z)
        d2[np.arange(len(d2)), np.arange(i, i + len(d2))] = 0
        return d2

    def counted(level: int, above: int) -> np.ndarray:
        """Of the distances whose bits above the level's are these: how many have each value of its 16 bits."""
        low = 48 - 16 * level

        def part(batch: pa.RecordBatch, z: np.ndarray) -> np.ndarray:
            total = np.zeros(1 << 16, np.int64)
            for i in batch.column(0).to_pylist():
                bits = (d2 := distances(z, i))[d2 > 1e-9].view(np.int64) >> low  # doubles above zero are in the order of their bits
                total += np.bincount(bits[bits >> 16 == above] & 0xFFFF, minlength=1 << 16)
            return total.reshape(256, 256).astype(float)

        return tall.summed(tiles, ["id"], part, rows).ravel()

    first = counted(0, 0)
    some = int(first.sum())

    def ranked(place: int) -> float:
        """The squared distance at that place, exactly."""
        above, counts = 0, first
        for level in range(4):
            counts = counts if level == 0 else counted(level, above)
            ends = np.cumsum(counts)
            at = int(np.searchsorted(ends, place, side="right"))
            place -= int(ends[at] - counts[at])
            above = above << 16 | at
        return float(np.int64(above).view(np.float64))

    middle = [np.sqrt(ranked(i)) for i in sorted({(some - 1) // 2, some // 2})] if some else []
    gamma = float(1 / (2 * np.mean(middle) ** 2 + 1e-12)) if some else 1.0

    def product(block: np.ndarray) -> np.ndarray:
        """The kernel times a few columns."""
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    out = np.exp(-gamma * distances(rows.value, i)) @ held.value
                    yield pa.RecordBatch.from_arrays([pa.array([i]), lists(out.reshape(1, -1))], names=["id", "v"])

        got = tiles.mapInArrow(run, "id bigint, v array<double>").orderBy("id").toArrow().column("v")
        held.unpersist()
        return np.concatenate([np.asarray(c.flatten()) for c in got.chunks]).reshape(n, -1)

    g = product(np.concatenate((np.full(len(source), 1 / len(source)), np.full(len(target), -1 / len(target))))[:, None])[:, 0]

    def apply(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kc = product(c)
        b = product(kc - kc.mean(axis=0))
        return (b - np.outer(g, (g @ b) / (mu + g @ g))) / mu, mu * c + np.outer(g, g @ c)

    start = np.random.default_rng(seed).normal(size=(n, min(k + 8, n)))
    _, w = tall.leading(apply, start, k, rounds=40, tolerance=1e-13)
    return mean, sd, z, gamma, signed(w[:, ::-1])


def tca_gaussian(source: DataFrame, target: DataFrame, features: str, identity: str, components: int = 50, mu: float = 1.0, most: int = 6000, seed: int = 42, dense: int = 1024, tile: int = 256) -> tuple[DataFrame, DataFrame]:
    """(source, target) as their kernels with the sampled rows (a broadcast of at most `most` rows), times the weights.

    The kernel of all pairs of sampled rows is one matrix up to `dense` of them, and never formed beyond.
    """
    sample = [_array(df, features) for df in _both_sides(source, target, identity, most, seed)]
    k, n = min(components, sum(map(len, sample))), sum(map(len, sample))
    spark = source.sparkSession
    held = spark.sparkContext.broadcast(gaussian_components(*sample, k, mu) if n <= dense else kernel_axes(spark, *sample, k, mu))

    def mapped(df: DataFrame) -> DataFrame:
        at = df.columns.index(features)
        schema = ", ".join(f"`{c}` {'array<double>' if c == features else t}" for c, t in df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, sd, z, gamma, w = held.value
            for batch in batches:
                columns = list(batch.columns)
                if len(batch):
                    x = (matrix(batch.column(at)) - mean) / sd
                    columns[at] = lists(np.concatenate([np.exp(-gamma * squared_distances(x[i : i + tile], z)) @ w for i in range(0, len(x), tile)]))
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return df.mapInArrow(run, schema)

    return mapped(source), mapped(target)


def _array(df: DataFrame, features: str) -> np.ndarray:
    """A bounded sample's rows: a kernel of all pairs of them is part of the fitted map, and is broadcast."""
    return matrix(df.select(features).toArrow().column(0).combine_chunks())


def _both_sides(source: DataFrame, target: DataFrame, identity: str, most: int, seed: int) -> list[DataFrame]:
    """At most `most` rows, by hash from both sides in proportion; all where there are no more."""
    ns, nt = source.count(), target.count()
    if ns + nt <= most:
        return [source, target]
    caps = max(100, most * ns // (ns + nt)), max(50, most * nt // (ns + nt))
    return [df.orderBy(F.xxhash64(F.lit(seed), identity), identity).limit(n) for df, n in zip((source, target), caps, strict=True)]


def tca(source: DataFrame, target: DataFrame, features: str, identity: str, components: int = 50, mu: float = 1.0, most: int | None = 6000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(source, target) projected. Fitted on at most `most` rows, drawn by hash from both sides in proportion, or (None) on all rows."""
    given = transfer_affine(*(_both_sides(source, target, identity, most, seed) if most else (source, target)), features, components, mu)
    return affine(source, features, *given), affine(target, features, *given)


def transfer_affine(source: DataFrame, target: DataFrame, features: str, components: int, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What affine() needs to project rows on the transfer components of both sides."""
    mean, sd, projection = transfer_axes(source, target, features, components, mu)
    return mean, projection / sd[:, None], np.zeros(projection.shape[1])


#: name -> function of (source, calibration, target, identity, study) -> (source, target)
METHODS = {
    "raw": lambda s, c, t, i, study: (s, t),
    "centering": lambda s, c, t, i, study: (affine(s, "features", *_centred(s)), affine(t, "features", *_centred(s))),
    "coral": lambda s, c, t, i, study: (coral(s, c, "features", study.coral_reg), t),
    "tca": lambda s, c, t, i, study: _on_target(tca, s, c, t, i, study),
    "sa": lambda s, c, t, i, study: _on_target(subspace_alignment, s, c, t, i, study),
}


def _centred(source: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = gram(source, "features")[1]
    return mean, np.eye(len(mean)), np.zeros(len(mean))


def _on_target(method, s: DataFrame, c: DataFrame, t: DataFrame, identity: str, study) -> tuple[DataFrame, DataFrame]:
    """Fit on source and calibration rows, apply to source and final rows."""
    if method is tca:
        given = transfer_affine(*_both_sides(s, c, identity, study.tca_rows, study.seed), "features", study.tca_components, study.tca_mu)
        return affine(s, "features", *given), affine(t, "features", *given)
    a, b = aligned(s, c, "features", study.sa_components)
    return affine(s, "features", *a), affine(t, "features", *b)


def adapt(method: str, source: DataFrame, calibration: DataFrame, target: DataFrame, identity: str, study) -> tuple[DataFrame, DataFrame]:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}: one of {', '.join(METHODS)}")
    return METHODS[method](source, calibration, target, identity, study)
