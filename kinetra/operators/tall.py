"""Linear algebra of tall tables: rows stay in tasks, what comes back is features by a few columns.

Every pass sums small blocks of numbers a task, adds them up on Spark by tiles, and never brings a row to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.durable import staged
from kinetra.operators.adapt import lists, matrix

TILE = 256
SUMS = "tile int, v array<double>"


def summed(df: DataFrame, columns: list[str], part: Callable[[pa.RecordBatch], np.ndarray], held=None) -> np.ndarray | None:
    """The sum over all batches of part(batch), a matrix whose shape all batches share; None where there are no rows.

    A task adds up its batches and emits the sum by tiles of rows; Spark adds up the tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = part(batch) if held is None else part(batch, held.value)
                total = x if total is None else total + x
        if total is not None:
            starts = range(0, len(total), TILE)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[i : i + TILE].ravel() for i in starts], pa.list_(pa.float64())), pa.array([total.shape[1]] * len(starts), pa.int32())], names=["tile", "v", "w"])

    def add(key: tuple, got: pa.Table) -> pa.Table:
        v = got.column("v").combine_chunks()
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "v": lists(np.asarray(v.flatten()).reshape(len(v), -1).sum(axis=0)[None]), "w": got.column("w").slice(0, 1)})

    sums = df.select(*columns).mapInArrow(run, f"{SUMS}, w int").groupBy("tile").applyInArrow(add, f"{SUMS}, w int").orderBy("tile").collect()
    return np.concatenate([np.array(r.v).reshape(-1, r.w) for r in sums]) if sums else None


def triangle(df: DataFrame, features: str, fan_in: int = 8) -> np.ndarray | None:
    """R of the QR factors of the rows: each task factors its own, and triangles meet `fan_in` at a time until one is left.

    Singular values and right vectors of the rows are those of R, at full precision: no product X'X is formed.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, rows = None, [], 0

        def folded(parts):
            return np.linalg.qr(np.concatenate(parts), mode="r")

        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                held.append(x)
                rows += len(x)
                if rows >= 4 * x.shape[1]:
                    r, held, rows = folded([r, *held] if r is not None else held), [], 0
        if held:
            r = folded([r, *held] if r is not None else held)
        if r is not None:
            yield pa.RecordBatch.from_arrays([lists(r)], names=["row"])

    def met(key: tuple, got: pa.Table) -> pa.Table:
        r = np.linalg.qr(matrix(got.column("row").combine_chunks()), mode="r")
        return pa.table({"part": pa.array([key[0].as_py() // fan_in] * len(r), pa.int32()), "row": lists(r)})

    parts = df.select(F.transform(features, lambda v: v.cast("double")).alias("x")).mapInArrow(own, "row array<double>")
    parts = staged(parts.select((F.spark_partition_id() / fan_in).cast("int").alias("part"), "row"))
    while True:
        n = parts.agg(F.max("part")).first()[0]
        if n is None:
            return None
        parts = parts.groupBy("part").applyInArrow(met, "part int, row array<double>")
        if n == 0:
            return np.array([r.row for r in parts.collect()])  # features x features
        parts = staged(parts)


def products(df: DataFrame, features: str, block: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Z'Z B of the rows z = (x - mean) / sd, without forming Z'Z."""
    held = df.sparkSession.sparkContext.broadcast((block, mean, sd))

    def part(batch: pa.RecordBatch, given) -> np.ndarray:
        b, m, s = given
        z = (matrix(batch.column(0)) - m) / s
        return z.T @ (z @ b)

    return summed(df, [features], part, held)


def leading(apply: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, k: int, rounds: int = 12, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k greatest of S c = l M c by block Lanczos with whole reorthogonalisation.

    apply(C) -> (T C, M C), where T = M^-1 S is symmetric in the inner product of M. The space grows by T times its newest
    block; in it the problem is dense and small. Ends when the values settle to `tolerance`. Values come greatest first.
    """
    basis, images, weights = np.zeros((len(start), 0)), np.zeros((len(start), 0)), np.zeros((len(start), 0))
    block, told = start, None
    for _ in range(rounds):
        size = np.linalg.norm(block, 2) if block.size else 0
        for _ in range(2):  # twice is enough: what rounding leaves of the older blocks goes
            block = block - basis @ (weights.T @ block)
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block, size = u[:, s > 1e-10 * size], 1
        if not block.shape[1]:
            break  # the space holds all that T reaches
        image, weight = apply(block)
        inner = (lambda m: (m + m.T) / 2)(block.T @ weight)
        values, vectors = np.linalg.eigh(inner)
        some = values > values.max() * 1e-13 if values.max() > 0 else values < 0
        turn = vectors[:, some] / np.sqrt(values[some])
        block, image, weight = block @ turn, image @ turn, weight @ turn
        basis, images, weights = (np.concatenate(x, axis=1) for x in ((basis, block), (images, image), (weights, weight)))
        small = (lambda m: (m + m.T) / 2)(weights.T @ images)
        values, vectors = np.linalg.eigh(small)
        best = values[::-1][:k]
        if told is not None and len(told) == len(best) and np.all(np.abs(best - told) <= tolerance * max(abs(best[0]), 1e-300)):
            break
        told, block = best, image
    return values[::-1][:k], basis @ vectors[:, ::-1][:, :k]


def principal(df: DataFrame, features: str, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, variances, axes) of the k leading principal axes of the rows; each round is one pass over them."""
    n, mean, sd = moments(df, features)
    rng, one = np.random.default_rng(seed), np.ones(len(mean))
    start = rng.normal(size=(len(mean), min(k + 8, len(mean))))
    values, axes = leading(lambda c: (products(df, features, c, mean, one) / max(n - 1, 1), c), start, k)
    return mean, values, axes


def moments(df: DataFrame, features: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sd) of the rows, sd divided by n; two passes, the second about the mean."""
    first = summed(df, [features], lambda b: np.concatenate(([[len(b)] * (x := matrix(b.column(0))).shape[1]], x.sum(axis=0)[None])))
    n = int(first[0, 0])
    mean = first[1] / n
    held = df.sparkSession.sparkContext.broadcast(mean)
    square = summed(df, [features], lambda b, m: ((matrix(b.column(0)) - m) ** 2).sum(axis=0)[None], held)[0]
    return n, mean, np.sqrt(square / n)
