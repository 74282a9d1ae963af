"""Ridge classifier: one-vs-rest targets of +-1, one strength for all classes by leave-one-out error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators import tall
from kinetra.operators.adapt import gram, lists, matrix

ALPHAS = np.logspace(-3, 6, 15)
FINE_ALPHAS = np.logspace(-3, 6, 25)


@dataclass
class Ridge:
    classes: np.ndarray
    coef: np.ndarray  # features x classes
    intercept: np.ndarray
    alpha: float

    def decide(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.intercept

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class of the highest score; ties go to the first."""
        return self.classes[np.argmax(self.decide(x), axis=1)]


def fit(x: np.ndarray, y: np.ndarray, alphas: np.ndarray = ALPHAS, by_accuracy: bool = False) -> Ridge:
    """On a bounded sample (rows x features in memory). The leverage counts the intercept: h_i + 1/n.

    The strength has the least squared leave-one-out error, or the best leave-one-out accuracy (the first of equals).
    """
    classes = np.unique(y)
    target = np.where(y[:, None] == classes, 1.0, -1.0)
    mx, my = x.mean(axis=0), target.mean(axis=0)
    xc, yc, n = x - mx, target - my, len(x)
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    uy = u.T @ yc
    errors = []
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        residual = yc - u @ (shrink[:, None] * uy)
        leverage = (u**2) @ shrink + 1 / n
        left_out = residual / np.maximum(1 - leverage, 1e-12)[:, None]
        errors.append(-(np.argmax(target - left_out, axis=1) == np.argmax(target, axis=1)).mean() if by_accuracy else (left_out**2).mean())
    best = float(alphas[int(np.argmin(errors))])
    coef = vt.T @ ((s / (s**2 + best))[:, None] * uy)
    return Ridge(classes, coef, my - mx @ coef, best)


class Factored:
    """fit() on many linear maps of the same bounded rows: their QR factors are taken once; a map then costs a small SVD and a
    pass over the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes, self.mean = np.unique(y), x.mean(axis=0)
        target = np.where(y[:, None] == self.classes, 1.0, -1.0)
        self.ymean = target.mean(axis=0)
        self.yc = target - self.ymean
        self.q, self.r = np.linalg.qr(x - self.mean)
        self.qy = self.q.T @ self.yc

    def fit(self, weights: np.ndarray, alphas: np.ndarray = ALPHAS) -> Ridge:
        """On (x - mean) W: the strength has the least squared leave-one-out error."""
        u, s, vt = np.linalg.svd(self.r @ weights, full_matrices=False)
        uy, u, n = u.T @ self.qy, self.q @ u, len(self.yc)
        shrink = s**2 / (s**2 + alphas[:, None])
        fitted = u @ (shrink.T[:, :, None] * uy[:, None, :]).reshape(len(s), -1)
        residual = self.yc[:, None, :] - fitted.reshape(n, len(alphas), -1)
        left_out = np.einsum("nac,nac->na", residual, residual) / np.maximum(1 - (u**2 @ shrink.T + 1 / n), 1e-12) ** 2
        best = float(alphas[int(np.argmin(left_out.mean(axis=0)))])
        return Ridge(self.classes, vt.T @ ((s / (s**2 + best))[:, None] * uy), self.ymean, best)


def fit_all(df: DataFrame, features: str = "features", label: str = "y", alphas: np.ndarray = ALPHAS) -> Ridge:
    """On all rows, whatever their number: X'X and X'Y are summed on Spark, the strength has the least generalised
    cross-validation error, which needs no more than these. The driver solves features x features once."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # one row a class
    sides = F.array(*[F.when(F.col(label) == c, 1.0).otherwise(-1.0) for c in classes])
    n, mean, cov = gram(df.select(F.concat(F.transform(features, lambda v: v.cast("double")), sides).alias("_xy")), "_xy")
    k = len(mean) - len(classes)
    best, coef = by_sums(cov[:k, :k] * (n - 1), cov[:k, k:] * (n - 1), np.trace(cov[k:, k:]) * (n - 1), n, alphas)
    return Ridge(np.array(classes), coef, mean[k:] - mean[:k] @ coef, best)


def by_sums(xx: np.ndarray, xy: np.ndarray, total: float, n: float, alphas: np.ndarray = ALPHAS) -> tuple[float, np.ndarray]:
    """(strength, coefficients) from X'X, X'Y and the trace of Y'Y, all about the means: least generalised cross-validation error."""
    values, vectors = np.linalg.eigh((xx + xx.T) / 2)
    values, uy = np.maximum(values, 0), vectors.T @ xy

    def error(a: float) -> float:
        left = total - 2 * (uy**2 / (values + a)[:, None]).sum() + (values[:, None] * uy**2 / (values + a)[:, None] ** 2).sum()
        return left / n / (1 - ((values / (values + a)).sum() + 1) / n) ** 2

    best = float(min(alphas, key=error))
    return best, vectors @ (uy / (values + best)[:, None])


def left_out(x: np.ndarray, y: np.ndarray, values: np.ndarray, uy: np.ndarray, n: float, alphas: np.ndarray = ALPHAS, step: int = 512) -> np.ndarray:
    """(rows x alphas) squared leave-one-out errors, summed over classes, of rows x about the mean of all n rows, turned to axes in which
    X'X has these values on its diagonal; y: sides about their means, uy: X'Y. Some rows of n are enough: the rest is in values and uy."""
    inverse = 1 / (values[:, None] + alphas)
    out = np.empty((len(x), len(alphas)))
    for lo in range(0, len(x), step):
        some, sides, error = x[lo : lo + step], y[lo : lo + step], 0
        for k in range(sides.shape[1]):
            residual = sides[:, k, None] - some @ (inverse * uy[:, k, None])
            error = error + residual * residual
        out[lo : lo + step] = error / np.maximum(1 - ((some * some) @ inverse + 1 / n), 1e-12) ** 2
    return out


def fit_rows(df: DataFrame, features: str = "features", label: str = "y", alphas: np.ndarray = ALPHAS, by_accuracy: bool = False) -> Ridge:
    """fit() on all rows of a table, with the same exact leave-one-out error, and no row on the driver.

    The rows' triangle comes from a tree of QR factors; the driver takes the singular vectors of features x features. A
    second pass gives each row its leverages and leaves it out, for all strengths at once; only sums come back.
    """
    classes = np.array([r[0] for r in df.select(label).distinct().orderBy(label).collect()])  # one row a class
    context = df.sparkSession.sparkContext
    given = context.broadcast(classes)
    sides = lambda batch, known: np.where(batch.column(1).to_numpy(zero_copy_only=False)[:, None] == known, 1.0, -1.0)

    def totals(batch: pa.RecordBatch, known) -> np.ndarray:
        x = np.concatenate((np.ones((batch.num_rows, 1)), matrix(batch.column(0)), sides(batch, known)), axis=1)
        return x.sum(axis=0)[None]

    rows = df.select(features, label)
    first = tall.summed(rows, [features, label], totals, given)[0]
    n, k = first[0], len(first) - 1 - len(classes)
    mx, my = first[1 : k + 1] / n, first[k + 1 :] / n
    middle = context.broadcast((classes, mx, my))
    r = tall.triangle(_centred(rows, features, middle), features)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    real = s > s.max() * max(n, k) * np.finfo(float).eps if len(s) and s.max() > 0 else s > 0
    s, vt = s[real], vt[real]

    def crossed(batch: pa.RecordBatch, m) -> np.ndarray:
        return (matrix(batch.column(0)) - m[1]).T @ (sides(batch, m[0]) - m[2])

    xy = tall.summed(rows, [features, label], crossed, middle)
    uy = (vt @ xy) / s[:, None]
    held = context.broadcast((classes, mx, my, vt.T / s, s, uy, alphas, n))

    def left_out(batch: pa.RecordBatch, m) -> np.ndarray:
        known, mx, my, right, s, uy, alphas, n = m
        target = sides(batch, known)
        u = (matrix(batch.column(0)) - mx) @ right
        errors = []
        for a in alphas:
            shrink = s**2 / (s**2 + a)
            residual = (target - my) - u @ (shrink[:, None] * uy)
            one = residual / np.maximum(1 - ((u**2) @ shrink + 1 / n), 1e-12)[:, None]
            errors.append(-(np.argmax(target - one, axis=1) == np.argmax(target, axis=1)).sum() if by_accuracy else (one**2).sum())
        return np.array(errors)[None]

    best = float(alphas[int(np.argmin(tall.summed(rows, [features, label], left_out, held)[0]))])
    coef = vt.T @ ((s / (s**2 + best))[:, None] * uy)
    return Ridge(classes, coef, my - mx @ coef, best)


def _centred(rows: DataFrame, features: str, middle) -> DataFrame:
    """The rows' features less their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([lists(matrix(batch.column(0)) - middle.value[1])], names=[features])

    return rows.select(features).mapInArrow(run, f"`{features}` array<double>")


def predict(df: DataFrame, model: Ridge, features: str = "features", keep: tuple[str, ...] = ("y",)) -> DataFrame:
    """keep columns and p: rows are scored in Arrow batches with a broadcast of features times classes."""
    held = df.sparkSession.sparkContext.broadcast(model)
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            p = held.value.predict(x) if len(x) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p.astype(np.int32))], names=[*keep, "p"])

    return df.select(features, *keep).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "p int"]))


def score(df: DataFrame, model: Ridge, features: str, prediction: str, raw: str) -> DataFrame:
    """df with the class of the highest score (double) and the scores of all classes; columns of these names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in (prediction, raw)]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = held.value.decide(matrix(batch.column(0)))
                best = held.value.classes[np.argmax(scores, axis=1)].astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists(scores), pa.array(best)], names=[*keep, raw, prediction])

    return df.select(F.col(features).alias("_given"), *keep).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{raw}` array<double>", f"`{prediction}` double"]))
