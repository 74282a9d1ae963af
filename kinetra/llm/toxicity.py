"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of word beginnings (insults are inflected) is trained on confirmed
toxic texts and on unlabelled ones: a bounded sample of all training-fold documents, whatever their label and mostly
without one. With the class prior p the risk is p * R+(toxic) + max(0, R-(unlabelled) - p * R-(toxic)); where the second
part turns negative, its gradient is taken back, which keeps the classifier from fitting the unlabelled texts. The prior
begins as the labels' base rate and becomes the mean probability of the unlabelled texts. The features are those that
toxic texts have more often than unlabelled ones by many standard errors, told by Spark from counts over both samples:
with fewer toxic texts than features, all others would only fit noise. A last step fits scale and offset of the logit
to labelled training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import crc_mod, durable, flag, labelled_sample, slices, texts

WORD = re.compile(r"\w+")


BEGINNINGS = (4, 5, 6)


def marks(text: str) -> set[str]:
    """The text's words, and the beginnings of longer ones, each with a dash."""
    found = set(WORD.findall(text.lower()))
    return found | {f"{w[:n]}-" for n in BEGINNINGS for w in found if len(w) > n}


def present(ids: dict[str, int], text: str) -> list[int]:
    """Which of the known words and beginnings a text has."""
    return sorted({ids[w] for w in marks(text) if w in ids})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R+(toxic), R-(unlabelled) - prior * R-(toxic), and the step's gradients by the logits p and u.

    Logistic loss. The risk is the first plus the second where that is not negative; else the step walks the second
    part back up.
    """
    plus = prior * np.logaddexp(0, -p).mean()
    rest = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    d_plus, d_rest_p, d_rest_u = -prior * _sigmoid(-p) / len(p), -prior * _sigmoid(p) / len(p), _sigmoid(u) / len(u)
    return (plus, rest, d_plus + d_rest_p, d_rest_u) if rest >= 0 else (plus, rest, -d_rest_p, -d_rest_u)


class Linear:
    """Sparse rows of word ids -> logit."""

    def __init__(self, size: int):
        self.w, self.b, self.scale, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    @staticmethod
    def sums(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        total = np.concatenate(([0.0], np.cumsum(w[np.concatenate([*rows, []]).astype(np.int64)])))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.sums(self.w, rows) + self.b

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows) + self.shift, -500, 500)))

    def fit(self, toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Linear:
        """Adam on the non-negative risk of the logistic loss."""
        size = len(self.w)
        flat_p, flat_u = (np.concatenate([*r, []]).astype(np.int64) for r in (toxic, unlabelled))
        own_p, own_u = (np.repeat(np.arange(len(r)), [len(x) for x in r]) for r in (toxic, unlabelled))
        moments = [np.zeros(size + 1), np.zeros(size + 1)]
        for step in range(1, steps + 1):
            p, u = (np.bincount(own, self.w[flat], len(r)) + self.b for own, flat, r in ((own_p, flat_p, toxic), (own_u, flat_u, unlabelled)))
            _, _, d_p, d_u = risk(p, u, prior)
            grad = np.append(np.bincount(flat_p, d_p[own_p], size) + np.bincount(flat_u, d_u[own_u], size) + decay * self.w, d_p.sum() + d_u.sum())
            moments[0] += 0.1 * (grad - moments[0])
            moments[1] += 0.001 * (grad * grad - moments[1])
            move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            self.w -= move[:-1]
            self.b -= move[-1]
        return self

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> Linear:
        """Scale and offset by Newton's method on the weighted logistic loss, with smoothed targets; the scale stays positive."""
        z = self.logits(rows)
        spread = max(float(np.std(z)), 1e-6)
        x = np.stack([z / spread, np.ones(len(z))], axis=1)
        n1, n0 = y.sum(), (1 - y).sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        weight = np.ones(len(z)) if weight is None else weight / weight.mean()
        a = np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            hess = x.T @ (x * (weight * (p * (1 - p) + 1e-9))[:, None]) + 1e-3 * np.eye(2)
            a = a - np.clip(np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-3 * np.array([a[0] - 1, 0])), -2, 2)
        if a[0] > 0:
            self.scale, self.shift = float(a[0] / spread), float(a[1])
        return self


def telling(marked: DataFrame, toxic: int, unlabelled: int, errors: float = 5.0, least: int = 4) -> list[str]:
    """Marks that toxic texts have more often than unlabelled ones by `errors` standard errors, `least` texts at least.

    marked: mark, p, u (toxic and unlabelled texts that have it).
    """
    p, u = F.col("p") / toxic, (F.col("u") + 0.5) / (unlabelled + 1)
    z = (p - u) / F.sqrt(u * (1 - u) * (1 / toxic + 1 / unlabelled))
    return sorted(r[0] for r in marked.where((F.col("p") >= least) & (F.col("u") <= unlabelled) & (z >= errors)).select("mark").collect())


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, unlabelled: int = 20_000, rounds: int = 2) -> tuple[list[str], Linear] | None:
    """Words and classifier from about `most` labelled rows a class and about `unlabelled` documents, all of the training fold."""
    fold = ~crc_mod("doc_id", 5).eqNullSafe(0)
    known = {r[0]: r[1] for r in labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & fold).groupBy("toxic").count().collect()}
    if len(known) < 2:
        return None
    prior = known[1] / (known[0] + known[1])
    own = docs.where(fold).select("doc_id", F.col("text").cast("string").alias("text"))
    share = min(1_000_000, int(1e6 * unlabelled / max(own.count(), 1)) + 1)
    free = own.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("unlabelled")), F.lit(1_000_000)) < share)  # labels are not looked at
    sample = durable(labelled_sample(docs, labels, "toxic", fold, most).unionByName(free.withColumns({"y": F.lit(-1), "weight": F.lit(1.0)})))
    sizes = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if not all(sizes.get(y) for y in (-1, 0, 1)):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            p, u = Counter(), Counter()
            for y, x in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                (p if y == 1 else u).update(marks(x.decode("utf-8", "ignore")))
            every = list(p.keys() | u.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([p[w] for w in every], pa.int64()), pa.array([u[w] for w in every], pa.int64())], names=["mark", "p", "u"])

    marked = sample.where("y <> 0").select("y", "text").mapInArrow(count, "mark string, p bigint, u bigint").groupBy("mark").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    words = telling(marked, sizes[1], sizes[-1])
    held = docs.sparkSession.sparkContext.broadcast(words)  # each in `least` toxic texts of the sample at least

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(held.value)}
        for batch in slices(batches, 4 << 20):
            x = [present(ids, t.decode("utf-8", "ignore")) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "y", "x", "weight"])

    rows = [(r[0], r[1], np.array(r[2], np.int64), r[3]) for r in sample.select("doc_id", "y", "weight", "text").mapInArrow(features, "doc_id bigint, y int, x array<int>, weight double").toLocalIterator()]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1], r[2].tobytes()))
    toxic, other, free_rows = ([r[2] for r in rows if r[1] == y] for y in (1, 0, -1))
    weight = np.array([r[3] for y in (1, 0) for r in rows if r[1] == y])
    target = np.repeat([1.0, 0.0], [len(toxic), len(other)])
    for _ in range(rounds):
        model = Linear(len(words)).fit(toxic, free_rows, prior).calibrate(toxic + other, target, weight=weight)
        prior = float(np.clip(model.probability(free_rows).mean(), 1e-4, 0.5))
    return words, model


def detect(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs: how likely labels.toxic is 1.

    Whole texts are scored; null and empty texts as a text without words; a null doc_id is kept and not held out;
    repeated rows are scored each. Without training rows of both classes every score is 0. Labels, lang, source and
    doc_id are no inputs of a score. Labels that contradict each other for an id count as toxic. An empty table gives no
    rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        ids = {w: i for i, w in enumerate(model[0]) if model[1].w[i]} if model else {}  # words without weight add nothing
        for batch in slices(batches, 4 << 20):
            score = np.zeros(batch.num_rows)
            if model:
                score = model[1].probability([np.array(present(ids, t.decode("utf-8", "ignore")), np.int64) for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), flag("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
