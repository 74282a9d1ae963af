"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Tokens are words (case kept) and runs of symbols; those outside the vocabulary go by their shape. A token's index
vector is sparse, ternary and a function of its hash. Its word vector adds the normalised sum of its neighbours' index
vectors over the sample, which Spark sums by token. A document is the mean of its tokens' vectors, and four numbers:
how long that mean is, how alike tokens next to each other and next but one are, and the count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import crc_mod, durable, flag, labelled_sample, slices, texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
SHAPES = ("<lower>", "<title>", "<upper>", "<mixed>", "<number>", "<symbols>")
DIM, NONZERO, NEAR = 64, 6, 2
WIDTH = DIM + 4


def shape(token: str) -> int:
    """Which of SHAPES a token has."""
    if not (token[0].isalnum() or token[0] == "_"):
        return 5
    if token.isalpha():
        return 0 if token.islower() else 2 if token.isupper() and len(token) > 1 else 1 if token.istitle() else 3
    return 4 if token.isdigit() else 3


def index_vectors(tokens: list[str]) -> np.ndarray:
    out = np.zeros((len(tokens), DIM), np.float32)
    for i, t in enumerate(tokens):
        h = xxhash.xxh3_128_intdigest(t.encode())
        for _ in range(NONZERO):
            h, k = divmod(h, 2 * DIM)
            out[i, k >> 1] += 1 if k & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


class Vocabulary:
    def __init__(self, tokens: list[str]):
        self.tokens = [*SHAPES, *tokens]
        self.ids = {t: i for i, t in enumerate(self.tokens)}

    def encode(self, text: str) -> np.ndarray:
        get = self.ids.get
        found = TOKEN.findall(text)
        ids = [get(t) for t in found]
        if None in ids:
            ids = [shape(t) if i is None else i for i, t in zip(ids, found, strict=True)]
        return np.array(ids, np.int64)


def pooled(vocabulary: Vocabulary, vectors: np.ndarray, batch: list[str]) -> np.ndarray:
    """A row for each text: the mean of its tokens' vectors (zeros if none), its length, likeness of neighbours, the log count."""
    out = np.zeros((len(batch), WIDTH), np.float32)
    for i, t in enumerate(batch):
        ids = vocabulary.encode(t)
        if len(ids):
            total, alike = np.zeros(DIM), np.zeros(2)
            for s in range(0, len(ids), 1 << 14):  # bounds memory for long texts
                own = vectors[ids[s : s + (1 << 14) + 2]]
                n = min(len(own), 1 << 14)
                total += own[:n].sum(axis=0)
                for gap in (1, 2):
                    alike[gap - 1] += np.einsum("ij,ij->", own[: len(own) - gap][:n], own[gap:][:n])
            mean = total / len(ids)
            out[i] = [*mean, float(mean @ mean) ** 0.5, *(alike / len(ids)), np.log1p(len(ids)) / 10]
    return out


class Network:
    """Two layers: tanh units, then a logit, divided by a temperature."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7, weight: np.ndarray | None = None) -> Network:
        """Adam on the weighted logistic loss over four fifths of the rows; the temperature then fits the rest."""
        weight = np.ones(len(x)) if weight is None else weight / weight.mean()
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
        params = [self.w1, self.b1, self.w2, self.b2]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
                z = (x[part] - self.mean) / self.scale
                h = np.tanh(z @ self.w1 + self.b1)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -500, 500))) - y[part]) * weight[part] / len(part)
                back = np.outer(d, self.w2) * (1 - h * h)
                grads = [z.T @ back + decay * self.w1, back.sum(axis=0), h.T @ d + decay * self.w2, np.array([d.sum()])]
                step += 1
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(held):
            logits, sign = self.logits(x[held]), 2 * y[held] - 1
            grid = np.geomspace(0.25, 8, 61)
            self.temperature = float(min(grid, key=lambda t: (weight[held] * np.logaddexp(0, -sign * logits / t)).mean()))
        return self


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, size: int = 20_000) -> tuple[list[str], np.ndarray, Network] | None:
    """Vocabulary, vectors and network from at most about `most` labelled training rows of each class, weighted to the labels' base rate; None without both classes."""
    spark = docs.sparkSession
    sample = durable(labelled_sample(docs, labels, "quality", ~crc_mod("doc_id", 3).eqNullSafe(1), most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            seen = Counter(t for x in texts(batch) for t in TOKEN.findall(x.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["token", "n"])

    counted = sample.select("text").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where("n > 4")
    tokens = [r[0] for r in counted.orderBy(F.desc("n"), "token").limit(size).collect()]
    held = spark.sparkContext.broadcast(tokens)  # at most `size` tokens

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(held.value)
        index, sums = index_vectors(vocabulary.tokens), np.zeros((len(vocabulary.tokens), DIM), np.float32)
        for batch in slices(batches, 1 << 20):
            for x in texts(batch):
                ids = vocabulary.encode(x.decode("utf-8", "ignore"))
                for gap in range(1, NEAR + 1):
                    for own, other in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
                        for s in range(0, len(own), 1 << 14):
                            np.add.at(sums, own[s : s + (1 << 14)], index[other[s : s + (1 << 14)]])
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums[used]), pa.list_(pa.float32()))], names=["i", "v"])

    added = sample.select("text").mapInArrow(neighbours, "i bigint, v array<float>").select("i", F.posexplode("v").alias("d", "x")).groupBy("i", "d").agg(F.sum("x").alias("x"))
    vocabulary = Vocabulary(tokens)
    context = np.zeros((len(vocabulary.tokens), DIM))
    for i, v in added.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).select("i", "v.x").collect():
        context[i] = v
    vectors = (index_vectors(vocabulary.tokens) + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    shared = spark.sparkContext.broadcast((tokens, vectors))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value[0])
        for batch in slices(batches, 4 << 20):
            x = pooled(vocabulary, shared.value[1], [t.decode("utf-8", "ignore") for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32())), batch.column(2)], names=["doc_id", "y", "x", "weight"])

    rows = sorted(tuple(r) for r in sample.select("doc_id", "y", "weight", "text").mapInArrow(features, "doc_id bigint, y int, x array<float>, weight double").collect())
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return None
    return tokens, vectors, Network(WIDTH).fit(np.array([r[2] for r in rows]), y, weight=np.array([r[3] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs: how likely labels.quality is 1.

    Whole texts are scored; null and empty texts as a text without tokens; a null doc_id is kept and not held out;
    repeated rows are scored each. Without training rows of both classes every score is 0.5. Labels, lang, source and
    doc_id are no inputs of a score. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        vocabulary = Vocabulary(model[0]) if model else None
        for batch in slices(batches, 4 << 20):
            score = np.full(batch.num_rows, 0.5)
            if model:
                score = model[2].probability(pooled(vocabulary, model[1], [t.decode("utf-8", "ignore") for t in texts(batch)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), flag("doc_id", 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
