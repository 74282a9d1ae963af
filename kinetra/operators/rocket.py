"""Convolutional-kernel features of windows: share of positive values of dilated convolutions.

Windows are rows with a channel-major array (channels x samples flattened). A bank of kernels is small and broadcast; rows
are transformed in Arrow batches. Fitting reads a bounded sample of windows, drawn by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAPS = 9


@dataclass
class Bank:
    """Kernels: weights (k x 9), dilation, padding, channels (a list each) and bias."""

    channels: int
    weights: np.ndarray
    dilation: np.ndarray
    padded: np.ndarray
    uses: list[np.ndarray]
    bias: np.ndarray

    def groups(self) -> dict[tuple, np.ndarray]:
        """Kernels that share a convolution: same weights, dilation, padding and channels."""
        out: dict[tuple, list[int]] = {}
        for k in range(len(self.bias)):
            out.setdefault((tuple(self.weights[k]), int(self.dilation[k]), bool(self.padded[k]), tuple(self.uses[k])), []).append(k)
        return {key: np.array(ks) for key, ks in out.items()}


def convolve(x: np.ndarray, weights: tuple, dilation: int, padded: bool, uses: tuple) -> np.ndarray:
    """Dilated convolution of windows (n x channels x samples), summed over the channels used."""
    signal = x[:, list(uses)].sum(axis=1)
    reach = (TAPS - 1) * dilation
    if padded:
        signal = np.pad(signal, ((0, 0), (reach // 2, reach // 2)))
    n = signal.shape[1] - reach
    if n <= 0:
        return np.empty((len(x), 0))
    return sum(w * signal[:, j * dilation : j * dilation + n] for j, w in enumerate(weights))


def features(bank: Bank, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(bank.bias)), np.float32)
    for key, ks in bank.groups().items():
        conv = convolve(x, *key)
        if conv.shape[1]:
            for k in ks:
                out[:, k] = (conv + bank.bias[k] > 0).mean(axis=1)
    return np.nan_to_num(out, nan=0.0, posinf=1.0, neginf=0.0)


def custom_dilations(samples: int) -> list[int]:
    return [2**i for i in range(max(int(np.floor(np.log2((samples - 1) / (TAPS - 1)))), 1))]


def custom_bank(kernels: int, channels: int, samples: int, seed: int = 42) -> Bank:
    """Eight weight patterns of +-1 that differ in the first three taps, dilations 2**i, one channel a kernel."""
    patterns = np.array([[1 if p >> (2 - j) & 1 else -1 for j in range(3)] + [-1] * (TAPS - 3) for p in range(8)], float)
    dilations = custom_dilations(samples)
    each = [kernels // len(dilations) + (kernels % len(dilations) if i == 0 else 0) for i in range(len(dilations))]
    rng = np.random.default_rng(seed)
    return Bank(channels, patterns[np.arange(kernels) % 8], np.repeat(dilations, each), np.zeros(kernels, bool), [np.array([c]) for c in rng.integers(0, channels, kernels)], np.zeros(kernels))


def with_median_bias(bank: Bank, sample: np.ndarray) -> Bank:
    """Biases: minus the median of each kernel's values over the sample."""
    for key, ks in bank.groups().items():
        conv = convolve(sample, *key)
        if conv.size:
            bank.bias[ks] = -np.quantile(conv, 0.5)
    return bank


def canonical_bank(target: int, channels: int, sample: np.ndarray, seed: int = 42, most_dilations: int = 32) -> Bank:
    """84 kernels of 3 twos among 9 taps (others -1), log-spaced dilations, alternate padding, quantile biases.

    From the published description: target // 84 features a kernel, spread over the dilations; each bias is a
    low-discrepancy quantile of one sampled window's convolution; each (kernel, dilation) sums a random set of channels.
    """
    samples, rng = sample.shape[2], np.random.default_rng(seed)
    patterns = [tuple(2.0 if j in twos else -1.0 for j in range(TAPS)) for twos in combinations(range(TAPS), 3)]
    per = max(1, target // len(patterns))
    top = np.log2((samples - 1) / (TAPS - 1))
    raw = np.logspace(0, max(top, 0), min(per, most_dilations), base=2).astype(int)
    dilations, counts = np.unique(raw, return_counts=True)
    share = np.floor(counts * per / counts.sum()).astype(int)
    share[: per - share.sum()] += 1
    quantiles = iter(np.mod((np.arange(1, len(patterns) * per + 1) * (np.sqrt(5) + 1) / 2), 1))
    rows: list[tuple] = []
    for d, (dilation, n) in enumerate(zip(dilations, share, strict=True)):
        for k, pattern in enumerate(patterns):
            size = int(2 ** rng.uniform(0, np.log2(min(channels, TAPS) + 1)))
            uses = np.sort(rng.choice(channels, max(1, min(size, channels)), replace=False))
            padded = (d + k) % 2 == 0
            conv = convolve(sample[[int(rng.integers(len(sample)))]], pattern, int(dilation), padded, tuple(uses))
            for _ in range(n):
                rows.append((pattern, int(dilation), padded, uses, -float(np.quantile(conv, next(quantiles))) if conv.size else 0.0))
    return Bank(channels, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows], np.array([r[4] for r in rows]))


def sample_windows(windows: DataFrame, column: str, identity: str, channels: int, most: int, seed: int) -> np.ndarray:
    """At most `most` windows by hash of their identity, as an array."""
    rows = windows.orderBy(F.xxhash64(F.lit(seed), identity), identity).limit(most).select(column).toPandas()[column]
    return np.array(rows.tolist(), float).reshape(len(rows), channels, -1)


EXTRACTORS = {
    "custom_ppv": lambda sample, kernels, seed: with_median_bias(custom_bank(kernels, sample.shape[1], sample.shape[2], seed), sample),
    "canonical": lambda sample, kernels, seed: canonical_bank(kernels, sample.shape[1], sample, seed),
}


class Extractor:
    """fit on windows, transform windows: a registry name, the number of kernels, a seed."""

    def __init__(self, name: str = "canonical", kernels: int = 10_000, seed: int = 42, most: int = 500):
        if name not in EXTRACTORS:
            raise ValueError(f"unknown extractor {name}: one of {', '.join(EXTRACTORS)}")
        self.name, self.kernels, self.seed, self.most, self.bank = name, kernels, seed, most, None

    def fit(self, windows: DataFrame, column: str, identity: str, channels: int) -> Extractor:
        self.bank = EXTRACTORS[self.name](sample_windows(windows, column, identity, channels, self.most, self.seed + 1), self.kernels, self.seed)
        return self

    def transform(self, windows: DataFrame, column: str, out: str = "features", keep: bool = False) -> DataFrame:
        """windows with the features in place of the samples, or (keep) beside them."""
        if self.bank is None:
            raise RuntimeError("fit before transform")
        held = windows.sparkSession.sparkContext.broadcast(self.bank)
        others = [c for c in windows.columns if (keep or c != column) and c != out]
        types = dict(windows.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bank = held.value
            for batch in batches:
                rows = batch.column(0).to_pylist()
                x = np.array(rows, float).reshape(len(rows), bank.channels, -1) if rows else np.empty((0, bank.channels, 0))
                f = features(bank, x) if rows else np.empty((0, len(bank.bias)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(f), pa.list_(pa.float32()))], names=[*others, out])

        return windows.select(F.col(column).alias("_given"), *others).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in others), f"`{out}` array<float>"]))
