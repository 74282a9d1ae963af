"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows.

A tree splits at random statistics and values; what few splits part from the rest is anomalous. The statistics are all
that the rules count, as shares that do not depend on a text's length (repeats in coarse steps: good texts have a few),
and shares of capitals and marks. Each tree draws its random splits from rows of its own, as isolation trees do, dealt by hash
among all rows that pass the base rules; then all these rows go down every tree, and how many end in a leaf says how
anomalous it is. The threshold on the score is the one that parts labelled good and bad rows best among those that keep
nearly all good ones, over all labelled rows; a third of these is held out of it, to measure it on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import crc_mod, slices, staged, texts
from kinetra.operators import tall
from kinetra.operators.adapt import matrix
from kinetra.operators.prefix import running

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
CAPITALS, MARKS = bytes(range(65, 91)), b"!?"
SHARES = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows of `window` words that the list has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) > len(words) - window:  # a repeated window repeats all its words
        return 0
    codes = np.zeros(n, np.uint64)
    for i in range(window):
        codes = (codes ^ (codes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + i] != ids[b + i]).any() for i in range(window)):  # hashes collided: count the windows themselves
        return _repeat_words_plain(ids, window)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.union1d(a, b)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _repeat_words_plain(ids: np.ndarray, window: int) -> int:
    seen: dict[tuple, list[int]] = {}
    for i in range(len(ids) - window + 1):
        seen.setdefault(tuple(ids[i : i + window].tolist()), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The counts, and the statistics that the forest sees: shares that do not depend on the text's length."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, SPACES + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicate = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    capitals, marks = (len(text) - len(text.translate(None, c)) for c in (CAPITALS, MARKS))
    per_word, per_char = max(n, 1), max(chars, 1)
    steps = [round(2 * duplicate / max(len(lines), 1)), round(5 * repeated / per_word)]
    shares = [chars / per_word, symbols / per_word, capitals / per_char, marks / per_word, *steps]
    return (n, chars, symbols, duplicate, repeated), shares


class Forest:
    """Isolation trees of at most `size` rows each, as arrays; score in (0, 1), higher more anomalous.

    dealt: rows are in an order that looks random, and tree k takes every trees-th of them from the k-th on.
    """

    def __init__(self, rows: np.ndarray, trees: int = 200, size: int = 64, seed: int = 3, dealt: bool = False):
        rng = np.random.default_rng(seed)
        self.size = max(2, min(size, len(rows)))
        self.depth = int(np.ceil(np.log2(self.size)))
        own = lambda k: rows[k::trees][: self.size] if dealt and len(rows) >= trees * self.size else rows[rng.choice(len(rows), self.size, replace=len(rows) < self.size)]
        self.trees = [self._grow(own(k), rng) for k in range(trees)] if len(rows) else []

    @staticmethod
    def _expected(n: np.ndarray | int) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, left, right, path = [], [], [], [], []
        todo = [(np.arange(len(rows)), 0, None, False)]
        while todo:
            at, depth, parent, is_right = todo.pop()
            me = len(feature)
            if parent is not None:
                (right if is_right else left)[parent] = me
            low, high = rows[at].min(axis=0), rows[at].max(axis=0)
            ways = np.flatnonzero(high > low)
            for store, x in ((feature, -1), (value, 0.0), (left, me), (right, me), (path, depth + float(self._expected(len(at))))):
                store.append(x)
            if depth < self.depth and len(at) > 1 and len(ways):
                f = int(rng.choice(ways))
                v = rng.uniform(low[f], high[f])
                feature[me], value[me] = f, v
                below = rows[at, f] <= v
                todo += [(at[below], depth + 1, me, False), (at[~below], depth + 1, me, True)]
        return np.array(feature), np.array(value), np.array(left), np.array(right), np.array(path)

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the node in which each row ends."""
        each = np.arange(len(rows))
        for feature, value, left, right, _ in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(rows[each, np.maximum(f, 0)] <= value[at], left[at], right[at]))
            yield at

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many rows end in each node (column) of each tree (row)."""
        return np.array([np.bincount(at, minlength=2 << self.depth) for at in self.leaves(rows)], float).reshape(len(self.trees), -1)

    def weigh(self, counts: np.ndarray) -> None:
        """Path lengths by what share of all rows ends in a leaf, in place of the rows that the tree was grown on."""
        steps = np.arange(self.size + 1)
        for k, (feature, value, left, right, path) in enumerate(self.trees):
            depth = np.zeros(len(feature))
            for node in np.flatnonzero(feature >= 0):  # a node comes before those below it
                depth[[left[node], right[node]]] = depth[node] + 1
            share = counts[k, : len(feature)] * self.size / max(counts[k].sum(), 1)
            self.trees[k] = feature, value, left, right, np.where(feature < 0, depth + np.interp(share, steps, self._expected(steps)), path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for (*_, path), at in zip(self.trees, self.leaves(rows), strict=True):
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / float(self._expected(self.size)))


def threshold(scored: DataFrame, keep: float = 0.99) -> float:
    """The cut above which rows go: best by kept good plus dropped bad rows, among those that keep the share of good.

    scored: anomaly and y (1 good, 0 bad), any number of rows: running sums over the distinct scores. 1 without a row.
    """
    cells = scored.groupBy("anomaly").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    good, bad = cells.agg(F.sum("good"), F.sum("bad")).first()
    sums = running(cells, [], ["anomaly"], {"good_before": "good", "bad_before": "bad"})
    kept = (F.col("good_before") + F.col("good")) / good if good else F.lit(1.0)
    dropped = 1 - (F.col("bad_before") + F.col("bad")) / bad if bad else F.lit(0.0)
    best = sums.select("anomaly", kept.alias("kept"), dropped.alias("dropped")).where(F.col("kept") >= keep)
    cut = best.agg(F.min_by("anomaly", F.struct(-(F.col("kept") + F.col("dropped")), "anomaly"))).first()[0]
    return 1.0 if cut is None else float(cut)


def filter_rules(docs: DataFrame, labels: DataFrame, trees: int = 200, size: int = 64) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly of each row of docs.

    All of every text counts. A null text has no words and fails the base rules, as an empty one does; a null doc_id
    is kept as it is; repeated rows are judged each. Each tree's splits are drawn from `size` rows of its own, by hash of all
    rows that pass the base rules; its leaves are weighed by all these rows. The threshold comes from all labelled rows but
    those whose crc32(doc_id) mod 3 is 1; without labels nothing is dropped but by the base rules. A score at the threshold
    is kept. lang and source are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            out = [statistics(t) for t in texts(batch)]
            counts = np.array([c for c, _ in out], np.int64).reshape(-1, len(COUNTS))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            columns = [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array([x for _, x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "shares"])

    told = f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean"
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = staged(own.mapInArrow(measure, f"{told}, shares array<double>"))
    passed = measured.where("not base_failed").select("doc_id", "shares")
    order = F.xxhash64("doc_id", "shares", F.lit("trees"))
    rate = min(1.0, (1.1 * trees * size + 1000) / max(passed.count(), 1))  # so many rows at least are those of all trees
    drawn = passed.where(F.pmod(order, F.lit(1_000_000_000)) < int(rate * 1_000_000_000)).select(order.alias("h"), "shares")
    forest = Forest(np.array([r[1] for r in sorted(tuple(r) for r in drawn.collect())]).reshape(-1, SHARES), trees, size, dealt=True)
    grown = spark.sparkContext.broadcast(forest)
    counts = tall.summed(passed, ["shares"], lambda batch, forest: forest.counts(matrix(batch.column(0))), grown) if forest.trees else None
    if counts is not None:
        forest.weigh(counts)
    held = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[:-1], pa.array(held.value.score(matrix(batch.column(len(COUNTS) + 2))))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "anomaly"])

    scored = staged(measured.mapInArrow(run, f"{told}, anomaly double"))
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~crc_mod("doc_id", 3).eqNullSafe(1))
    marked = marked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    cut = threshold(scored.where("not base_failed").select("doc_id", "anomaly").join(marked, "doc_id").select("anomaly", "y"))
    kept = ~F.col("base_failed") & (F.col("anomaly") <= cut)
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")
