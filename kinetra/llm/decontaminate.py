"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The documents of the index are the test items, the queries are the passages of the training texts; the terms of both
are word trigrams (an item of fewer words is one term), since single words of running text bound nothing. A passage is
twice as many words as the longest item and passages overlap by half, so that each item's length fits into one passage
whole. An impact is an item's BM25 weight of a term over the sum of its weights: a score is then the share of an item
that a passage has, and one threshold serves all items. Every passage is a query: most end at the upper bound that
their terms' greatest impacts give; the others go through the posting lists by block-max WAND, which finds all items
at or above the threshold. What it finds counts where the passage also has enough of the word bigrams of both the
item's question and its answer.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import durable, slices, table, texts

TOKEN = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words as question and answer: cut after the last question mark, else before the last sentence, else at three fifths."""
    head, mark, tail = text.rpartition("?")
    if not mark or not tokens(tail):
        parts = SENTENCE.split(text.strip())
        head, tail = " ".join(parts[:-1]), parts[-1]
    q, a = tokens(head), tokens(tail)
    if not q or not a:
        both = q + a
        at = -(-3 * len(both) // 5)
        q, a = both[:at], both[at:] or both[-1:]
    return q, a


def ngrams(words: list, n: int) -> set[tuple]:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def terms(words: list[str], n: int = 3) -> list[str]:
    """Word trigrams, or the whole where it is shorter."""
    n = max(1, min(n, len(words)))
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _hashed(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - n + 1 + i].astype(np.uint64)
    return out


@dataclass
class Index:
    """Posting lists of a bounded block of items, in blocks of `block` postings with the greatest impact of each."""

    block: int = 64
    words: dict[str, int] = field(default_factory=dict)
    items: list[int] = field(default_factory=list)
    parts: list[tuple[set, set, int, int]] = field(default_factory=list)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # n: sorted term hashes, their lists
    postings: list[np.ndarray] = field(default_factory=list)
    impacts: list[np.ndarray] = field(default_factory=list)
    tops: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(1))
    span: int = 1

    @classmethod
    def build(cls, rows: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, gram: int, k1: float = 1.2, b: float = 0.75) -> Index:
        out = cls()
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
            words = tokens(text)
            if not words:
                continue
            tf = Counter(terms(words))
            norm = k1 * (1 - b + b * sum(tf.values()) / mean)
            weight = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (k1 + 1) / (c + norm) for w, c in tf.items()}
            total = sum(weight.values())
            for w, x in weight.items():
                lists[w].append((len(out.items), x / total))
            for w in words:
                out.words.setdefault(w, len(out.words) + 1)
            q, a = ([out.words[w] for w in p] for p in question_answer(text))
            out.items.append(item)
            out.parts.append((ngrams(q, gram), ngrams(a, gram), min(gram, len(q)), min(gram, len(a))))
            out.span = max(out.span, len(words))
        hashes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (term, found) in enumerate(lists.items(), 1):
            ids, xs = (np.array(x) for x in zip(*found, strict=True))
            out.postings.append(ids)
            out.impacts.append(xs)
            out.tops.append(np.maximum.reduceat(xs, np.arange(0, len(xs), out.block)))
            words = np.array([out.words[w] for w in term.split(" ")], np.int64)
            hashes[len(words)].append((int(_hashed(words, len(words))[0]), t))
        for size, found in hashes.items():
            found.sort()
            out.keys[size] = np.array([h for h, _ in found], np.uint64), np.array([t for _, t in found], np.int64)
        out.most = np.array([0.0, *(x.max() for x in out.impacts)])
        return out

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size of terms: the positions that begin one, and which (0 elsewhere)."""
        for size, (hashes, lists) in self.keys.items():
            found = np.zeros(len(ids), np.int64)
            if len(ids) >= size:
                known = ids[: len(ids) - size + 1] > 0
                for i in range(1, size):
                    known &= ids[i : len(ids) - size + 1 + i] > 0
                at = np.flatnonzero(known)
                if len(at):
                    own = _hashed(ids, size)[at]
                    where = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    found[at] = np.where(hashes[where] == own, lists[where], 0)
            yield size, found

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts of the query's words sum to the threshold, by block-max WAND."""
        cursors = [[int(self.postings[t - 1][0]), 0, t - 1] for t in query]  # item, position, list
        found, eps = [], 1e-12
        while cursors:
            cursors.sort()
            bound = 0.0
            for pivot, (item, _, t) in enumerate(cursors):
                bound += self.most[t + 1]
                if bound + eps >= threshold:
                    break
            else:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks, until = 0.0, None
            for _, at, t in cursors[: pivot + 1]:
                ids = self.postings[t]
                b = at // self.block
                while (b + 1) * self.block < len(ids) and ids[(b + 1) * self.block - 1] < item:
                    b += 1
                blocks += self.tops[t][b]
                last = int(ids[min((b + 1) * self.block, len(ids)) - 1])
                until = last if until is None else min(until, last)
            if blocks + eps < threshold:  # no item up to the nearest block end can reach it
                target = max(until, item) + 1
                if pivot + 1 < len(cursors):
                    target = max(min(target, cursors[pivot + 1][0]), item + 1)
                moved = range(pivot + 1)
            elif cursors[0][0] == item:
                score = sum(float(self.impacts[t][at]) for x, at, t in cursors if x == item)
                if score + eps >= threshold:
                    found.append((item, score))
                target, moved = item + 1, [k for k, c in enumerate(cursors) if c[0] == item]
            else:
                target, moved = item, range(pivot)
            for k in moved:
                _, at, t = cursors[k]
                at += int(np.searchsorted(self.postings[t][at:], target))
                cursors[k] = [int(self.postings[t][at]), at, t] if at < len(self.postings[t]) else None
            cursors = [c for c in cursors if c]
        return found

    def leaks(self, text: str, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """item -> best score, and the shares of question and answer n-grams in that passage, of the verified items."""
        get = self.words.get
        ids = np.array([get(w, 0) for w in tokens(text)], np.int64)
        if not len(ids) or not self.items:
            return {}
        found = list(self.matches(ids))
        sums = np.concatenate(([0.0], np.cumsum(sum(self.most[f] for _, f in found))))
        starts = np.arange(0, max(1, len(ids) - self.span), self.span)
        ends = np.minimum(starts + 2 * self.span, len(ids))
        out: dict[int, tuple[float, float, float]] = {}
        for k in np.flatnonzero(sums[ends] - sums[starts] + 1e-9 >= threshold).tolist():
            s, e = int(starts[k]), int(ends[k])
            query = np.unique(np.concatenate([f[s : max(s, e - n + 1)] for n, f in found]))
            query = query[query > 0]
            if self.most[query].sum() + 1e-9 < threshold:
                continue
            words, grams = ids[s:e].tolist(), {}
            for item, score in self.search(query.tolist(), threshold):
                q, a, nq, na = self.parts[item]
                for n in (nq, na):
                    if n not in grams:
                        grams[n] = ngrams(words, n) if len(words) >= n else set()
                shares = len(q & grams[nq]) / len(q), len(a & grams[na]) / len(a)
                if min(shares) >= overlap and (score, *shares) > out.get(item, (0.0,)):
                    out[item] = (score, *shares)
        return out


def indexes(benchmark: DataFrame, gram: int = 2, block_chars: int = 32 << 20) -> Iterator[Index]:
    """An index of each block of items. A block is at most about block_chars of text, which bounds what is broadcast;
    term statistics are of all items, so that blocks do not change a score. Null and word-less items are left out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(w) if (w := tokens(t.decode("utf-8", "ignore"))) else [] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["item_id", "text", "terms"])

    items = durable(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(split, "item_id bigint, text string, terms array<string>").where(F.size("terms") > 0))
    n, mean, chars = items.agg(F.count("*"), F.avg(F.size("terms")), F.sum(F.length("text"))).first()
    if not n:
        return
    blocks = -(-chars // block_chars)
    own = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    df = items.select(F.explode(F.array_distinct("terms")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    for i in range(blocks):
        mine = own.where(F.col("block") == i)
        known = df.join(mine.select(F.explode("terms").alias("w")), "w", "left_semi")
        yield Index.build([tuple(r) for r in mine.select("item_id", "text").collect()], {r[0]: r[1] for r in known.collect()}, n, mean, gram)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each test item that a text has.

    All passages of each whole text are queried. Null and empty texts have none; a text that has an item twice gives
    it once, with the best score; rows that repeat a doc_id give rows each; a null doc_id is kept. Either table empty:
    no rows. Columns other than doc_id, text, item_id are not read.
    """
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    types, names = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)  # at most a block of items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 8 << 20):
                ids = batch.column(0).to_pylist()
                found = [(i, held.value.items[item], *x) for i, t in zip(ids, texts(batch), strict=True) for item, x in sorted(held.value.leaks(t.decode("utf-8", "ignore"), threshold, overlap).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return rows.limit(0).mapInArrow(lambda b: iter(()), schema) if out is None else out


def clean_stage(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Pipeline stage: documents that have no item of the benchmark table; rows and columns pass through unshuffled.

    Null and empty texts have no item and stay, as do null ids, repeated rows and columns of any name. Without items all
    rows stay; no rows give no rows.
    """
    for index in indexes(table(spark, sf_dir, "benchmark")):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 8 << 20):
                yield batch.filter(pa.array([not held.value.leaks(t.decode("utf-8", "ignore"), threshold, overlap) for t in texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
