"""Periodic runs of words by a grammar: passages that repeat themselves on the spot, as loops of a text generator do.

The words of a batch of texts become numbers, and Re-Pair gives each pair of neighbours that stands twice or more a
symbol, over and over, the more frequent of two overlapping pairs first. What is left of each text is paired up into a
balanced tree. Of every symbol one place is looked at: a run in its words that crosses the border of its two halves is
found there once, and holds wherever the symbol stands. The smallest symbol that holds a whole run has its border inside
the run, so that none is missed; pieces of a run that smaller symbols told are merged into it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import slices, texts

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
PRIME, BASE = (1 << 31) - 1, 1_000_003


class Grammar(NamedTuple):
    """left, length: of each rule its left half's words and all its words. at: (rule, first word) of all places of all
    rules. first: the first word of each symbol that is left of the texts, in order."""

    left: np.ndarray
    length: np.ndarray
    rule: np.ndarray
    place: np.ndarray
    first: np.ndarray


def repair(ids: np.ndarray, ends: np.ndarray) -> Grammar:
    """Re-Pair of texts in a row: ids, the numbers of their words, ends, where each text ends.

    A round replaces each pair that is more frequent than the pairs it overlaps. A pair that stands once stays so
    whatever its halves grow to, and is counted no more; the rounds end when no pair stands twice.
    """
    n = len(ids)
    words = int(ids.max()) + 1 if n else 0
    sym, pos, live = ids.astype(np.int64), np.arange(n), np.ones(n, bool)
    live[ends[ends > 0] - 1] = False
    lefts, known, rules, places, length = [], {}, [], [], np.ones(words, np.int64)
    while len(at := np.flatnonzero(live)):
        _, pair, count = np.unique(sym[at] * (2 * n + words) + sym[at + 1], return_inverse=True, return_counts=True)
        often = count[pair] > 1
        live[at[~often]] = False
        at, pair = at[often], pair[often]
        if not len(at):
            break
        # In a row of one symbol every second pair is left out, so that neighbours always differ in rank.
        same = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (pair[1:] == pair[:-1])))
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        rank = np.zeros(len(sym) + 2, np.int64)
        rank[at + 1] = np.where(since % 2, 0, (np.minimum(count[pair], (1 << 31) - 1) << 32) | ((pair * 2_654_435_761 + 1) & 0xFFFFFFFF))
        best = (rank[at + 1] > rank[at]) & (rank[at + 1] > rank[at + 2])
        at = at[best]
        kinds, one, kind = np.unique(pair[best], return_index=True, return_inverse=True)
        a, b = sym[at[one]], sym[at[one] + 1]
        number = np.empty(len(kinds), np.int64)
        for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            number[i] = known.setdefault(key, words + len(known))
        new = number >= len(length)
        lefts.append(length[a[new]])
        length = np.concatenate((length, length[a[new]] + length[b[new]]))
        rules.append(number[kind])
        places.append(pos[at])
        sym[at], live[at] = number[kind], live[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, pos, live = sym[keep], pos[keep], live[keep]
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(whole(lefts), length[words:], whole(rules) - words, whole(places), pos)


def _nodes(g: Grammar, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, border, end, rule or -1) of one place of each rule, and of the trees over what is left of each text."""
    _, one = np.unique(g.rule, return_index=True)
    start = g.place[one]
    found = [(start, start + g.left, start + g.length, np.arange(len(start)))]
    begin = np.concatenate(([0], ends[:-1]))
    text = np.searchsorted(ends, g.first, "right")
    low, high = np.searchsorted(g.first, begin[text]), np.searchsorted(g.first, ends[text])
    local, stop, half = np.arange(len(g.first)) - low, np.append(g.first, ends[-1] if len(ends) else 0), 1
    while len(g.first) and half <= local.max():
        at = np.flatnonzero(local % (2 * half) == half)
        found.append((g.first[at - half], g.first[at], stop[np.minimum(at + half, high[at])], np.full(len(at), -1)))
        half *= 2
    s, p, e, rule = (np.concatenate(x) for x in zip(*found, strict=True))
    wide = e - s >= least
    return s[wide], p[wide], e[wide], rule[wide]


def _crossing(ids: np.ndarray, s: np.ndarray, p: np.ndarray, e: np.ndarray, power: int, most: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
    """(node, period, window): where three periods in a row near the border of a node look alike, by their sums.

    A run of four periods or more over the border holds a window of three that begins 0 to 3 periods before it.
    """
    n = len(ids)
    pw = np.ones(n + 1, np.int64)
    k = 1
    while k <= n:
        pw[k : 2 * k] = pw[: min(k, n + 1 - k)] * (pw[k - 1] * BASE % PRIME) % PRIME
        k *= 2
    worth = np.random.default_rng(7).integers(1, PRIME, int(ids.max()) + 1 if n else 1)
    total = np.concatenate(([0], np.cumsum(worth[ids] * pw[:n] % PRIME)))
    many = (e - s) // power
    until = np.cumsum(many)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + most, "right")))
        c = many[i:j]
        node = np.repeat(np.arange(i, j), c)
        q = np.arange(len(node)) - np.repeat(np.cumsum(c) - c, c) + 1
        b = p[node]
        u, v = ids[b - 1], ids[b]
        up, down = np.minimum(b + q, n - 1), np.maximum(b - q, 1)
        near = ((v == ids[up]) & (u == ids[up - 1]) & (b + q < e[node])) | ((v == ids[down]) & (u == ids[down - 1]) & (b - 1 - q >= s[node]))
        node, q, b = node[near], q[near], b[near]
        hits = []
        for back in range(4):
            t = b - 1 - back * q
            ok = (t >= s[node]) & (t + 3 * q <= e[node])
            at, d, t = node[ok], q[ok], t[ok]
            alike = (total[t + 2 * d] - total[t]) % PRIME * pw[d] % PRIME == (total[t + 3 * d] - total[t + d]) % PRIME
            hits.append((at[alike], d[alike], t[alike]))
        at, d, t = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((d, at))
        yield from zip(at[order].tolist(), d[order].tolist(), t[order].tolist(), strict=True)
        i = j


def _extent(ids: np.ndarray, low: int, high: int, t: int, q: int) -> tuple[int, int] | None:
    """The longest stretch of period q in words low to high that holds the three periods from t; None if these differ."""
    if not np.array_equal(ids[t : t + 2 * q], ids[t + q : t + 3 * q]):
        return None
    end, step = t + 3 * q, 64
    while end < high:
        differ = np.flatnonzero(ids[end : min(high, end + step)] != ids[end - q : min(high, end + step) - q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = min(high, end + step), step * 2
    step = 64
    while t > low:
        a = max(low, t - step)
        differ = np.flatnonzero(ids[a:t] != ids[a + q : t + q])
        if len(differ):
            t = a + int(differ[-1]) + 1
            break
        t, step = a, step * 2
    return t, end


def runs(ids: np.ndarray, ends: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs of `least` words and `power` periods or more, in order."""
    g = repair(ids, ends)
    s, p, e, rule = _nodes(g, ends, least)
    told: dict[int, list[tuple[int, int, int]]] = {}
    for node, q, t in _crossing(ids, s, p, e, power):
        own = told.setdefault(node, [])
        # A stretch over the border whose shorter period divides this one is the same stretch.
        if any(a <= t and t + 3 * q <= b and q % d == 0 for a, b, d in own):
            continue
        found = _extent(ids, int(s[node]), int(e[node]), t, q)
        if found and found[0] < p[node] < found[1] and found[1] - found[0] >= max(least, power * q):
            own.append((*found, q))
    by_rule = np.argsort(g.rule, kind="stable")
    sorted_rules = g.rule[by_rule]
    everywhere = set()
    for node, own in told.items():
        shifts = [0]
        if own and rule[node] >= 0:
            a, b = np.searchsorted(sorted_rules, [rule[node], rule[node] + 1])
            shifts = (g.place[by_rule[a:b]] - s[node]).tolist()
        everywhere |= {(q, a + d, b + d) for a, b, q in own for d in shifts}
    merged: list[list[int]] = []
    for q, a, b in sorted(everywhere, key=lambda x: (x[0], x[1], -x[2])):
        if merged and merged[-1][2] == q and a <= merged[-1][1] - q:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, q])
    return sorted((a, b, q) for a, b, q in merged)


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, and in one id of ten (by crc32) from some word on a few rounds of the words that follow it."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


def _tell(least: int, power: int, loops: bool, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            number: dict[bytes, int] = {}
            lists = [t.split() for t in texts(batch)]
            doc_ids = batch.column(0).to_pylist()
            if loops:
                lists = [looped(w, i) for w, i in zip(lists, doc_ids, strict=True)]
            ids = np.array([number.setdefault(w, len(number)) for words in lists for w in words], np.int64)
            ends = np.cumsum([len(words) for words in lists])
            of: list[list[tuple[int, int, int]]] = [[] for _ in lists]
            for a, b, q in runs(ids, ends, least, power):
                k = int(np.searchsorted(ends, a, "right"))
                begin = int(ends[k - 1]) if k else 0
                of[k].append((a - begin, b - a, q))
            out = []
            for words, found in zip(lists, of, strict=True):
                if found:
                    keep = np.ones(len(words), bool)
                    for a, length, q in found:
                        keep[a + q : a + length] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                kept = b" ".join(words)
                out.append(hashlib.sha256(kept).hexdigest() if digests else kept.decode())
            told = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in of], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in lists], pa.int64()), told, pa.array(out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, power: int = 4, loops: bool = False, digests: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row of docs.

    A run is a longest stretch of words of one smallest period, of `least` words and `power` periods at least. collapsed: the words
    that no run repeats, joined by one space (digests: its sha256 in its place). loops: in one id of ten a text loops from some
    word on (see looped). A text is never split: a task holds its words, and some 4 MB of texts at a time besides. Null and
    empty texts have no words and no runs; a null id never loops; repeated rows each get a row; other columns are not
    read. No rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tell(least, power, loops, digests), SCHEMA)


def run_report(docs: DataFrame) -> DataFrame:
    """The runs of each row of docs as counts, its longest run and digests: one row for each row of docs.

    Longest: ties go to the smallest start, then period; nulls where there is no run.
    """
    told = periodic_runs(docs, loops=True, digests=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    told = told.withColumn("_top", longest)
    return told.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_top.start").alias("start"), (-F.col("_top.less")).alias("length"), F.col("_top.period").alias("period"),
        F.floor(-1000 * F.col("_top.less") / F.col("_top.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
