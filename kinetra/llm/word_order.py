"""Words foreseen from the words before them, by online logistic mixing.

The most frequent words, the end and an escape for all other words are leaves of a Huffman tree: a token is the path of
yes-no decisions to its leaf. Three predictors speak on each: the counts of single words below the node, and counts of zeros and
ones in hashed tables under the word before and under the two words before, whatever words these are. Their logits are mixed with
weights that a gate chooses (how much both contexts have seen of the node). All training texts are counted and teach the weights in one
pass, online: a task foresees each chunk of tokens by what it has counted before, moves the weights and counts the chunk. Counts are added
up over tasks in whole numbers, weights averaged.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 22  # log2 of the slots of each context's table
BLOCK = 1 << 17
INPUTS = 3
LEVELS = (0.5, 1.5, 2.5, 4.5, 8.5, 20.5, 60.5, 300.5)  # of how much a slot has seen
KNOWN = len(LEVELS) + 1
MUL, NODE, ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
STRIDE = 4
EXACT, GROWTH = 128, 1.125  # counts beyond EXACT are kept to a step of an eighth


def quantised(n: np.ndarray) -> np.ndarray:
    """A byte for each count."""
    far = EXACT + np.floor(np.log(np.maximum(n, EXACT) / EXACT) / np.log(GROWTH) + 1e-9)
    return np.where(n < EXACT, n, np.minimum(far, 255)).astype(np.uint8)


def _known() -> tuple[np.ndarray, np.ndarray]:
    """(logit, level) of each pair of bytes (ones * 256 + zeros)."""
    q = np.arange(256)
    n = np.where(q < EXACT, q, EXACT * GROWTH ** (q - EXACT + 0.5))
    return (np.log(n + 0.1)[:, None] - np.log(n + 0.1)).ravel().astype(np.float32), np.digitize(n[:, None] + n, LEVELS).ravel().astype(np.uint8)


LOGIT, LEVEL = _known()
BYTE = quantised(np.arange(1 << 16))


class Ids(dict):
    """Words' leaves; what is not there is the escape."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


class Code:
    """Leaves 0.. are the words, then the escape. Each leaf's path from the root: nodes and bits."""

    def __init__(self, words: list[bytes], counts: list[int], escaped: int):
        self.ids, self.escape = Ids((w, i) for i, w in enumerate(words)), len(words)
        self.uses = uses = np.array([*counts, escaped], np.int64)
        leaves = len(uses)
        heap = [(max(int(n), 1), i) for i, n in enumerate(uses)]
        heapq.heapify(heap)
        up, side, total = np.zeros(2 * leaves, np.int64), np.zeros(2 * leaves, np.int8), np.concatenate((uses, np.zeros(leaves, np.int64)))
        below = np.zeros((leaves, 2), np.int64)  # zeros and ones of each node
        for node in range(leaves - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, at in ((0, i), (1, j)):
                up[at], side[at], below[node, bit] = leaves + node, bit, total[at]
            total[leaves + node] = below[node].sum()
            heapq.heappush(heap, (a + b, leaves + node))
        root, at, levels = 2 * leaves - 2, np.arange(leaves), []
        while (at != root).any():
            levels.append((np.where(at == root, -1, up[at] - leaves), side[at]))
            at = np.where(at == root, root, up[at])
        nodes, bits = (np.array([x[k] for x in reversed(levels)]).reshape(len(levels), leaves).T for k in (0, 1))
        on = nodes >= 0
        self.size = on.sum(axis=1)
        self.start = np.cumsum(self.size) - self.size
        node, self.bit = nodes[on], bits[on].astype(np.int8)
        # Decisions that follow each other share a line of slots: STRIDE at a time, by the bits since the first of them.
        leaf = np.repeat(np.arange(leaves), self.size)
        depth = np.arange(len(node)) - self.start[leaf]
        self.inner = np.ones(len(node), np.int64)
        for k in range(1, STRIDE):
            at = np.flatnonzero(depth % STRIDE == k)
            self.inner[at] = self.inner[at - 1] * 2 + self.bit[at - 1]
        first = np.flatnonzero(depth % STRIDE == 0)
        self.line_size = np.bincount(leaf[first], minlength=leaves)
        self.line_start = np.cumsum(self.line_size) - self.line_size
        self.line_spread = node[first].astype(np.uint64) * NODE
        self.line_length = np.diff(first, append=len(node))
        self.single = np.log((below[:, 1] + 0.1) / (below[:, 0] + 0.1)).astype(np.float32)[node]  # with every token: the tree is made from these counts
        self.hashes = np.array([zlib.crc32(w) for w in words] + [0], np.uint64)

    def tokens(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all tokens of the texts, one after another: leaf, hash of the word before, of the two before."""
        flat = list(chain.from_iterable(texts))
        leaf = np.array(list(map(self.ids.__getitem__, flat)), np.int64)
        word = self.hashes[leaf]
        missing = np.flatnonzero(leaf == self.escape)
        word[missing] = [zlib.crc32(flat[i]) for i in missing.tolist()]
        word += np.uint64(1)  # 0: nothing before
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        before, further = np.zeros_like(word), np.zeros_like(word)
        before[1:], further[2:] = word[:-1], word[:-2]
        before[starts[starts < len(word)]] = 0
        further[starts[starts < len(word)]] = 0
        further[starts[starts + 1 < len(word)] + 1] = 0
        one = (before + ONE) * MUL
        one ^= one >> np.uint64(29)
        two = (one * TWO + further) * MUL
        return leaf, one * ONE, (two ^ (two >> np.uint64(31))) * TWO

    def decisions(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(each token's decisions; their logit by single words, bit, slot of the word before, of the two before), token by token."""

        def along(start: np.ndarray, size: np.ndarray) -> np.ndarray:
            at = np.repeat(start - np.cumsum(size) + size, size)
            at += np.arange(len(at))
            return at

        size, lines = self.size[leaf], self.line_size[leaf]
        at, line = along(self.start[leaf], size), along(self.line_start[leaf], lines)
        inner, spread, length = self.inner.take(at, mode="clip"), self.line_spread.take(line, mode="clip"), self.line_length.take(line, mode="clip")

        def slot(h: np.ndarray, first: int) -> np.ndarray:
            h = np.repeat(h, lines)
            h += spread
            h *= MUL
            h >>= np.uint64(64 - BITS)
            h = np.repeat(h.view(np.int64) + first, length)
            h ^= inner  # stays within the line
            return h

        return size, self.single.take(at, mode="clip"), self.bit.take(at, mode="clip"), slot(one, 0), slot(two, 1 << BITS)


class Mixer:
    """states: zeros and ones of every slot as two bytes; weights: by gate."""

    def __init__(self, code: Code, states: np.ndarray | None = None):
        self.code, self.states, self.taken = code, states, 0
        self.weights = np.tile(np.float32([1, 0.1, 0.1]), (KNOWN * KNOWN, 1))  # single words, until more is learned

    def _mix(self, single: np.ndarray, states: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(gate, inputs, logit) of decisions with these logits by single words, whose slots have these states."""
        inputs = [single, *[LOGIT.take(s, mode="clip") for s in states]]
        gate = LEVEL.take(states[0], mode="clip").astype(np.int64)
        gate *= KNOWN
        gate += LEVEL.take(states[1], mode="clip")
        z = np.zeros(len(single), np.float32)
        for k, x in enumerate(inputs):
            w = self.weights[:, k].copy().take(gate, mode="clip")
            w *= x
            z += w
        return gate, inputs, np.clip(z, -16, 16, out=z)

    def learn(self, texts: list[list[bytes]], counts: np.ndarray, squares: np.ndarray, chunk: int = 2048, rate: float = 0.02) -> int:
        """One pass, in chunks of tokens, small ones first: each is foreseen by counts (slots x zeros and ones), then moves the weights and is counted.

        squares: of the gradients so far. Returns how many decisions there were.
        """
        seen, gates, flat, both, one = 0, len(self.weights), counts.reshape(-1), counts.view(np.int64).ravel(), np.int32(1)
        given, hi = self.code.tokens(texts), 0
        while hi < len(given[0]):
            lo, hi = hi, hi + min(chunk, max(128, self.taken // 8))
            _, single, bit, *slots = self.code.decisions(*[x[lo:hi] for x in given])
            self.taken += hi - lo
            states = []
            for s in slots:
                pair = both.take(s, mode="clip").view(np.int32)
                states.append(BYTE.take(pair, mode="clip").view(np.uint16))  # zeros, then ones: the low byte first
            gate, inputs, z = self._mix(single, states)
            error = bit - 1 / (1 + np.exp(-z))
            move = np.stack([np.bincount(gate, weights=error * x, minlength=gates) for x in inputs], axis=1)
            squares += move * move
            self.weights += (rate * move / np.sqrt(squares)).astype(np.float32)
            for s in slots:
                s *= 2
                s += bit
                np.add.at(flat, s, one)
            seen += len(bit)
        return seen

    def score(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """log10 probability of each token's leaf: its word or end, or the escape in place of a word that the code lacks."""
        each = [np.zeros(0)]
        for lo in range(0, len(leaf), chunk):
            s = slice(lo, lo + chunk)
            size, single, bit, *slots = self.code.decisions(leaf[s], one[s], two[s])
            _, _, z = self._mix(single, [self.states.take(x, mode="clip") for x in slots])
            z *= 1 - 2 * bit
            each.append(np.add.reduceat(np.log(1 + np.exp(z)), np.cumsum(size) - size, dtype=np.float64) / -np.log(10))
        return np.concatenate(each)


SCALE = 1 << 20  # weights are averaged in whole numbers: the same in any order


def model(docs: DataFrame, words: list[tuple[bytes, int]], total: int, cut) -> Mixer:
    """The mixer, counted and learned on all training texts.

    docs: held (not a training text), text. words: those of the code, with their uses in training texts; total: of all words.
    cut: the batches' training texts as words, in lists of bounded size.
    """
    made = Mixer(Code([w for w, _ in words], [n for _, n in words], total - sum(n for _, n in words)), np.zeros(2 << BITS, np.uint16))
    if not total:
        return made
    shared = docs.sparkSession.sparkContext.broadcast(made.code)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the task's counts, and under block -1 its weights times its decisions, and these."""
        own, counts = Mixer(shared.value), np.zeros((2 << BITS, 2), np.int32)
        squares, seen = np.full(own.weights.shape, 1e-4), 0
        for texts in cut(batches):
            seen += own.learn(texts, counts, squares)
        if seen:
            for b in range(0, len(counts), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([packed(counts[b : b + BLOCK])], pa.binary())], names=["block", "payload"])
            weights = np.append(np.rint(own.weights.ravel().astype(np.float64) * SCALE).astype(np.int64), 1) * seen
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([weights.tobytes()], pa.binary())], names=["block", "payload"])

    def add(key: tuple, got: pa.Table) -> pa.Table:
        total = 0
        for x in got.column("payload"):
            total = total + (np.frombuffer(x.as_py(), np.int64) if key[0].as_py() < 0 else unpacked(x.as_py()))
        if key[0].as_py() >= 0:
            total = quantised(total).view(np.uint16)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "state": pa.array([total.tobytes()], pa.binary())})

    for r in docs.mapInArrow(learn, "block int, payload binary").groupBy("block").applyInArrow(add, "block int, state binary").toLocalIterator():
        if r[0] < 0:
            weights = np.frombuffer(r[1], np.int64)
            made.weights = (weights[:-1] / weights[-1] / SCALE).reshape(made.weights.shape).astype(np.float32)
        else:
            made.states[r[0] * BLOCK : (r[0] + 1) * BLOCK] = np.frombuffer(r[1], np.uint16)
    shared.unpersist()
    return made


def packed(counts: np.ndarray) -> bytes:
    """Counts of a block of slots: their low bytes together, and the few that are larger with their places."""
    flat = counts.reshape(-1)
    far = np.flatnonzero(flat > 255)
    return len(far).to_bytes(4, "little") + far.astype("<u4").tobytes() + flat[far].astype("<i4").tobytes() + pa.compress(np.minimum(flat, 255).astype(np.uint8), "zstd", asbytes=True)


def unpacked(payload: bytes) -> np.ndarray:
    n = int.from_bytes(payload[:4], "little")
    out = np.frombuffer(pa.decompress(payload[4 + 8 * n :], 2 * BLOCK, "zstd"), np.uint8).astype(np.int64)
    out[np.frombuffer(payload, "<u4", n, 4)] = np.frombuffer(payload, "<i4", n, 4 + 4 * n)
    return out.reshape(BLOCK, 2)
