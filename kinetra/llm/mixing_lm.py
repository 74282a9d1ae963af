"""Language-model scores by online logistic context mixing.

Each word is foreseen from the words before it (see word_order); the words that its code lacks are spelled, as follows.

A text is its words and an end; a word is its bytes and a space, coded bit by bit. Six predictors each keep counts of
zeros and ones in a table of fixed size, indexed by a hash of their context (the word so far, or its last bytes) and the
bits of the byte so far. Their logits are mixed with weights that two gates choose (the bits so far; how much the word
predictor and a long one know and where in the word the byte is). The weights are learned online, at rates that adapt
to the gradients seen, over all uses of all training words, each foreseen by tables that leave its own bit out (dealt to
tasks whose weights are averaged); so is the last refinement, a table that maps a mixed probability to what came true.

Counts come from all training texts too, all their words and uses. Spark counts words; tables are summed over tasks
in blocks of slots, in whole numbers; every distinct word that is spelled is scored once. Frequent ones then go to the documents by
broadcast (their number is bounded), all others by a join on the word: which way a word goes changes no score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm import word_order
from kinetra.llm.common import flag, slices, staged, texts

END = b"\n"  # no word holds a line feed
#: Bytes of context and log2 of the slots of each predictor; 0 bytes: the whole word so far.
TABLES = ((1, 16), (2, 19), (3, 20), (4, 21), (6, 21), (0, 22))
WORD = len(TABLES) - 1
OFFSETS = np.concatenate(([0], np.cumsum([1 << bits for _, bits in TABLES])))
BLOCK = 1 << 16
LEVELS = (0.5, 1.5, 2.5, 5.5, 15.5, 60.5, 300.5)  # of how much a slot has seen
KNOWN = len(LEVELS) + 1
DEEP = 64  # bytes of a word that words may share
LONG = 3  # the other predictor that opens a gate
PLACES = 8
STEPS = 33
MUL, NODE, ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x100000001B3
UNROLL = pow(ROLL, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Stream:
    """Words laid out as one run of bytes; contexts of all bytes at once."""

    def __init__(self, words: list[bytes]):
        sizes = np.array([1 if w == END else len(w) + 1 for w in words], np.int64)
        self.data = np.frombuffer(b"".join(w if w == END else w + b" " for w in words), np.uint8)
        n = len(self.data)
        self.starts = np.cumsum(sizes) - sizes
        self.own = np.repeat(np.arange(len(words)), sizes)
        start = self.starts[self.own]
        self.place = np.minimum(np.arange(n) - start, PLACES - 1)
        self.contexts = []
        at = np.arange(n)
        for k, (size, _) in enumerate(TABLES):
            h = np.full(n, k + 1, np.uint64)
            if size:
                for j in range(1, size + 1):
                    before = np.where(at - j >= start, self.data[np.maximum(at - j, 0)], 0).astype(np.uint64) + np.uint64(1)
                    h = (h ^ (h >> np.uint64(29))) * MUL + before
            else:  # a rolling hash of the word so far
                run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(ROLL, n))))
                h = (run[at] - run[start]) * _powers(UNROLL, n)[start] + np.uint64(k + 1)
            self.contexts.append((h ^ (h >> np.uint64(31))) * MUL)

    def bits(self, at: slice | np.ndarray = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of the bytes there: the node (bits so far), the slots in all tables (a row each), the bit."""
        data, contexts = self.data[at].astype(np.int64), [h[at] for h in self.contexts]
        for k in range(8):
            node = (1 << k) | (data >> (8 - k))
            spread = node.astype(np.uint64) * NODE
            slots = np.stack([((h + spread) * MUL >> np.uint64(64 - bits)).astype(np.int64) + offset for h, (_, bits), offset in zip(contexts, TABLES, OFFSETS[:-1], strict=True)])
            yield node, slots, (data >> (7 - k)) & 1


class Tree(Stream):
    """Sorted words. What is coded at a byte depends on the word up to it alone, so words that begin alike share their
    first bytes: fresh are the bytes that the word before does not have in common (beyond DEEP bytes all are)."""

    def __init__(self, words: list[bytes]):
        super().__init__(words)
        self.sizes = np.diff(self.starts, append=len(self.data))
        first = np.array([w[:DEEP] for w in words], f"S{DEEP}").view(np.uint8).reshape(len(words), DEEP)
        alike = np.logical_and.accumulate(first[1:] == first[:-1], axis=1).sum(axis=1)
        letters = np.array([len(w) for w in words])
        self.common = np.concatenate(([0], np.minimum(alike, np.minimum(letters[1:], letters[:-1]))))
        self.fresh = np.flatnonzero(np.arange(len(self.data)) - self.starts[self.own] >= self.common[self.own])

    def depths(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth at which words share: the places of the bytes there, and which of them are fresh."""
        for d in range(int(self.common.max())):
            words = np.flatnonzero(self.sizes > d)
            yield self.starts[words] + d, self.common[words] <= d

    def gathered(self, n: np.ndarray) -> np.ndarray:
        """For each fresh byte the sum of n over the words that share it."""
        out = n[self.own]
        for at, fresh in self.depths():
            heads = np.flatnonzero(fresh)
            out[at[heads]] = np.add.reduceat(n[self.own[at]], heads)
        return out[self.fresh]

    def summed(self, values: np.ndarray) -> np.ndarray:
        """For each word the sum of its bytes' values, given those of the fresh bytes."""
        out = np.zeros(len(self.data))
        out[self.fresh] = values
        for at, fresh in self.depths():
            out[at] = out[at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]]
        return np.bincount(self.own, weights=out, minlength=len(self.starts))


def trees(words: list[bytes], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, Tree]]:
    """The words in sorted order, in trees of about most bytes; with each the places of its words."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    sizes = np.cumsum([len(words[i]) + 1 for i in order])
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, side="right")))
        yield order[lo:hi], Tree([words[i] for i in order[lo:hi]])
        lo = hi


def predicted(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What slots with these counts predict, and the level of how much they have seen."""
    return np.log((ones + 0.1) / (zeros + 0.1)).astype(np.float16), np.digitize(zeros + ones, LEVELS).astype(np.uint8)


class Model:
    """logit: what each slot predicts (with left_out two rows: without one of its zeros, without one of its ones); seen: how
    much it has seen (without that one); weights by gate; the refinement."""

    def __init__(self, logit: np.ndarray, seen: np.ndarray):
        self.logit, self.seen, self.left_out = logit.ravel(), seen, logit.ndim == 2
        self.by_node = np.zeros((256, len(TABLES)))
        self.by_place = np.full((KNOWN * KNOWN * PLACES, len(TABLES)), 0.25)
        self.refined = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (256, 1))

    def _mix(self, node: np.ndarray, slots: np.ndarray, place: np.ndarray, own: np.ndarray | int = 0):
        """own: where the slots' rows of logits begin."""
        x = self.logit[slots + own].astype(np.float32)
        gate = (self.seen[slots[WORD]].astype(np.int64) * KNOWN + self.seen[slots[LONG]]) * PLACES + place
        z = np.clip(np.einsum("ij,ji->i", self.by_node[node] + self.by_place[gate], x), -16, 16)
        step = (np.clip(z, -7.999, 7.999) + 8) * (STEPS - 1) / 16
        low = step.astype(np.int64)
        part = step - low
        return x, gate, z, low, part, self.refined[node, low] * (1 - part) + self.refined[node, low + 1] * part

    def learn(self, words: list[bytes], uses: np.ndarray, seed: int, chunk: int = 2048, rate: float = 0.05, most: int = 1 << 20) -> None:
        """Online, from sorted words: each chunk is predicted with what was learned before it, then moves weights and refinement.

        Words are dealt by a seed into trees of about most bytes. Bytes that words share come once, with the sum of their
        uses; those of many uses come in several pieces, so that pieces weigh about alike, in an order that the seed draws.
        """
        rng, squares = np.random.default_rng(seed), [np.full(w.shape, 1e-4) for w in (self.by_node, self.by_place)]
        drawn = rng.permutation(len(words))  # in sorted order the last words would have the last say
        ends = np.cumsum([len(words[i]) + 1 for i in drawn])
        for some in np.split(drawn, np.flatnonzero(np.diff(ends // -(-ends[-1] // -(-ends[-1] // most)))) + 1):
            some = np.sort(some)
            tree, uses_of = Tree([words[i] for i in some]), uses[some].astype(np.int64)
            n = tree.gathered(uses_of).astype(float)
            mean = n.sum() / len(n)
            pieces = np.ceil(n / (2 * mean)).astype(np.int64)
            order = rng.permutation(np.repeat(np.arange(len(n)), pieces))
            weights = n / (pieces * mean)
            for lo in range(0, len(order), chunk):
                some = order[lo : lo + chunk]
                at, w = tree.fresh[some], weights[some]
                place = tree.place[at]
                for k, (node, slots, bit) in enumerate(tree.bits(at)):
                    x, gate, z, low, part, _ = self._mix(node, slots, place, bit * len(self.seen) if self.left_out else 0)
                    error = w * (bit - 1 / (1 + np.exp(-z)))
                    first, size = 1 << k, 1 << k  # the nodes of this bit
                    for what, square, row, rows in ((self.by_node[first : first + size], squares[0][first : first + size], node - first, size), (self.by_place, squares[1], gate, len(self.by_place))):
                        move = np.bincount((row + rows * np.arange(len(x))[:, None]).ravel(), weights=(error * x).ravel(), minlength=rows * len(x)).reshape(len(x), rows).T
                        square += move * move
                        what += rate * move / np.sqrt(square)
                    refined = self.refined[first : first + size]
                    cell, share = np.concatenate(((node - first) * STEPS + low, (node - first) * STEPS + low + 1)), np.concatenate((w * (1 - part), w * part))
                    total = np.bincount(cell, weights=share, minlength=refined.size).reshape(refined.shape)
                    ones = np.bincount(cell, weights=share * np.concatenate((bit, bit)), minlength=refined.size).reshape(refined.shape)
                    refined += (ones - total * refined) / (total + 64)
        np.clip(self.refined, 1e-5, 1 - 1e-5, out=self.refined)

    def score(self, words: list[bytes], most: int = 1 << 17) -> np.ndarray:
        """log10 probability of each word with its space, or of the end."""
        out = np.zeros(len(words))
        for own, tree in trees(words, most):
            total = np.zeros(len(tree.fresh))
            for lo in range(0, len(total), most):
                at = tree.fresh[lo : lo + most]
                for node, slots, bit in tree.bits(at):
                    _, _, z, _, _, fine = self._mix(node, slots, tree.place[at])
                    p = 0.5 * fine + 0.5 / (1 + np.exp(-z))
                    total[lo : lo + most] += np.log10(np.where(bit == 1, p, 1 - p))
            out[own] = tree.summed(total)
        return out


def tally(words: list[bytes], counts: np.ndarray, table: np.ndarray, most: int = 1 << 17) -> None:
    """Add the words' bits to the table (whole numbers), whose rows are slots and columns zeros and ones."""
    flat = table.reshape(-1)
    for own, tree in trees(words, most):
        n = tree.gathered(counts[own].astype(np.int64))
        for lo in range(0, len(n), most):
            for _, slots, bit in tree.bits(tree.fresh[lo : lo + most]):
                for row in slots:
                    np.add.at(flat, row * 2 + bit, n[lo : lo + most])


def lm_words(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The words of (held, text) batches' training texts, about a megabyte of texts at a time."""
    for batch in slices(batches, 1 << 20):
        yield [lm_words(text) for held, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True) if not held]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (uses in training texts) of every word of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())  # training, held out

        def out() -> pa.RecordBatch:
            words = list(set().union(*seen))
            columns = [pa.array(words, pa.binary()), pa.array([seen[0][w] for w in words], pa.int64())]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in slices(batches, 4 << 20):
            for held, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                seen[held].update(lm_words(text))
            if sum(map(len, seen)) > 400_000:  # bounds memory
                yield out()
        if any(seen):
            yield out()

    parts = docs.select(flag("doc_id", 7, 2).alias("held"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame, left_out: bool = False) -> tuple[np.ndarray, ...]:
    """logit and level of every slot, from the words' uses n less m; with left_out also the logits (two rows) without one of
    the slot's zeros and without one of its ones, and the level without one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((int(OFFSETS[-1]), 2), np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False) - batch.column(2).to_numpy(zero_copy_only=False)
            words = batch.column(0).to_pylist()
            used = np.flatnonzero(n > 0)
            tally([words[i] for i in used.tolist()], n[used], table)
        zeros, ones = table.T
        blocks, payload = [], []
        for b in range(0, len(zeros), BLOCK):
            at = np.flatnonzero(table[b : b + BLOCK].any(axis=1))
            if len(at):
                blocks.append(b // BLOCK)
                payload.append(at.astype("<u2").tobytes() + zeros[b + at].tobytes() + ones[b + at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(payload, pa.binary())], names=["block", "payload"])

    def add(key: tuple, got: pa.Table) -> pa.Table:
        zeros, ones = (np.zeros(BLOCK, np.int64) for _ in range(2))
        for x in got.column("payload").to_pylist():
            n = len(x) // 18
            at = np.frombuffer(x, "<u2", n)
            zeros[at] += np.frombuffer(x, np.int64, n, 2 * n)
            ones[at] += np.frombuffer(x, np.int64, n, 10 * n)
        logit, level = predicted(zeros, ones)
        out = [logit, level]
        if left_out:
            (zero, one), less = (predicted(np.maximum(zeros - 1, 0), ones)[0], predicted(zeros, np.maximum(ones - 1, 0))[0]), np.maximum(zeros + ones - 1, 0)
            out += [zero, one, np.digitize(less, LEVELS).astype(np.uint8)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "arrays": pa.array([[x.tobytes() for x in out]], pa.list_(pa.binary()))})

    size = int(OFFSETS[-1])
    logit, level = np.zeros(size, np.float16), np.zeros(size, np.uint8)
    without, less = (np.zeros((2, size), np.float16), np.zeros(size, np.uint8)) if left_out else (None, None)
    for r in counts.mapInArrow(count, "block int, payload binary").groupBy("block").applyInArrow(add, "block int, arrays array<binary>").toLocalIterator():
        s = slice(r[0] * BLOCK, (r[0] + 1) * BLOCK)
        logit[s], level[s] = np.frombuffer(r[1][0], np.float16), np.frombuffer(r[1][1], np.uint8)
        if left_out:
            without[0, s], without[1, s], less[s] = np.frombuffer(r[1][2], np.float16), np.frombuffer(r[1][3], np.float16), np.frombuffer(r[1][4], np.uint8)
    return (logit, level, without, less) if left_out else (logit, level)


def learned(model: Model, shared, counts: DataFrame, at_once: int = 150_000) -> Model:
    """The model with weights and refinement from all uses m of all words, foreseen by the shared tables.

    Words are dealt to parts of about at_once; a part learns online, and what the parts learn is averaged by their uses. The
    uses of a frequent word are dealt over several parts, so that none weighs more in one than a 2,000th of a part, or than
    in all; this adds 2,000 rows a part at most.
    """
    uses, words = counts.where("m > 0").agg(F.sum("m"), F.count("*")).first()
    if not uses:
        return model
    parts = -(-words // at_once)
    over = F.least(F.lit(parts), F.ceil(F.col("m") / F.lit(-(-uses // (parts * 2000))))).cast("int")
    dealt = counts.where("m > 0").select("word", "m", F.pmod(F.xxhash64("word"), F.lit(parts)).alias("h"), over.alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    dealt = dealt.select(F.pmod(F.col("h") + F.col("i"), F.lit(parts)).alias("part"), "word", (F.floor(F.col("m") / F.col("k")) + (F.col("i") < F.col("m") % F.col("k")).cast("int")).cast("bigint").alias("m"))

    def learn(key: tuple, got: pa.Table) -> pa.Table:
        got = got.combine_chunks().sort_by("word")
        own, m = Model(*shared.value), got.column("m").to_numpy()
        own.learn(got.column("word").to_pylist(), m, 11 + key[0].as_py())
        state = np.concatenate([x.ravel() for x in (own.by_node, own.by_place, own.refined)])
        return pa.table({"i": pa.array(np.arange(len(state))), "x": pa.array(state * m.sum())})

    # Sums of whole numbers, map-side first: the driver gets one row a weight, whatever the parts.
    summed = dealt.repartition(2 * parts, "part").groupBy("part").applyInArrow(learn, "i bigint, x double").groupBy("i").agg(F.sum((F.col("x") * float(1 << 32)).cast("decimal(38,0)")).cast("double").alias("x"))
    total = np.zeros(model.by_node.size + model.by_place.size + model.refined.size)
    for i, x in summed.collect():
        total[i] = x / (1 << 32) / uses
    ends = np.cumsum([model.by_node.size, model.by_place.size])
    model.by_node, model.by_place, model.refined = (x.reshape(w.shape) for x, w in zip(np.split(total, ends), (model.by_node, model.by_place, model.refined), strict=True))
    return model


def lm_score(docs: DataFrame, most_frequent: int = 300_000, most_coded: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    A text's score is that of its words and end, each foreseen from the two words before it (see word_order), and of the spelling of
    words beyond the most_coded most frequent ones or of fewer than two uses. All training texts are counted and teach tables and weights. At most
    most_frequent words are broadcast. Null and empty texts are an end alone; a null doc_id is kept and trains; repeated rows count and are scored each. Without a training row every word is unknown,
    and the model tells nothing. lang and source are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = staged(word_counts(own).sortWithinPartitions("word"))  # sorted words share their first bytes
    total, distinct, words = counts.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("bigint")), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    levels = sorted(((r[0], r[1]) for r in counts.where("n > 0").groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)

    def least(most: int) -> int:
        """A count that at most so many words have or exceed."""
        held = 0
        for level, k in levels:
            held += k
            if held > most:
                return int(2 ** ((level + 1) / 4)) + 1
        return 1

    frequent, coded = least(most_frequent), max(2, least(most_coded))
    in_code = (F.col("n") >= coded) | (F.col("word") == F.lit(END))
    code = {bytes(r[0]): r[1] for r in counts.where(in_code).select("word", "n").collect()}  # at most most_coded words and the end
    code = sorted((code | {END: code.get(END, 0)}).items(), key=lambda r: (-r[1], r[0]))
    tagged = own.select(flag("doc_id", 7, 2).alias("held"), "text")
    order = spark.sparkContext.broadcast(word_order.model(tagged, code, total, training_words))

    # What is spelled: the words that the code lacks with all their uses, the others once each.
    spelled = counts.withColumn("n", F.when(in_code, F.least("n", F.lit(1).cast("bigint"))).otherwise(F.col("n")))
    parts = max(1, -(-(words or 0) // 400_000))
    logit, seen, *without = tables(spelled.withColumn("m", F.lit(0)).repartition(parts).sortWithinPartitions("word"), left_out=True)
    shared = spark.sparkContext.broadcast(tuple(without))  # tables of fixed size
    model = learned(Model(logit, seen), shared, spelled.withColumn("m", F.col("n")))
    shared.unpersist()
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.score([bytes(w) for w in batch.column(0).to_pylist()]))], names=["word", "n", "lm"])

    scored = staged(counts.where(~in_code).select("word", "n").mapInArrow(score, "word binary, n bigint, lm double"))
    shared.unpersist()
    known = {bytes(r[0]): (r[1], r[2]) for r in scored.where((F.col("n") >= frequent) & ~in_code).toLocalIterator()}
    common = spark.sparkContext.broadcast(known)  # at most most_frequent words

    def sum_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(common.value)}
        use = np.array([c for c, _ in common.value.values()] + [0], float)
        lm = np.array([x for _, x in common.value.values()] + [0.0])
        base, of_leaf = np.log10(use + 1), np.log10(np.append(order.value.code.uses[:-1], 0) + 1.0)
        trained = np.append(order.value.code.uses[:-1] > 0, False)
        none, escape = len(ids), order.value.code.escape
        get = ids.get
        for batch in slices(batches, 1 << 20):
            rid, word, n, sums, doc = [], [], [], [], []
            every = texts(batch)
            cut = [lm_words(text) for text in every]
            leaf, *before = order.value.code.tokens(cut)
            ends = np.cumsum([len(tokens) for tokens in cut])
            first = ends - [len(tokens) for tokens in cut]
            total = lambda x: np.add.reduceat(x, first).tolist()  # noqa: B023, E731  no text lacks its end
            given = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), every, cut, first.tolist(), total(trained[leaf].astype(float)), total(of_leaf[leaf]), total(order.value.score(leaf, *before)), strict=True)
            for i, d, text, tokens, lo, k, b, mixed in given:
                escaped = [tokens[j] for j in np.flatnonzero(leaf[lo : lo + len(tokens)] == escape).tolist()]
                at = np.array([get(w, none) for w in escaped], np.int64)
                rare = Counter([w for w, j in zip(escaped, at.tolist(), strict=True) if j == none])
                rid += [i] * (len(rare) + 1)
                word += [b" %d" % i, *rare]  # no word begins with a space: the row of sums meets none in the join
                n += [0, *rare.values()]
                doc += [d, *[None] * len(rare)]
                sums += [[float(len(tokens)), k + float((at != none).sum()), b + float(base[at].sum()), float(lm[at].sum()) + mixed, float(len(text))], *[None] * len(rare)]
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int32()), pa.array(sums, pa.list_(pa.float64())), pa.array(doc, pa.int64())], names=["rid", "word", "n", "sums", "doc_id"])

    tagged = own.withColumn("rid", F.monotonically_increasing_id())
    rows = tagged.select("rid", "doc_id", "text").mapInArrow(sum_common, "rid bigint, word binary, n int, sums array<double>, doc_id bigint")
    rest = scored.where(F.col("n") < frequent).select("word", F.col("n").alias("c"), "lm")
    met = rows.join(rest, "word", "left").groupBy("rid").agg(F.max("sums").alias("s"), F.max("doc_id").alias("doc_id"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("b"), F.sum(F.col("n") * F.coalesce("lm", F.lit(0.0))).alias("l"))
    s = lambda i: F.col("s")[i]
    score = s(3) + F.col("l")
    return met.select(
        "doc_id",
        flag("doc_id", 7, 2).alias("held_out"),
        s(0).cast("bigint").alias("n_tokens"),
        (s(1) + F.col("k")).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (s(2) + F.col("b") - s(0) * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / F.greatest(s(4), F.lit(1.0))).alias("bits_per_byte"),
    )
