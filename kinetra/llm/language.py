"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, which the forward algorithm gives in one pass; a text's is the product over its words.
The probabilities come from expectation maximisation: expected piece counts under the forward-backward algorithm over
the distinct words of a bounded sample of labelled documents, summed by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import crc_mod, durable, slices, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
SPACE = "▁"
#: A word of more letters is summed with a running window over its last columns; it is not kept among the known words.
LONGEST = 32
BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters, lower case. Fractions, superscripts and number forms are no letters, though they count as word characters."""
    lower = text.lower()
    found = LETTERS.findall(lower)
    if found and not "".join(found).isalpha():
        found = LETTERS.findall("".join(c if c.isalpha() else " " for c in lower))
    return found


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, with or without the mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in pieces if LETTERS.fullmatch(p.removeprefix(SPACE)) or p == SPACE)


class Pieces:
    """Finds the vocabulary's pieces at all places of many words at once, by rolling hashes."""

    def __init__(self, pieces: list[str]):
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        hashes = np.array([self._hash(c) for c in codes], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.longest = max((len(p) for p in pieces), default=1)
        self.size = len(pieces)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(hashes)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        h = np.uint64(7)
        with np.errstate(over="ignore"):
            for c in codes:
                h = h * BASE + c
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * SPREAD) >> np.uint64(42)

    def lattice(self, batch: list[str], mark: str = SPACE) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths (with the start mark), and for each piece length n the id of the piece at each place, or -1."""
        marked = [mark + w for w in batch]
        sizes = np.array([len(w) for w in marked])
        grid = np.zeros((len(batch), int(sizes.max())), np.uint64)
        grid[np.arange(grid.shape[1]) < sizes[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        found, h = [], np.full(grid.shape, 7, np.uint64)
        for n in range(1, min(self.longest, grid.shape[1]) + 1):
            h = h[:, : grid.shape[1] - n + 1] * BASE + grid[:, n - 1 :]
            ids = np.full(h.shape, -1, np.int32)
            hit = np.flatnonzero(self.seen[self._slot(h.ravel())])
            own = h.ravel()[hit]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            ids.ravel()[hit] = np.where(self.hashes[at] == own, self.ids[at], -1)
            found.append(ids)
        return sizes, found


def forward(pieces: Pieces, table: np.ndarray, batch: list[str]) -> np.ndarray:
    """log P(word) under each column of table (a row for each piece, the last for a letter without a piece)."""
    out = np.empty((len(batch), table.shape[1]))
    order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
    short = sum(len(w) <= LONGEST for w in batch)
    for start in range(0, short, 4096):
        part = order[start : min(start + 4096, short)]
        out[part] = np.log(_sums(pieces, table, [batch[i] for i in part])[0])
    for start in range(short, len(batch), 64):
        part = order[start : start + 64]
        out[part] = running_sums(pieces, table, [batch[i] for i in part])
    return out


def running_sums(pieces: Pieces, table: np.ndarray, batch: list[str], block: int = 2048) -> np.ndarray:
    """forward() of words of any length: only as many columns as the longest piece has letters are kept, scaled as they shrink,
    and the lattice is found a block of letters at a time, so that memory does not grow with the word."""
    marked = [SPACE + w for w in batch]
    sizes, reach = np.array([len(w) for w in marked]), pieces.longest
    out, logs = np.empty((len(batch), table.shape[1])), np.zeros((len(batch), table.shape[1]))
    window = [np.ones_like(logs)]  # sums up to the letters before, the nearest first
    for begin in range(0, int(sizes.max()), block):
        low = max(0, begin - reach + 1)
        here = np.flatnonzero(sizes > begin)
        _, found = pieces.lattice([marked[i][low : begin + block] for i in here], mark="")
        found[0] = np.where(found[0] < 0, pieces.size, found[0])
        for end in range(begin + 1, min(begin + block, int(sizes.max())) + 1):
            now = np.zeros_like(logs)
            for n in range(1, min(len(found), end, len(window)) + 1):
                if end - n - low >= 0:
                    ids = found[n - 1][:, end - n - low]
                    own = np.flatnonzero(ids >= 0)
                    now[here[own]] += window[n - 1][here[own]] * table[ids[own]]
            done = sizes == end
            out[done] = np.log(now[done]) + logs[done]
            window = [now, *window[: reach - 1]]
            if end % 16 == 0:
                top = np.maximum.reduce(window)
                top = np.where(top > 0, top, 1)
                logs += np.log(top)
                window = [w / top for w in window]
    return out


def _sums(pieces: Pieces, table: np.ndarray, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Totals over all segmentations; forward sums by place; lengths; the lattice."""
    sizes, found = pieces.lattice(batch)
    found[0] = np.where(found[0] < 0, pieces.size, found[0])
    width = int(sizes.max())
    sums = np.zeros((width + 1, len(batch), table.shape[1]))
    sums[0] = 1
    for end in range(1, width + 1):
        for n in range(1, min(len(found), end) + 1):
            ids = found[n - 1][:, end - n]
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                sums[end, rows] += sums[end - n, rows] * table[ids[rows]]
    return sums[sizes, np.arange(len(batch))], sums, sizes, found


def expected(pieces: Pieces, column: np.ndarray, batch: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, by the forward-backward algorithm."""
    long = [i for i, w in enumerate(batch) if len(w) > LONGEST]
    if long:
        short = [i for i, w in enumerate(batch) if len(w) <= LONGEST]
        out = expected(pieces, column, [batch[i] for i in short], counts[short]) if short else np.zeros(pieces.size + 1)
        for i in long:
            out += counts[i] * expected_long(pieces, column, batch[i])
        return out
    total, ahead, sizes, found = _sums(pieces, column[:, None], batch)
    total, ahead, width = total[:, 0], ahead[:, :, 0], int(sizes.max())
    behind = np.zeros((width + 1, len(batch)))
    behind[sizes, np.arange(len(batch))] = 1
    out = np.zeros(pieces.size + 1)
    for start in range(width - 1, -1, -1):
        for n in range(1, min(len(found), width - start) + 1):
            ids = found[n - 1][:, start]
            rows = np.flatnonzero((ids >= 0) & (start + n <= sizes))
            if len(rows):
                use = column[ids[rows]] * behind[start + n, rows]
                behind[start, rows] += use
                out += np.bincount(ids[rows], weights=ahead[start, rows] * use / total[rows] * counts[rows], minlength=len(out))
    return out


def expected_long(pieces: Pieces, column: np.ndarray, word: str) -> np.ndarray:
    """expected() of one word of any length, in logarithms."""
    (size,), found = pieces.lattice([word])
    ids = [f[0] for f in found]
    ids[0] = np.where(ids[0] < 0, pieces.size, ids[0])
    with np.errstate(divide="ignore"):
        logp = np.log(column)
    ahead, behind = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    ahead[0] = behind[size] = 0
    at = [[(n + 1, int(ids[n][i])) for n in range(len(ids)) if i < len(ids[n]) and ids[n][i] >= 0] for i in range(size)]
    for i in range(size):
        for n, k in at[i]:
            ahead[i + n] = np.logaddexp(ahead[i + n], ahead[i] + logp[k])
    out = np.zeros(pieces.size + 1)
    for i in range(size - 1, -1, -1):
        for n, k in at[i]:
            behind[i] = np.logaddexp(behind[i], logp[k] + behind[i + n])
            out[k] += np.exp(ahead[i] + logp[k] + behind[i + n] - ahead[size])
    return out


class Model:
    """Languages, the vocabulary and a column of piece probabilities for each language. Scores texts."""

    def __init__(self, langs: list[str], vocab: list[str], table: np.ndarray, cached: int = 300_000):
        self.langs, self.vocab, self.pieces, self.table, self.cached = langs, vocab, Pieces(vocab), table, cached
        self.cache: dict[str, int] = {}
        self.rows = np.empty((0, len(langs)))

    def score(self, batch: list[str]) -> list[tuple[str, float]]:
        """(language, posterior under equal priors) of each text; ('und', 0) without a letter or a learned language."""
        found = [words(t) for t in batch]
        if not self.langs:
            return [("und", 0.0)] * len(batch)
        far = list({w for ws in found for w in ws if len(w) > LONGEST})
        long = dict(zip(far, forward(self.pieces, self.table, far), strict=True)) if far else {}
        new = list({w for ws in found for w in ws if len(w) <= LONGEST and w not in self.cache})
        known = len(self.rows)
        rows = np.concatenate((self.rows, forward(self.pieces, self.table, new))) if new else self.rows
        self.cache.update(zip(new, range(known, known + len(new)), strict=True))
        out = []
        for ws in found:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = rows[[self.cache[w] for w in ws if w not in long]].sum(axis=0)
            if long:
                total = total + sum(long[w] for w in ws if w in long)
            share = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((self.langs[best], float(share[best] / share.sum())))
        if len(self.cache) <= self.cached:
            self.rows = rows
        else:  # what came first stays: it holds the frequent words
            for w in new:
                del self.cache[w]
        return out


def labelled_texts(docs: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """(lang and text, the languages) of about `most` documents a language among those with a lang whose crc32(doc_id) mod 3 is not 1, by hash of id
    and text: rows that repeat an id, or have none, are drawn each for itself."""
    labelled = docs.where(F.col("lang").isNotNull() & ~crc_mod("doc_id", 3).eqNullSafe(1)).select("doc_id", "lang", "text")
    share = {r[0]: min(1.0, most / r[1]) for r in labelled.groupBy("lang").count().collect()}
    if not share:
        return labelled.limit(0), []
    part = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * 1_000_000)))]), F.col("lang"))
    return labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < part), sorted(share)


def train(docs: DataFrame, path: str = VOCABULARY, most_docs: int = 2000, rounds: int = 3, smooth: float = 0.05) -> Model:
    """Learn from the rows with a lang whose crc32(doc_id) mod 3 is not 1: about most_docs a language, by hash of id."""
    spark, vocab = docs.sparkSession, vocabulary(path)
    picked, langs = labelled_texts(docs, most_docs)
    if not langs:
        return Model([], vocab, np.ones((len(vocab) + 1, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in slices(batches, 4 << 20):
            seen = Counter((lang, w) for lang, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for w in words(t.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    counted = durable(picked.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size = len(vocab)
    # The start: each piece in proportion to a geometric law of its length, the same in all languages.
    table = np.tile(np.array([[0.05 ** len(p) for p in vocab] + [1e-9]]).T, (1, len(langs)))
    table /= table.sum(axis=0)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((vocab, langs, table))  # the vocabulary's size times the languages

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            vocab, langs, table = held.value
            pieces, sums = Pieces(vocab), np.zeros((len(langs), len(vocab) + 1))
            for batch in batches:
                own, word, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
                at = np.array([langs.index(x) for x in own])
                for k in range(len(langs)):
                    rows = sorted(np.flatnonzero(at == k).tolist(), key=lambda i: len(word[i]))
                    for s in range(0, len(rows), 4096):
                        sums[k] += expected(pieces, table[:, k], [word[i] for i in rows[s : s + 4096]], n[rows[s : s + 4096]])
            ks, ps = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ps, pa.int32()), pa.array(sums[ks, ps])], names=["k", "p", "x"])

        got = counted.mapInArrow(expect, "k int, p int, x double").groupBy("k", "p").agg(F.sum("x").alias("x")).collect()
        table = np.full((size + 1, len(langs)), smooth)
        for k, p, x in got:
            table[p, k] += x
        table /= table.sum(axis=0)
    return Model(langs, vocab, table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; the language `und` (score 0) where no letter is to score.

    Whole texts are scored. Null and empty texts are `und`; a null doc_id is kept and not held out; repeated rows are
    scored each. Of languages that tie the first by code point is told. lang, source and doc_id are no inputs. An empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.vocab, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in slices(batches, 4 << 20):
            scored = own.score([t.decode("utf-8", "ignore") for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] for s in scored], pa.string()), pa.array([s[1] for s in scored], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str = VOCABULARY, most_docs: int = 2000) -> DataFrame:
    return predict(docs, train(docs, path, most_docs))


def language_stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is told with a posterior of `least` or more; und goes. No shuffle.

    Null and empty texts, and texts without a letter, go; a null id, a repeated row and columns of any name stay as
    they are. Without a learned language all rows go; an empty table gives no rows.
    """
    model = train(docs)
    held = spark.sparkContext.broadcast((model.langs, model.vocab, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in slices(batches, 4 << 20):
            scored = own.score([t.decode("utf-8", "ignore") for t in texts(batch)])
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in scored], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
