"""Removal of long byte strings that occur twice: merged Burrows-Wheeler transforms of shards.

1. Anchors. In each window of `length` bytes the least of a keyed order of k-byte strings names an anchor, leftmost
   first. Equal windows have equal anchors at equal offsets, so that windows need to meet only under one anchor hash.
   A run of windows with one anchor is a context: an anchor, an offset and at most 2 * length bytes.
2. Contexts whose anchor occurs once are done. Identical contexts fold into one with a multiplicity.
3. The folded contexts of an anchor meet in one bucket. There each context is read as strings of `block`-byte symbols,
   one string for each phase, so that length / block symbols decide a window. Shards of the bucket sort their own
   suffixes and give their transform; the transforms are merged by iterative interleave refinement, each round a
   stable deal of the interleave by the symbols before its suffixes, and each round adds one symbol to the common
   prefixes. Intervals whose common prefix is a whole window and that hold two windows are repeated. The same common
   prefixes tell repeated strings of a second, greater length (the reach), as contexts hold their bytes too.
4. Repeated windows go back to all documents that have the context, and their bytes are removed.

An anchor with very many different contexts (a common short string or passage) is dealt on by longer cores of its
windows, in cells that fold by their bytes; a core with very many different cells is decided by single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import durable, part_by_keys, slices, staged, texts

GRAM = 64
PIECE = 4 << 20
#: Odd multipliers with well-mixed bits (fixed values).
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _words(data: np.ndarray, n: int, at: int) -> np.ndarray:
    """The n little-endian 64-bit words that begin at each byte from `at` on."""
    return np.ndarray((n,), "<u8", data, at, (1,))


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` keys the least (keys are distinct): block-wise running minima from both ends."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def windows_by_anchor(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """part, first window, number of windows and anchor position (both in the part) of each context of the parts."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts) + bytes(32), np.uint8)
    total, empty = int(sizes.sum()), np.empty(0, np.int64)
    n = total - GRAM + 1
    if n < length - GRAM + 1:
        return empty, empty, empty, empty
    keys = _words(data, n, 0) * MIX_A
    keys ^= keys >> np.uint64(29)
    keys += _words(data, n, 11) * MIX_B
    keys *= MIX_C
    keys = (keys & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)  # 40 bits of order, then the position
    least = (_sliding_argmin(keys, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    # A run also ends where the windows reach past their part; runs of one anchor lie in its part, so cut at that end.
    part = np.searchsorted(ends, least[change], side="right")
    until = np.concatenate((change[1:], [len(least)]))
    begin = np.maximum(change, ends[part] - sizes[part])
    until = np.minimum(until, ends[part] - length + 1)
    good = until > begin
    part, begin, until, anchor = part[good], begin[good], until[good], least[change][good]
    base = ends[part] - sizes[part]
    return part, begin - base, until - begin, anchor - base


def contexts(docs: DataFrame, length: int, reach: int | None = None) -> DataFrame:
    """id, h (row key), anchor, ctx (hashes), a (first window), n (windows), off (anchor's offset in it), m (bytes).

    A context's bytes go on to the end of the string of `reach` bytes that begins at its last window, or to the text's
    end: its windows of `length` bytes are decided by them, and so are strings of `reach` bytes that begin there.
    """
    reach = reach or length
    schema = "id bigint, h bigint, anchor bigint, ctx bigint, a bigint, n int, off int, m int"

    def rows(owner: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
        part, begin, n, at = windows_by_anchor(parts, length)
        digest, mask = xxhash.xxh3_64_intdigest, (1 << 64) - 1
        anchor, ctx, m = [], [], []
        for p, b, k, x in zip(part.tolist(), begin.tolist(), n.tolist(), at.tolist(), strict=True):
            whole, s = owner[p][3], owner[p][2]
            piece = whole[s + b : s + b + k + reach - 1]
            anchor.append(digest(whole[s + x : s + x + GRAM]))
            ctx.append(digest(piece, (x - b) << 32 | k) & mask)
            m.append(len(piece))
        own = [np.array([o[i] for o in owner], np.int64)[part] if owner else np.empty(0, np.int64) for i in range(3)]
        columns = [own[0], own[1], np.array(anchor, np.uint64).view(np.int64), np.array(ctx, np.uint64).view(np.int64), own[2] + begin, n.astype(np.int32), (at - begin).astype(np.int32), np.array(m, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "h", "anchor", "ctx", "a", "n", "off", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, parts, held = [], [], 0
        for batch in slices(batches, 1 << 20):
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
                for s in range(0, max(len(text) - length + 1, 0), PIECE):  # windows of long texts come in pieces
                    piece = text[s : s + PIECE + length - 1]
                    if held and held + len(piece) > (2 << 20):
                        yield rows(owner, parts)
                        owner, parts, held = [], [], 0
                    owner.append((i, h, s, text))
                    parts.append(piece)
                    held += len(piece)
        if parts:
            yield rows(owner, parts)

    return docs.select("id", "h", "text").mapInArrow(run, schema)


def stable_order(ranks: np.ndarray) -> np.ndarray:
    """Stable order of small integers: 16 bits at a time go by counting."""
    order = np.argsort(ranks.astype(np.uint16), kind="stable")  # the low bits
    if ranks.dtype.itemsize > 2:
        order = order[np.argsort((ranks[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def shard_transform(symbols: np.ndarray, following: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of one shard in order of their first `depth` symbols, and the symbol before each: its transform."""
    ahead = [symbols]
    for _ in range(depth - 1):
        ahead.append(ahead[-1][following])
    order = stable_order(ahead[-1])
    for each in reversed(ahead[:-1]):
        order = order[stable_order(each[order])]
    return order, symbols[before[order]]


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (a shard for each suffix of the merged order) and the common prefix with the one before.

    Round t deals the interleave out by the symbol before each suffix, in a stable way: what was right for t symbols
    becomes right for t + 1. Neighbours share a further symbol where their symbol is the same and their sources were in
    one interval of the last round. No suffix is compared or sorted anew.
    """
    interleave = np.repeat(np.arange(len(transforms), dtype=np.int8), [len(t) for t in transforms])
    interval, common = np.zeros(len(interleave), np.int32), np.zeros(len(interleave), np.int8)
    symbols, same = np.empty(len(interleave), transforms[0].dtype), np.zeros(len(interleave), bool)
    for _ in range(depth):
        for j, transform in enumerate(transforms):
            symbols[interleave == j] = transform
        deal = stable_order(symbols)
        interleave, dealt, source = interleave[deal], symbols[deal], interval[deal]
        same[1:] = (dealt[1:] == dealt[:-1]) & (source[1:] == source[:-1])
        common += same
        interval = np.cumsum(~same, dtype=np.int32)
    return interleave, common


def block_of(*lengths: int) -> int:
    """The largest symbol that divides all lengths: of 8 bytes at least, and of so many that 100 symbols make the longest."""
    for block in range(min(100, *lengths), 7, -1):
        if not any(x % block for x in lengths) and max(lengths) // block <= 100:
            return block
    raise ValueError(f"lengths {lengths} have no common divisor from 8 to 100 bytes")


def _hashes(data: np.ndarray, n: int, block: int) -> np.ndarray:
    """Odd hashes of the `block` bytes (8 at least) from each of the first n bytes on, by doubling the size hashed."""
    size, out = 8, _words(data, n + block - 8, 0) * MIX_A

    def joined(step: int) -> np.ndarray:
        first = out[:-step] if step else out
        both = first >> np.uint64(31)
        both ^= first
        both *= MIX_B
        both += out[step:]
        both ^= both >> np.uint64(29)
        both *= MIX_A
        return both

    while size * 2 <= block:
        out, size = joined(size), size * 2
    return joined(block - size)[:n] | np.uint64(1)


def repeated_windows(strings: list[bytes], windows: np.ndarray, weight: np.ndarray, lengths: tuple[int, ...], block: int, shards: int = 2) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the lengths, runs (string, from, until) of positions among the first windows[i] of each string that
    begin a string of that many bytes which occurs twice (by weight) among all. Strings of a weight of two are left out:
    they repeat as a whole.

    block divides all lengths; one merge serves them, since common prefixes tell all depths. Symbols are ranks of
    64-bit hashes of `block` bytes; the least ends a string.
    """
    if any(x % block for x in lengths):
        raise ValueError(f"symbols of {block} bytes do not divide {lengths}")
    if not strings:
        return [(np.empty(0, np.int64),) * 3 for _ in lengths]
    sizes = np.array([len(s) for s in strings], np.int64)
    slots = sizes + 1  # positions 0 to size; the last `block` of them end the string of their phase
    data = np.frombuffer(b"\0".join(strings) + bytes(block + 16), np.uint8)
    total = int(slots.sum())
    starts = np.cumsum(slots) - slots
    own = np.repeat(np.arange(len(strings), dtype=np.int32), slots)
    here = np.arange(total, dtype=np.int32)
    local, size = here - starts.astype(np.int32)[own], sizes.astype(np.int32)[own]
    symbols = _hashes(data, total, block)
    inside = local + block <= size
    symbols[~inside] = 0
    ranks = np.unique(symbols, return_inverse=True)[1]
    ranks = ranks.astype(np.uint16 if total <= 0xFFFF else np.uint32)
    following = np.where(inside, here + block, here - local + local % block)
    before = np.where(local >= block, here - block, here + block * ((size - local) // block))
    depth = max(lengths) // block
    cuts = np.unique(np.searchsorted(starts, np.linspace(0, total, shards + 1)[1:-1]))
    bounds = [0, *[int(starts[c]) for c in cuts if 0 < c < len(strings)], total]
    orders, transforms = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        order, transform = shard_transform(ranks[lo:hi], following[lo:hi] - lo, before[lo:hi] - lo, depth)
        orders.append(order + lo)
        transforms.append(transform)
    interleave, common = merge_transforms(transforms, depth)
    merged = np.empty(total, np.int32)
    for j, order in enumerate(orders):
        merged[interleave == j] = order
    out = []
    for length in lengths:
        window = (local < windows[own]) & (local + length <= size)
        interval = np.cumsum(common < length // block, dtype=np.int32) - 1
        held = np.bincount(interval, weights=np.where(window, weight[own], 0)[merged])  # sums of whole numbers
        flags = np.zeros(total, bool)
        flags[merged] = held[interval] >= 2
        flags &= window & (weight[own] < 2)
        lo, hi = _runs(flags)  # no run goes on into the next string: no window begins at the end of one
        out.append((own[lo], local[lo], hi - lo + local[lo]))
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


CELL = 8


DEALT = "id bigint, h bigint, anchor bigint, ctx bigint, c bigint, key bigint, cell bigint, far bigint, shift int, a bigint, n int, m int"


def _deal(length: int, reach: int, size: int):
    """Documents with the contexts asked of them -> DEALT: each context's runs of `size` windows at equal distance from the anchor.

    key: the hash of the bytes that all windows of a run share, cell: that of all its bytes (of one window alone: of
    its `length` bytes, far: of `reach` bytes, null where the text ends before). No bytes are sent.
    """
    names = [c.split()[0] for c in DEALT.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, signed = xxhash.xxh3_64_intdigest, lambda x: x - (1 << 64) if x >> 63 else x
        for batch in slices(batches, 8 << 20):
            out: list[tuple] = []
            for i, h, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), batch.column(3).to_pylist(), strict=True):
                for x in asked:
                    a, n, off = x["a"], x["n"], x["off"]
                    for cell in range(-off // size, (n - 1 - off) // size + 1):
                        lo, hi = max(0, cell * size + off), min(n, (cell + 1) * size + off)
                        p, m = a + off + cell * size, min(hi - lo + reach - 1, x["m"] - lo)
                        core = digest(text[p + size - 1 : p + length], cell & 0xFFFFFFFF)
                        whole = digest(text[a + lo : a + lo + (m if size > 1 else length)], hi - lo)
                        far = signed(digest(text[a + lo : a + lo + reach])) if size == 1 and m >= reach else None
                        out.append((i, h, x["anchor"], x["ctx"], x["c"], signed(core), signed(whole), far, lo, a + lo, hi - lo, m))
                    if len(out) > 16384:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    return run


def _fetch():
    """Documents with the contexts and cells asked of them -> anchor, ctx, dealt, n, c, bytes of each."""
    names, types = ["anchor", "ctx", "dealt", "n", "c", "bytes"], [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            out: list[tuple] = []
            for text, asked in zip(texts(batch), batch.column(3).to_pylist(), strict=True):
                out += [(x["anchor"], x["ctx"], x["dealt"], x["n"], x["c"], text[x["a"] : x["a"] + x["m"]]) for x in asked]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return run


def _asked_of(docs: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """id, h, text, asked (structs of the columns) of the rows of docs that something is asked of."""
    by_doc = asked.groupBy("id", "h").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    may, _ = part_by_keys(docs, F.col("h"), asked, F.col("h"))
    return may.join(by_doc, ["id", "h"]).select("id", "h", "text", "asked")


def _spread(cells: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells folded by their bytes, with summed c: those of (all keys, keys of 2 to `most` different cells, keys of more)."""
    folded = durable(cells.groupBy("key", "cell").agg(F.sum("c").alias("c"), F.min(F.struct("id", "h", "a", "n", "m")).alias("one")))
    mixed = durable(folded.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"))
    met = durable(folded.join(mixed, "key").select(F.col("key").alias("anchor"), F.col("cell").alias("ctx"), "c", "one.*", "k"))
    return folded, met.where(F.col("k") <= most).drop("k"), met.where(F.col("k") > most).drop("k")


def _whole(folded: DataFrame, reach: int) -> list[DataFrame]:
    """Marks of what occurs twice as a whole: all its windows, and those that begin a string of `reach` bytes (far)."""
    run = lambda n: (F.lit(0).cast("bigint").alias("lo"), n.cast("bigint").alias("hi"))
    twice, far = folded.where("c > 1"), F.least(F.col("one.n"), F.col("one.m") - reach + 1)
    return [twice.select("anchor", "ctx", F.lit(False).alias("far"), *run(F.col("one.n"))), twice.where(far > 0).select("anchor", "ctx", F.lit(True).alias("far"), *run(far))]


def merged_strings(docs: DataFrame, asked: DataFrame, length: int, reach: int, most: int) -> tuple[DataFrame, int, DataFrame | None, DataFrame | None]:
    """(strings to merge, about how many, cells of hot anchors or None, marks of these cells that need no merge or None).

    No anchor and no key has more than `most` strings, whatever its documents: contexts of hot anchors are dealt into
    cells, which fold by their bytes; keys with still more different cells are decided by single windows.
    """
    few = asked.where("not hot").select("anchor", "ctx", "c", "id", "h", "a", "n", "m", F.lit(False).alias("dealt"))
    cells = marks = None
    hot = asked.where("hot")
    if hot.take(1):
        cells = durable(_asked_of(docs, hot, "anchor", "ctx", "c", "a", "n", "off", "m").mapInArrow(_deal(length, reach, CELL), DEALT))
        folded, some, wide = _spread(cells, most)
        few = few.unionByName(some.withColumn("dealt", F.lit(True)))
        near, far = _whole(folded.select(F.col("key").alias("anchor"), F.col("cell").alias("ctx"), "c", "one"), reach)
        marks = near.unionByName(far)
        if wide.take(1):
            single = durable(_asked_of(docs, wide.withColumn("off", F.lit(0)), "anchor", "ctx", "c", "a", "n", "off", "m").mapInArrow(_deal(length, reach, 1), DEALT))
            for key, is_far in (("cell", False), ("far", True)):
                twice = single.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("c").alias("k")).where("k > 1").select(key)
                found = single.where("c = 1").join(twice, key)
                marks = marks.unionByName(found.select("anchor", "ctx", F.lit(is_far).alias("far"), F.col("shift").cast("bigint").alias("lo"), (F.col("shift") + 1).cast("bigint").alias("hi")))
    n = few.count()
    strings = _asked_of(docs, few, "anchor", "ctx", "dealt", "c", "a", "n", "m").mapInArrow(_fetch(), "anchor bigint, ctx bigint, dealt boolean, n int, c bigint, bytes binary")
    return strings, n, cells, marks


#: Positions that one merge holds, unless one anchor has more: ranks of symbols then have 16 bits.
AT_ONCE = 60_000


def repeated(docs: DataFrame, length: int = 400, reach: int | None = None, bucket: int = 1000, most: int = 1000) -> DataFrame:
    """id, h, spans (s, e, far: from, until) of bytes in repeated strings, of the rows of docs that have any.

    docs: id, h, text. far: of strings of `reach` bytes (a multiple of the symbol that divides length), else of
    `length` bytes; both come from one merge. bucket: contexts a bucket holds; most: contexts of one anchor before it
    is dealt by cores, and different cells of one core before they are decided by windows.
    """
    reach = reach or length
    lengths = (length, reach) if reach > length else (length,)
    block = block_of(*lengths)
    occurrences = staged(contexts(docs, length, reach))
    twice = durable(occurrences.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))  # plain shuffles on both sides let Spark split hot anchors
    kept = durable(part_by_keys(occurrences, F.col("anchor"), twice, F.col("anchor"))[0].join(twice, "anchor"))
    folded = durable(kept.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "a", "n", "off", "m")).alias("one")))
    mixed = durable(folded.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    asked = durable(folded.join(mixed, "anchor").select("anchor", "ctx", "c", "one.*", (F.col("k") > most).alias("hot")))
    strings, n, cells, dealt_marks = merged_strings(docs, asked, length, reach, most)

    def merge(got: pa.Table) -> pa.Table:
        got = got.sort_by("anchor")
        c, n = got.column("c").to_numpy(), got.column("n").to_numpy().astype(np.int64)
        strings, anchor = got.column("bytes").to_pylist(), got.column("anchor").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))  # equal strings have equal anchors: parts of whole anchors are merged apart
        cost = np.add.reduceat(np.array([len(s) + 1 for s in strings]), first)
        parts, held = [0], 0
        for at, k in zip(first.tolist(), cost.tolist(), strict=True):
            if held and held + k > AT_ONCE:
                parts.append(at)
                held = 0
            held += k
        rows: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for begin, end in zip(parts, [*parts[1:], len(strings)], strict=True):
            for far, (own, lo, hi) in enumerate(repeated_windows(strings[begin:end], n[begin:end], c[begin:end], lengths, block)):
                for column, x in zip(rows, (own + begin, np.full(len(own), far), lo, hi), strict=True):
                    column.append(x)
        own, far, lo, hi = (np.concatenate(column) for column in rows)
        out = got.select(["anchor", "ctx", "dealt"]).take(pa.array(own))
        return out.append_column("far", pa.array(far > 0)).append_column("lo", pa.array(lo)).append_column("hi", pa.array(hi))

    buckets = strings.withColumn("bucket", F.pmod("anchor", F.lit(max(1, -(-n // bucket)))))
    found = buckets.groupBy("bucket").applyInArrow(merge, "anchor bigint, ctx bigint, dealt boolean, far boolean, lo bigint, hi bigint")
    # A folded context is repeated as a whole; the merge adds the windows of the others.
    near, far = _whole(folded, reach)
    marks = near.unionByName(far) if reach > length else near
    if cells is None:
        marks = marks.unionByName(found.drop("dealt"))
    else:
        found = durable(found)
        marks = marks.unionByName(found.where("not dealt").drop("dealt"))
        told = dealt_marks.unionByName(found.where("dealt").drop("dealt")).select(F.col("anchor").alias("key"), F.col("ctx").alias("cell"), F.col("far").alias("_far"), "lo", "hi")
        moved = lambda c: F.col(c) + F.col("shift")
        marks = marks.unionByName(cells.where("c = 1").drop("far").join(told, ["key", "cell"]).select("anchor", "ctx", F.col("_far").alias("far"), moved("lo").alias("lo"), moved("hi").alias("hi")))
    if reach == length:
        marks = marks.where("not far")
    size = F.when(F.col("far"), reach).otherwise(length)
    at = kept.join(durable(marks), ["anchor", "ctx"])
    spans = at.select("id", "h", F.struct((F.col("a") + F.col("lo")).alias("s"), (F.col("a") + F.col("hi") + size - 1).alias("e"), "far").alias("w"))
    return durable(spans.groupBy("id", "h").agg(F.collect_list("w").alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (with id, h) and their spans, null where there are none. Only rows that may have spans are shuffled."""
    may, never = part_by_keys(docs, F.col("h"), spans, F.col("h"))
    return may.join(spans, ["id", "h"], "left").unionByName(never.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with id and h: rows that agree in both have the same id and text, and so the same bytes to remove."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "h": F.xxhash64("doc_id", "text")})


def merged_spans(spans, far: bool = False) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one: of strings of the reach (far), or of the length. spans: rows, or None."""
    if not spans:
        return []
    return merged(*(np.array([x[k] for x in spans]) for k in ("s", "e", "far")), far)


def merged(s: np.ndarray, e: np.ndarray, kind: np.ndarray, far: bool) -> list[tuple[int, int]]:
    own = kind == far
    s, e = s[own], e[own]
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    first = np.flatnonzero(np.concatenate((np.ones(min(len(s), 1), bool), s[1:] > e[:-1])))
    return list(zip(s[first].tolist(), e[np.append(first[1:], len(s))[: len(first)] - 1].tolist(), strict=True))


def spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """s, e, far of each row's spans, None where there are none."""
    flat = column.flatten()
    s, e, far = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    at = 0
    for n in sizes:
        yield (s[at : at + n], e[at : at + n], far[at : at + n]) if n else None
        at += n


def passages(text: bytes, spans: list[tuple[int, int]], words: int, length: int) -> list[tuple[int, int]]:
    """Spans of more than `words` words, or of `length` bytes."""
    return [(s, e) for s, e in spans if e - s >= length or len(text[s:e].split()) > words]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


#: A repeated passage of more than WORDS words counts as one whatever its bytes; PASSAGE: bytes that any such has.
WORDS, PASSAGE = 50, 240


def suffix_dedup(docs: DataFrame, length: int = 400, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes.

    A byte is removed if a string of `length` bytes that covers it starts at another place too, in this or another
    document. n_passage_bytes counts, beside that, the bytes of repeated passages of more than `words` words (runs
    covered by repeated strings of `passage` bytes) or of `length` bytes: passages of short words do not reach `length`.
    Null texts are empty; texts shorter than passage lose nothing; equal rows lose all of their long text.
    A null doc_id is kept. Other columns are not read. An empty table gives no rows.
    """
    own = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    spans = repeated(own.select("id", "h", "text"), passage, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            out = []
            for text, found in zip(texts(batch), spans_of(batch.column(2)), strict=True):
                cuts = merged(*found, True) if found else []
                told = passages(text, merged(*found, False), words, length) if found else []
                out.append((len(text), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(cut(text, cuts)).hexdigest(), sum(e - s for s, e in told)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    joined = with_spans(own, spans).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint")


def suffix_stage(spark, docs: DataFrame, sf_dir: str, passage: int = PASSAGE, words: int = WORDS, length: int = 400) -> DataFrame:
    """Pipeline stage: docs with repeated passages cut out of text: runs of bytes that strings of `passage` bytes cover
    which start at another place too, where a run has more than `words` words or `length` bytes.

    A passage goes at all its places: verbatim runs of that length are boilerplate or what near copies share, no place
    is its source, and no cut depends on another document's. Shorter runs stay. Equal rows lose their long texts whole.
    What a cut leaves of a split character is dropped; n_chars, where docs has it, follows the new text. Rows whose
    whole text was removed go; null and empty texts, null ids and other columns stay as they are. No rows give no rows.
    """
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("h"))
    spans = repeated(own.select("id", "h", "text"), passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            columns = dict(zip(names, batch.column(0).flatten(), strict=True))
            old = texts(batch)
            new = [cut(t, passages(t, merged(*s, False), words, length)) if s else t for t, s in zip(old, spans_of(batch.column(2)), strict=True)]
            missing = batch.column(1).is_null().to_pylist()
            new_text = [None if m else t.decode("utf-8", "ignore") for t, m in zip(new, missing, strict=True)]
            columns["text"] = pa.array(new_text, columns["text"].type)
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                n = [len(t) if t is not None and a != b else x for t, a, b, x in zip(new_text, old, new, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            rows = pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
            yield rows.filter(pa.array([bool(b) or not a for a, b in zip(old, new, strict=True)], pa.bool_()))

    return with_spans(own, spans).select("row", "text", "spans").mapInArrow(run, docs.schema)
