"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has 64 bits. Give bit i a non-zero vector m(i) of r+1 bits. For each non-zero vector v, a table keeps
the bits whose m(i) has odd inner product with v. Any r differing bits span at most r dimensions, so some v is
orthogonal to all of them: in that table the two fingerprints agree. 2**(r+1)-1 tables so catch every pair within r.

A table's bucket that is too large for one list is split by the same construction over the bits that its key left
free. After three levels seven bits at most are free, so that no bucket can hold more than 128 fingerprints: hot
groups are resolved exactly, without caps and without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import durable, part_by_keys, row_hash, slices, texts
from kinetra.llm.components import components

BITS = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles (repeats count); zero where there is no word."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (bigint) of each row; a null text counts as one without words."""

    schema = "doc_id bigint, " + "".join(f"{c} bigint, " for c in keep) + "fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32 << 20):
            fps = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=["doc_id", *keep, "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def covering_masks(free: list[int], radius: int) -> list[int]:
    """The 2**(radius+1)-1 masks over the given bit positions."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        out.append(sum(1 << bit for j, bit in enumerate(free) if ((j % n + 1) & v).bit_count() % 2))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _deeper(masks: list[int], radius: int) -> list[tuple[int, int]]:
    """(table, mask) for each table of the next level under each mask."""
    return [(t, mask | m) for t, mask in enumerate(masks) for m in covering_masks([b for b in range(BITS) if not mask >> b & 1], radius)]


def _spanning(radius: int):
    """Rows of lists of fingerprints -> (u, v): each member to the least member that it reaches within its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for values in batch.column(0).to_pylist():
                fps = np.unique(np.array(values, np.int64))
                bits, open_ = fps.view(np.uint64), np.ones(len(fps), bool)
                for i in range(len(fps)):
                    if not open_[i]:
                        continue
                    open_[i], todo = False, [i]
                    while todo:
                        near = np.flatnonzero(open_ & (np.bitwise_count(bits ^ bits[todo.pop()]) <= radius))
                        open_[near] = False
                        todo += near.tolist()
                        us += fps[near].tolist()
                        vs += [int(fps[i])] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def links(fps: DataFrame, radius: int = 3, most: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that join all pairs within radius into the same components.

    A bucket of up to `most` members is one list; larger ones go a level deeper over the bits left free.
    """
    spark, masks = fps.sparkSession, covering_masks(list(range(BITS)), radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    found = None
    for level in range(3):
        sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = keyed.join(sizes, ["t", "key"])
        last = level == 2
        small = sized if last else sized.where(F.col("n") <= most)
        edges = small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_spanning(radius), "u bigint, v bigint")
        found = edges if found is None else found.union(edges)
        if last or not (hot := durable(sized.where(F.col("n") > most).select("t", "fp"))).take(1):
            return found
        deeper = _deeper(masks, radius)
        level_masks = F.broadcast(spark.createDataFrame([(t, i, _signed(m)) for i, (t, m) in enumerate(deeper)], "t int, t2 int, mask bigint"))  # 15 or 225 times 15 rows, whatever the data
        keyed = hot.join(level_masks, "t").select("fp", F.col("t2").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        masks = [m for _, m in deeper]
    return found


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp, ...) with the root of their component."""
    roots = components(links(distinct.select("fp"), radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and word-less texts have fingerprint zero and link like any other. Rows that repeat a doc_id each get a row.
    A null doc_id never names a component unless all ids of the component are null; then component_id is null.
    Only doc_id and text are read. An empty table gives no rows.
    """
    prints = durable(fingerprints(docs, words))
    rooted = _rooted(durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))), radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component exactly one row stays, the least by (doc_id, hash of the row), null ids last.

    Rows are told apart by id and hash, so that rows that repeat an id, or have none, are each decided by their own
    component. Rows equal in all columns shrink to one. Null and empty texts are one component; other columns pass
    through whatever their names, inside the row, and so cannot meet this stage's own. No rows give no rows.
    """
    own = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_id"), row_hash(docs).alias("_h"))
    rows = durable(fingerprints(own, keep=("_id", "_h")).groupBy("doc_id", "_id", "_h", "fp").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")
    rooted = durable(_rooted(durable(rows.groupBy("fp").agg(F.min(order).alias("least"))), 3))
    named = rooted.groupBy("root").agg(F.min("least").alias("stays"))
    told = rows.join(rooted.join(named, "root").select("fp", "stays"), "fp").select("_id", "_h", "n", order.eqNullSafe(F.col("stays")).alias("stays"))
    told = durable(told.where("not stays or n > 1"))
    gone = told.where("not stays").select("_id", "_h")
    may, never = part_by_keys(own, F.col("_h"), told, F.col("_h"))
    left = may.join(gone, ["_id", "_h"], "left_anti")
    if told.where("stays").take(1):
        left = left.dropDuplicates(["_id", "_h"])
    return never.select("row").unionByName(left.select("row")).select("row.*")
