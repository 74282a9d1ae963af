"""The prefix trie of conversations by truncation peeling.

A turn becomes a digest of its role and text, and a conversation the list of its turns' chained digests: the d-th stands
for the first d turns. Peeling goes down from the greatest depth. At each depth the conversations that end there join
the nodes that survived from below, and grouping gives the depth's nodes with everything told of their subtrees; each
node then loses its last turn and survives, under its parent's digests, into the next depth. No pair of conversations is
ever compared, and a group of equal conversations is one row before the peeling begins.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import WORD, durable, shared_folder, staged

KEY_BYTES = 16
LINK = "array<struct<key: binary, words: bigint>>"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(convs: DataFrame) -> DataFrame:
    """conv_id, turn, key (of role and text), words (in the text) of each row with a conv_id; a null role or text is empty.

    Texts go no further than this.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = convs.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    return rows.where("conv_id is not null")


def sequences(digests: DataFrame, near: int | None = None) -> DataFrame:
    """conv_id and its turns in order (null first, equal turns by digest): array of (key, words).

    near: conversations of one block of so many ids come to one partition, under `block`, their least id.
    """
    block = F.col("conv_id") - (F.col("conv_id") % near if near else 0)
    rows = digests.withColumn("block", block).repartition("block")
    turns = F.sort_array(F.collect_list(F.struct("turn", "key", "words")))
    return rows.groupBy("block", "conv_id").agg(F.transform(turns, lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def spliced(digests: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Sequences in which conversation c begins with the first h turns of conversation c - c % every; its own follow from the
    h-th on. h is crc32(c) % most. Remainders have the sign of c, as in SQL. A block's conversations meet by one shuffle."""
    rows = sequences(digests, every)
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, most))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rows = rows.withColumn("head", F.coalesce(head, F.array().cast(LINK))).withColumn("h", h)
    return rows.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns") + 1)).alias("turns"))


def chained(seqs: DataFrame) -> DataFrame:
    """conv_id, chain: the turns with keys that stand for all turns up to their own."""
    nothing = F.array().cast(LINK)

    def link(chain, turn):
        before = F.coalesce(F.get(chain, F.size(chain) - 1)["key"], F.unhex(F.lit("")))
        key = F.substring(F.unhex(F.sha2(F.concat(before, turn["key"]), 256)), 1, KEY_BYTES)
        return F.concat(chain, F.array(F.struct(key.alias("key"), turn["words"].alias("words"))))

    return seqs.select("conv_id", F.aggregate("turns", nothing, link).alias("chain"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tip, conv_id) in order -> (tip, first, n, ids): comma-joined ids of a stretch of one tip, some 64 k of them."""
    tip, ids, out = None, [], []

    def cut():
        if ids:
            out.append((tip, ids[0], len(ids), ",".join(map(str, ids)).encode()))
            ids.clear()

    def told():
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tip", "first", "n", "ids"])
        out.clear()
        return rows

    for batch in batches:
        for t, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t != tip or len(ids) >= 1 << 16:
                cut()
                tip = t
            ids.append(i)
        if len(out) >= 4096 or sum(x[2] for x in out) >= 1 << 18:
            yield told()
    cut()
    if out:
        yield told()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tip, first, n, ids) in order -> (least, n_convs, ends_sha256) of each tip: its pieces are fed to one digest."""
    tip, state, least, n, out = None, None, 0, 0, []
    for batch in batches:
        for t, first, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or t != tip:
                if state is not None:
                    out.append((least, n, state.hexdigest()))
                tip, state, least, n = t, hashlib.sha256(ids), first, m
            else:
                state.update(b"," + ids)
                n += m
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["least", "n_convs", "ends_sha256"])
            out = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([n]), pa.array([state.hexdigest()])], names=["least", "n_convs", "ends_sha256"])


def ended(chains: DataFrame) -> DataFrame:
    """One row for each distinct sequence: chain, conv_id (the least), n_convs, ends_sha256 (of the ids, ascending).

    Ids are put in order across tasks by (last key, id), so that a sequence that many conversations share is dealt over many;
    its digest reads a row for some 64 k ids.
    """
    chains = durable(chains)
    tip = F.coalesce(F.get("chain", F.size("chain") - 1)["key"], F.unhex(F.lit("")))
    ids = chains.select(tip.alias("tip"), "conv_id").repartitionByRange("tip", "conv_id").sortWithinPartitions("tip", "conv_id")
    pieces = ids.mapInArrow(_pieces, "tip binary, first bigint, n bigint, ids binary")
    groups = pieces.repartition("tip").sortWithinPartitions("tip", "first").mapInArrow(_digests, "least bigint, n_convs bigint, ends_sha256 string")
    return chains.join(groups, chains.conv_id == groups.least).select("conv_id", "chain", "n_convs", "ends_sha256", F.size("chain").alias("depth"))


def _anchors(ends: DataFrame, most_rows: int, most_levels: int) -> DataFrame:
    """conv_id, anchor, above: the shallowest of the depths 1, 2, 4, ... at which the sequence's subtree is small, if any.

    Small: most_rows sequences and most_levels turns below that depth, or a single sequence. What lies in a small subtree is small
    itself, so that all sequences of a subtree name the same anchor.
    """
    powers = F.sequence(F.lit(0), F.floor(F.log2(F.col("depth") - 1)).cast("int"))
    tried = ends.where("depth > 1").select("conv_id", "chain", "depth", F.explode(F.transform(powers, lambda k: F.pow(F.lit(2), k).cast("int"))).alias("above"))
    tried = durable(tried.select("conv_id", F.get("chain", F.col("above") - 1)["key"].alias("anchor"), "above", (F.col("depth") - F.col("above")).alias("levels")))
    sizes = tried.groupBy("anchor", "above").agg(F.count(F.lit(1)).alias("n"), F.sum("levels").alias("m"))
    small = sizes.where((F.col("n") == 1) | ((F.col("n") <= most_rows) & (F.col("m") <= most_levels))).select("anchor", "above")
    return tried.join(small, ["anchor", "above"]).groupBy("conv_id").agg(F.min(F.struct("above", "anchor")).alias("a")).select("conv_id", "a.anchor", "a.above")


NODE = "conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, depth int"
LINKS = pa.list_(pa.struct([("key", pa.binary()), ("words", pa.int64())]))


def _peel(got: pa.Table) -> pa.Table:
    """The nodes of one small subtree, deepest first, and the row with which it survives at its anchor's depth."""
    got = got.combine_chunks()
    chains, above = got.column("chain").combine_chunks(), got.column("above")[0].as_py()
    flat = chains.flatten()
    keys, words = flat.field("key").to_pylist(), flat.field("words").to_pylist()
    depths = got.column("depth").to_pylist()
    starts = [0]
    for d in depths:
        starts.append(starts[-1] + d)
    ended_at: dict[int, list[int]] = {}
    for i, d in enumerate(depths):
        ended_at.setdefault(d, []).append(i)
    ids, counts, digests = (got.column(c).to_pylist() for c in ("conv_id", "n_convs", "ends_sha256"))
    out: list[tuple] = []
    now: dict[bytes, list] = {}
    for depth in range(max(depths), above - 1, -1):
        for i in ended_at.get(depth, []) if depth > above else []:
            node = now.setdefault(keys[starts[i] + depth - 1], [i, ids[i], 0, 0, 0, 0, None])
            node[1], node[2], node[6] = min(node[1], ids[i]), node[2] + counts[i], digests[i]
        if depth == above:
            ((_, (i, least, n, kids, leaves, saved, _)),) = now.items()
            out.append((least, n, kids, leaves, saved, None, depth, None, None, chains[i].as_py()[:above]))
            break
        up: dict[bytes, list] = {}
        for key, (i, least, n, kids, leaves, saved, ends) in now.items():
            last = starts[i] + depth - 1
            leaves, saved, parent = max(leaves, 1), saved + (n - 1) * words[last], keys[last - 1]
            out.append((least, n, kids, leaves, saved, ends, depth, key, parent, None))
            node = up.setdefault(parent, [i, least, 0, 0, 0, 0, None])
            node[1] = min(node[1], least)
            for k, more in ((2, n), (3, 1), (4, leaves), (5, saved)):
                node[k] += more
        now = up
    kinds = (*[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary(), pa.binary(), LINKS)
    names = [c.split()[0] for c in NODE.split(", ")] + ["key", "parent", "chain"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def peeled(chains: DataFrame, most_rows: int = 256, most_levels: int = 1 << 18) -> DataFrame:
    """The trie of (conv_id, chain): one row for each node, as prefix_trie says.

    Small subtrees are peeled whole, each in a task, down to their anchors; what they are there joins the sequences that end in large
    ones, and from the deepest of these on a depth is one round of all tasks. Results do not depend on what is small.
    """
    spark = chains.sparkSession
    folder = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    ends = staged(ended(chains))
    anchored = ends.join(_anchors(ends, most_rows, most_levels), "conv_id", "left")
    anchored = staged(anchored)
    below = anchored.where("anchor is not null").groupBy("anchor").applyInArrow(_peel, f"{NODE}, key binary, parent binary, chain {LINK}")
    below = staged(below)
    zero = F.lit(0).cast("bigint")
    alone = anchored.where("anchor is null").select("chain", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256", "depth")
    new = alone.unionByName(below.where("key is null").drop("key", "parent"))
    deepest = new.agg(F.max("depth")).first()[0]  # one number
    if deepest is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256")]
    kind = f"chain {LINK}, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    survivors = None
    for depth in range(deepest, -1, -1):
        rows = new.where(F.col("depth") == depth).drop("depth")
        rows = rows if survivors is None else survivors.unionByName(rows)
        nodes = rows.groupBy("chain").agg(*sums) if depth else rows.groupBy().agg(*sums).withColumn("chain", F.array().cast(LINK))
        words = F.coalesce(F.get("chain", F.lit(depth - 1))["words"], F.lit(0)) if depth else F.lit(0)
        nodes = nodes.withColumns({"n_leaves": F.greatest("n_leaves", F.lit(1)), "saved_tokens": (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).cast("bigint")})
        nodes.write.parquet(f"{folder}/depth={depth}")  # a depth is told once, and read by the next and by the result
        survivors = spark.read.schema(kind).parquet(f"{folder}/depth={depth}").select(
            F.slice("chain", 1, max(depth - 1, 0)).alias("chain"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256")
        )
    own = spark.read.schema(f"{kind}, depth int").parquet(folder)
    key = lambda back: F.get("chain", F.col("depth") - back)["key"]
    rest = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    told = own.withColumns({"key": key(1), "parent": key(2)}).drop("chain").unionByName(below.where("key is not null").drop("chain"))
    told = told.select("key", "parent", "conv_id", F.col("depth").cast("bigint").alias("depth"), *rest, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    root = own.where("depth = 0").first()["conv_id"]  # the least id of all
    top = told.where("depth < 2").select("conv_id", "depth", F.when(F.col("depth") == 1, F.lit(root)).alias("parent_conv_id"), *rest, "ends_sha256")
    parents = told.where("n_children > 0 and depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return top.unionByName(told.where("depth > 1").join(parents, "parent").select("conv_id", "depth", "parent_conv_id", *rest, "ends_sha256"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text): one row for each node.

    A node is a distinct sequence of first turns (role, text), the root the empty one. conv_id: its least member, where
    members are the conversations that begin with it; depth: its turns; parent_conv_id: its parent's conv_id; n_convs, n_children,
    n_leaves (childless nodes in its subtree, itself included); saved_tokens: over its subtree, (n_convs - 1) times the words of the
    last text; ends_sha256: of the ids of members that end there, ascending and comma-joined.

    Null roles and texts are empty, null turns come first, equal turns stand by digest, repeated rows are turns each.
    Rows without a conv_id belong to no conversation and are left out. Other columns are not read. No rows give no
    nodes. A conversation's turns (40 bytes each) meet in one task. A depth of large subtrees is a round of Spark jobs: rounds grow
    with the depth at which the last subtree of more than 256 distinct conversations has become small.
    """
    return peeled(chained(sequences(turn_digests(convs))))


def spliced_trie(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The prefix trie of conversations that share heads (see spliced), as prefix_trie tells it. A conversation whose own turns
    all lie in an absent head is turnless: a member of the root alone."""
    return peeled(chained(spliced(turn_digests(convs), every, most)))


def last_turns(trie: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of prefix_trie(convs) with the role and text of their last turn (the root has none)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), key)).cast("bigint")
    turns = convs.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), place.alias("depth"), role.alias("role"), text.alias("text"))
    return trie.join(turns, ["conv_id", "depth"], "left")
