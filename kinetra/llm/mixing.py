"""Mix sources to target weights with Sainte-Lague apportionment of equal-token blocks.

Everything is DataFrame expressions. Each source is one stream of words: its shards in order, and in a shard its
documents in seeded order. The stream is cut into blocks of equal size. Sainte-Lague (the highest quotients
target / (2k+1)) gives each source whole blocks, and again each shard of a source its part of them; a shard then
takes its blocks by a seeded systematic draw, so that what a document gives is a closed form of where it lies in the
stream: no block is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import WORD, durable, part_by_keys, row_hash
from kinetra.operators.prefix import running

WEIGHTS = (5, 2, 1)


def _div(x: Column, y: int | Column) -> Column:
    """Whole division of non-negative integers."""
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y))


def _quotas(df: DataFrame, key: list[str], claim: str) -> DataFrame:
    """Sainte-Lague seats of each row of df among the rows of its key: df with `quota`.

    df has `seats` (dealt in the group), `parties` (rows in it), `most` (a row's seats end there), `rank_key` (ties).
    A party's seats are its exact share times a factor within parties / (2 * seats) of 1, rounded. All seats that
    are sure by that bound are given at once; only the few quotients around the cut become rows, about four a
    party, and are ranked highest first.
    """
    group = Window.partitionBy(*key)
    share, slack = F.coalesce(F.col(claim) * F.col("seats") / F.sum(claim).over(group), F.lit(0.0)), F.col("parties") / (2.0 * F.greatest(F.col("seats"), F.lit(1)))
    near = df.withColumn("_sure", F.least(F.greatest(F.lit(0), F.floor(share * (1 - slack)) - 1).cast("bigint"), F.col("most")))
    top = F.least((F.ceil(share * (1 + slack)) + 1).cast("bigint"), F.col("most"))
    near = near.withColumn("_top", top).withColumn("_rest", F.col("seats") - F.sum("_sure").over(group))
    near = near.withColumn("_k", F.explode_outer(F.when(F.col("_top") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_top") - 1))))
    near = near.withColumn("_q", F.when(F.col(claim) > 0, F.col(claim) / (2 * F.col("_k") + 1)))
    won = F.col("_q").isNotNull() & (F.row_number().over(group.orderBy(F.col("_q").desc_nulls_last(), "rank_key", "_k")) <= F.col("_rest"))
    return near.withColumn("_won", won.cast("bigint")).groupBy(*df.columns).agg((F.max("_sure") + F.sum("_won")).alias("quota"))


def _hex(text: Column, start: int) -> Column:
    """The number that eight hex digits of an md5 stand for."""
    return F.conv(F.substring(text, start, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target: share of all sizes by weight, stopped at most times the source's size.

    What stops is reshared by weight until none is above: the level is found in one pass, by ascending
    size / weight. Sources rank by code point, null last. One row a source goes through the ranking windows.
    """
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights)).cast("int") + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "_n")
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
    ranked = ranked.withColumn("_before", F.sum("_cap").over(by) - F.col("_cap"))
    ranked = ranked.withColumn("_left", F.sum("weight").over(everything) - F.sum("weight").over(by) + F.col("weight"))
    level = (F.col("_total") - F.col("_before")) / F.col("_left")
    ranked = ranked.withColumn("_level", F.when(level * F.col("weight") <= F.col("_cap"), level))
    ranked = ranked.withColumn("_level", F.first("_level", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), "_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("weight")), F.col("_cap"))).select("source", "source_size", "target")


def _placed(docs: DataFrame, *columns: Column, shards: int, seed: int) -> DataFrame:
    """columns, _id, size, src, none, key and shard of each row: where it stands in its source's stream."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # A null source is told apart from an empty one by a flag: joins and windows then need no null-safe keys.
    placed = docs.select(*columns, F.col("doc_id").alias("_id"), size.alias("size"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), key.alias("key"))
    return placed.withColumn("shard", _div(_hex(F.col("key"), 1) * shards, 1 << 32).cast("int"))


def _planned(parts: DataFrame, block: int, seed: int, share: float, weights: tuple[int, ...]) -> DataFrame:
    """(src, none, shard, shard_size) -> the shards with their sources' targets and what a draw of their blocks needs."""
    sources = parts.groupBy("src", "none").agg(F.sum("shard_size").alias("source_size"))
    aimed = targets(sources.select(F.when(~F.col("none"), F.col("src")).alias("source"), "source_size"), share, weights)
    aimed = aimed.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), "source_size", "target")
    everything = Window.partitionBy(F.lit(0))
    aimed = aimed.withColumn("blocks", _div(F.col("source_size") + block - 1, block)).withColumn("most", F.col("blocks") * 2)
    aimed = aimed.withColumn("parties", F.count("*").over(everything)).withColumn("seats", F.least(F.round(F.sum("target").over(everything) / block).cast("bigint"), F.sum("most").over(everything)))
    aimed = aimed.withColumn("everything", F.lit(0)).withColumn("rank_key", F.concat(F.col("none").cast("string"), F.lit(":"), F.col("src")))
    aimed = _quotas(aimed, ["everything"], "target").select("src", "none", "source_size", "target", F.col("quota").alias("seats"))
    # Shards: where each begins in its source's stream, and the blocks that begin in it.
    along = Window.partitionBy("src", "none").orderBy("shard")
    parts = parts.withColumn("begin", F.sum("shard_size").over(along) - F.col("shard_size"))
    parts = parts.withColumn("first", _div(F.col("begin") + block - 1, block)).withColumn("blocks", _div(F.col("begin") + F.col("shard_size") + block - 1, block) - F.col("first"))
    parts = parts.withColumn("most", F.col("blocks") * 2).withColumn("parties", F.count("*").over(Window.partitionBy("src", "none"))).withColumn("rank_key", F.lpad(F.col("shard").cast("string"), 10, "0"))
    parts = _quotas(parts.join(aimed, ["src", "none"]), ["src", "none"], "blocks")
    # The seeded systematic draw: of n blocks, those numbered below i give (i * quota + u) div n blocks.
    seeded = _hex(F.md5(F.concat(F.lit(f"{seed}/"), F.col("none").cast("string"), F.col("src"), F.lit("/"), F.col("shard").cast("string"))), 1)
    parts = parts.withColumn("n", F.greatest("blocks", F.lit(1))).withColumn("u", seeded % F.col("n"))
    parts = parts.withColumn("given", F.sum("quota").over(along) - F.col("quota"))
    last = F.when(F.col("blocks") > 0, F.col("quota") - _div((F.col("blocks") - 1) * F.col("quota") + F.col("u"), F.col("n")))
    parts = parts.withColumn("_last", last).withColumn("carried", F.coalesce(F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.select("src", "none", "shard", "source_size", "target", "begin", "first", "blocks", "quota", "n", "u", "given", "carried")


def _taken(before: Column, size: Column, block: int) -> Column:
    """Words that the draw takes of a document that begins `before` words into its shard."""

    def blocks_before(b: Column) -> Column:
        """Blocks taken among those numbered below b, for b from first - 1 on."""
        drawn = _div(F.least(b - F.col("first"), F.col("blocks")) * F.col("quota") + F.col("u"), F.col("n"))
        return F.when(b < F.col("first"), F.col("given") - F.col("carried")).otherwise(F.col("given") + F.when(F.col("blocks") > 0, drawn).otherwise(0))

    def words_before(x: Column) -> Column:
        """Words taken from the source's stream before position x."""
        at = _div(x, block)
        return blocks_before(at) * block + (blocks_before(at + 1) - blocks_before(at)) * (x - at * block)

    low = F.col("begin") + before
    return (words_before(low + size) - words_before(low)).cast("bigint")


def mix(docs: DataFrame, block: int = 32, shards: int = 256, seed: int = 17, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs, and the columns named in carry.

    size is the text's word count (null: 0). taken is how many of its words the mix takes, repeats counted, at most
    twice its size. A source's taken words differ from its target by a block or two. Empty texts take nothing; a
    null source is a source of its own, last in order; equal rows are separate documents, ordered by id and size.
    An empty table gives no rows. The draw depends on ids, sizes and the seed alone, so that reruns agree.
    """
    placed = _placed(docs, F.struct("doc_id", *[c for c in carry if c != "doc_id"]).alias("row"), shards=shards, seed=seed)
    parts = durable(placed.groupBy("src", "none", "shard").agg(F.sum("size").alias("shard_size")))  # a row a source and shard; else the texts are counted once for each use
    in_shard = Window.partitionBy("src", "none", "shard").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("before", F.sum("size").over(in_shard) - F.col("size"))
    laid = laid.join(_planned(parts, block, seed, share, weights), ["src", "none", "shard"])
    return laid.select("row.*", "size", "source_size", "target", _taken(F.col("before"), F.col("size"), block).alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str, block: int = 32, shards: int = 256, seed: int = 17) -> DataFrame:
    """Pipeline stage: the rows of docs that the mix takes words of, with size, source_size, target and taken beside.

    The draw sees ids, row hashes and sizes, never a text; texts meet what was drawn in one join on (id, hash), and running
    sums are dealt by range, so that a source or a null id with a third of all rows is not one task's. Columns of docs
    with one of the four names are replaced; others pass through whatever their names. Null and empty texts have no words
    and go; null ids and sources stay, a null source being one of its own. Rows that share an id stand by size and row
    hash; rows equal in all columns are drawn each. No rows give no rows.
    """
    own = ("size", "source_size", "target", "taken")
    kept = docs.drop(*own)
    rows = kept.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("i"), row_hash(kept).alias("h"))
    placed = _placed(kept.select("doc_id", "text", "source", row_hash(kept).alias("h")), F.col("h"), shards=shards, seed=seed)
    placed = durable(placed.groupBy("_id", "h", "size", "src", "none", "key", "shard").agg(F.count(F.lit(1)).alias("copies"))).withColumn("words", F.col("size") * F.col("copies"))
    parts = durable(placed.groupBy("src", "none", "shard").agg(F.sum("words").alias("shard_size")))
    laid = running(placed, ["src", "none", "shard"], ["key", "_id", "size", "h"], {"before": "words"})
    laid = laid.join(_planned(parts, block, seed, 1.5, WEIGHTS), ["src", "none", "shard"])
    each = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    drawn = each.withColumn("taken", _taken(F.col("before") + F.col("copy") * F.col("size"), F.col("size"), block)).where("taken > 0")
    drawn = durable(drawn.select(F.coalesce(F.col("_id").cast("bigint"), F.lit(-1)).alias("i"), "h", "copies", *own))
    twice = drawn.where("copies > 1").select("i", "h").distinct()
    if not twice.take(1):
        return rows.join(drawn, ["i", "h"]).select("row.*", *own)
    may, never = part_by_keys(rows, F.col("h"), twice, F.col("h"))  # one of each set of equal rows is told off its copies
    met = never.join(drawn.where("copies = 1"), ["i", "h"]).unionByName(may.dropDuplicates(["i", "h"]).join(drawn, ["i", "h"]))
    return met.select("row.*", *own)
