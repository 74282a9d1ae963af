"""Shared helpers of the text operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.durable import durable, shared_folder, staged  # noqa: F401  the operators take them from here

#: Words are runs of bytes outside the six ASCII white-space bytes; bytes.split() cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of a column's text form, modulo n (null stays null)."""
    return F.crc32(F.col(column).cast("string")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, most_bytes: int, name: str = "text"):
    """Cut record batches so that each holds about most_bytes of text (one row at least): bounds memory for long rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold, most: int) -> DataFrame:
    """doc_id, text, y, weight of about `most` labelled rows at most for each of the values 0 and 1, by hash of the id.

    weight: how many labelled rows a picked one stands for (one over its class's share), so that weighted rows have the
    labels' base rate at every size. fold: a condition on doc_id that training rows meet. The picked ids are so few by construction that they are
    broadcast; the documents are not shuffled.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & fold).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r[0]: min(1.0, most / r[1]) for r in own.groupBy("y").count().collect()}
    chosen, weight = F.lit(False), F.lit(1.0)
    for y, part in share.items():
        cut = int(part * 1_000_000)
        chosen |= (F.col("y") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < cut)
        weight = F.when(F.col("y") == y, F.lit(1_000_000 / max(cut, 1))).otherwise(weight)
    picks = own.where(chosen).select(F.col("doc_id").alias("_pick"), "y", weight.alias("weight"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picks), F.col("doc_id") == F.col("_pick")).select("doc_id", "text", "y", "weight")


def flag(column: str, n: int, remainder: int):
    """Whether crc32 of the column's text form leaves this remainder; false for null."""
    return F.coalesce(crc_mod(column, n) == remainder, F.lit(False))


#: Bits of the filter ahead of a shuffle: 8 MB of bitmaps at most are broadcast, whatever the keys.
FILTER_BITS = 1 << 26


def row_hash(docs: DataFrame):
    """A hash of a row's columns, text and id first."""
    return F.xxhash64("doc_id", "text", *[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("doc_id", "text")])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as set it apart from all columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def part_by_keys(df: DataFrame, key, keys: DataFrame, hashed) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have one of the keys, rows that have none), by a bitmap of hashes and without a shuffle.

    key: the column expression of df to hash, hashed: that of keys. df may have columns of any name. With more keys than bits
    (beyond some hundred GB of texts) nearly every row may have one, and the join that follows does all the work, as it
    would alone.
    """
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS)) + 1
    p, bucket, bits, may = fresh(df.columns, "_p", "_bucket", "_bits", "_may")
    filled = keys.select(place(hashed).alias(p)).groupBy(F.bitmap_bucket_number(p).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias(bits))
    filled = durable(filled)
    own = df.withColumn(p, place(key)).withColumn(bucket, F.bitmap_bucket_number(p)).join(F.broadcast(filled), bucket, "left")
    at = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    own = own.withColumn(may, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(p, bucket, bits)
    return own.where(F.col(may)).drop(may), own.where(~F.col(may)).drop(may)
