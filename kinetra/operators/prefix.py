"""Running sums and ranks in groups of any size: no task ever holds a whole group.

Rows are dealt by range of (group, order), so that a group is a row of pieces, each in one partition. Sums run within
a piece; what lies before a piece comes from one row a piece. A group of all rows is then as many tasks as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.durable import durable


def running(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """df with, for each new name in amounts, the sum of that column over the rows of the same keys before this one.

    order is ascending, nulls first; rows equal in keys and order stand in no fixed order, and together in one
    partition, so bring equal rows together first (see ranked). Null keys are a group, null amounts count nothing.
    """
    taken = {c.lower() for c in df.columns}
    piece = next(f"piece{i}" for i in range(len(taken) + 1) if f"piece{i}" not in taken)
    dealt = durable(df.repartitionByRange(*keys, *order).withColumn(piece, F.spark_partition_id()))
    same, rows = Window.partitionBy(piece, *keys), Window.unboundedPreceding
    sizes = dealt.groupBy(piece, *keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in amounts.items()])
    along = Window.partitionBy(*keys).orderBy(piece).rowsBetween(rows, -1)  # a row a piece
    before = sizes.select(F.col(piece).alias("_piece"), *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_{n}").over(along), F.lit(0)).alias(f"_{n}") for n in amounts])
    inside = dealt.select("*", *[F.coalesce(F.sum(c).over(same.orderBy(*order).rowsBetween(rows, -1)), F.lit(0)).alias(n) for n, c in amounts.items()])
    met = [F.col(piece) == F.col("_piece"), *[F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]]
    return inside.join(before, met).select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in amounts])


def ranked(df: DataFrame, keys: list[str], value: str, rank: str = "rank", count: str = "count") -> DataFrame:
    """One row a (keys, value): how many rows have it and their average rank, 1 the least. Nulls rank first, as a value.

    Equal values are counted map-side first, so that a value which a third of all rows have is one row.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))
    return running(counts, keys, [value], {rank: count}).withColumn(rank, F.col(rank) + (F.col(count) + 1) / 2)
