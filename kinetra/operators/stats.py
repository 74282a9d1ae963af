"""Paired statistics over long tables of (keys, subject, method, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinetra.durable import durable
from kinetra.functions.special import f_tail_udf, range_quantile_udf, range_tail_udf, signed_rank_udf, t_quantile_udf, t_tail_udf
from kinetra.operators.prefix import running


def not_nan(column: str) -> Column:
    """NaN as null: aggregates then pass it over."""
    return F.when(~F.isnan(column), F.col(column))


def descriptive(df: DataFrame, keys: list[str], value: str, confidence: float = 0.95, interval: bool = True) -> DataFrame:
    """mean, sd (sample; 0 for one value), median, min, max, n, sem and the t interval of each group."""
    v = not_nan(value)
    out = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(F.when(F.count(v) == 1, 0.0)).alias("sd"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"),
    ).withColumn("sem", F.col("sd") / F.sqrt("n"))
    if not interval:
        return out
    half = F.when(F.col("n") > 1, t_quantile_udf(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("sem")).otherwise(0.0)
    return out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def average_rank(partition: list[str], value: str, descending: bool = True) -> Column:
    """Rank with ties averaged, 1 the highest (or the lowest)."""
    by = Window.partitionBy(*partition).orderBy(F.col(value).desc() if descending else F.col(value).asc())
    return F.rank().over(by) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def with_average_ranks(df: DataFrame, partition: list[str], value: str, rank: str, rows: int = 250_000) -> DataFrame:
    """df with average_rank() as `rank`: groups are dealt over so many tasks that each sorts about `rows` rows, however many df has."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(tasks, *partition).withColumn(rank, average_rank(partition, value))


def pooled_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name in shares, that exact quantile of a group's values, between two of them in proportion; nulls count not.

    Places of distinct values are running sums dealt by range (see prefix): no task holds a group, and all but the few
    values at the quantiles' places stay where they are.
    """
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    placed = running(counts, keys, [value], {"_before": "_n"})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_size"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(keys)]
    met = placed.join(F.broadcast(sizes.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(keys)], "_size")), same) if keys else placed.crossJoin(F.broadcast(sizes))  # a row a group
    places = {k: (F.col("_size") - 1) * F.lit(float(p)) for k, p in shares.items()}
    held = lambda at: F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.col(value)))
    ends = [x for k, at in places.items() for x in (held(F.floor(at)).alias(f"_low_{k}"), held(F.ceil(at)).alias(f"_high_{k}"), F.max(at - F.floor(at)).alias(f"_part_{k}"))]
    between = lambda k: F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * F.col(f"_part_{k}")
    return met.groupBy(*keys).agg(*ends).select(*keys, *[between(k).alias(k) for k in shares])


def complete_cases(df: DataFrame, keys: list[str], subject: str, value: str, methods: int) -> DataFrame:
    """Rows of subjects that have a value for all methods."""
    whole = df.where(not_nan(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys, subject))
    return whole.withColumn("_n", n).where(F.col("_n") == methods).drop("_n")


def mean_ranks(df: DataFrame, keys: list[str], subject: str, method: str, value: str) -> DataFrame:
    ranked = df.withColumn("rank", average_rank([*keys, subject], value))
    return ranked.groupBy(*keys, method).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def friedman(df: DataFrame, keys: list[str], subject: str, method: str, value: str, tail: bool = False) -> DataFrame:
    """n, k, chi2 (without tie correction), Iman-Davenport F with its degrees of freedom, and its upper tail on request.

    Fewer than 3 subjects or methods give nulls; a denominator of 0 or less an infinite F.
    """
    means = mean_ranks(df, keys, subject, method, value)
    k, n = F.col("k"), F.col("n")
    out = means.groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("k"), F.collect_list("mean_rank").alias("_r"))
    spread = F.aggregate("_r", F.lit(0.0), lambda s, r: s + (r - (k + 1) / 2.0) ** 2)
    out = out.withColumn("chi2", F.when((n >= 3) & (k >= 3), 12.0 * n / (k * (k + 1)) * spread)).drop("_r")
    below = n * (k - 1) - F.col("chi2")
    out = out.withColumns({"f": F.when(below > 0, F.col("chi2") * (n - 1) / below), "df1": (k - 1).cast("double"), "df2": ((k - 1) * (n - 1)).cast("double")})
    return out.withColumn("p", F.when(below <= 0, 0.0).otherwise(f_tail_udf("f", "df1", "df2"))) if tail else out


#: Critical values of the studentised range over sqrt 2 at 0.05, for 2 to 10 methods (fixed values).
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def nemenyi(df: DataFrame, keys: list[str], subject: str, method: str, value: str, alpha: float = 0.05, tail: bool = False) -> DataFrame:
    """Pairs of methods: difference of mean ranks, critical distance, significance, and each pair's approximate p on request.

    At 0.05 the critical values of 2 to 10 methods are the published ones; of any other number and level the quantile of the
    studentised range with infinite degrees of freedom, over the root of two.
    """
    means = mean_ranks(df, keys, subject, method, value).withColumn("k", F.count("*").over(Window.partitionBy(*keys, F.lit(0))))
    known = F.try_element_at(F.create_map(*[x for k, v in NEMENYI_Q.items() for x in (F.lit(k), F.lit(v))]), F.col("k").cast("int")) if alpha == 0.05 else F.lit(None).cast("double")
    sizes = means.select(*keys, "k", "n").distinct()
    q = F.coalesce(known, range_quantile_udf(F.lit(1 - alpha), F.when(known.isNull(), F.col("k")).otherwise(0)) / F.sqrt(F.lit(2.0)))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(keys)], F.col("k").alias("_k"), F.col("n").alias("_n"), (q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(keys)]
    means = means.join(sizes, [*same, F.col("k") == F.col("_k"), F.col("n") == F.col("_n")])
    b = means.select(*keys, F.col(method).alias("b"), F.col("mean_rank").alias("_rb"))
    own = means.withColumnRenamed(method, "a")
    pairs = own.join(b, keys) if keys else own.join(b, F.lit(True))
    diff = F.abs(F.col("mean_rank") - F.col("_rb"))
    p = [range_tail_udf(diff / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))) * F.sqrt(F.lit(2.0)), F.col("k")).alias("p")] if tail else []
    return pairs.where("a < b").select(*keys, "a", "b", diff.alias("rank_diff"), "cd", (diff > F.col("cd")).alias("significant"), *p)


def pairs(df: DataFrame, keys: list[str], subject: str, method: str, value: str) -> DataFrame:
    """Every unordered pair of methods of a subject: keys, subject, a < b, d = value of a less value of b; null values drop out."""
    whole = df.where(not_nan(value).isNotNull()).select(*keys, subject, method, value)
    other = whole.withColumnsRenamed({method: "b", value: "_vb"})
    return whole.withColumnRenamed(method, "a").join(other, [*keys, subject]).where("a < b").select(*keys, subject, "a", "b", F.col(value).alias("x"), F.col("_vb").alias("y"), (F.col(value) - F.col("_vb")).alias("d"))


def against(df: DataFrame, keys: list[str], subject: str, method: str, value: str, base: str) -> DataFrame:
    """Each other method of a subject against one: keys, subject, method, x, base value y, d = x - y."""
    ref = df.where(F.col(method) == base).select(*keys, subject, F.col(value).alias("y"))
    return df.where(F.col(method) != base).join(ref, [*keys, subject]).select(*keys, subject, method, F.col(value).alias("x"), "y", (F.col(value) - F.col("y")).alias("d"))


def paired_effects(paired: DataFrame, keys: list[str]) -> DataFrame:
    """mean difference, d_z, counts of improvement and worsening of rows with d."""
    return paired.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_diff"), (F.avg("d") / F.stddev_samp("d")).alias("d_z"),
        F.sum((F.col("d") > 0).cast("bigint")).alias("n_improve"), F.sum((F.col("d") < 0).cast("bigint")).alias("n_worsen"),
    )


def signed_ranks(paired: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """w_plus, w_minus over non-zero differences, the rank-biserial effect over all of them, and p on request (exact up to 50 without ties).

    Differences are counted by size and sign, and ranks are told of sizes, not of rows: a group is never one task's.
    """
    by_size = paired.withColumns({"_a": F.abs("d"), "_p": (F.col("d") > 0).cast("bigint"), "_m": (F.col("d") < 0).cast("bigint")})
    sizes = by_size.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_c"), F.sum("_p").alias("_p"), F.sum("_m").alias("_m"))
    sizes = running(sizes, keys, ["_a"], {"_before": "_c"}).withColumn("_all", F.col("_before") + (F.col("_c") + 1) / 2)
    # Nulls and zeros come first, so that ranks without them are ranks less their number.
    some = F.coalesce(F.col("_a") != 0, F.lit(False))
    first = sizes.groupBy(*keys).agg(F.sum(F.when(some, 0).otherwise(F.col("_c"))).alias("_first"))
    sizes, r = sizes.join(first, keys), F.col("_all") - F.col("_first")
    total = lambda x: F.sum(x.cast("double"))
    out = sizes.groupBy(*keys).agg(
        F.sum("_c").alias("n"), total(F.col("_p") * F.col("_all")).alias("_ap"), total(F.col("_m") * F.col("_all")).alias("_am"), F.sum(F.when(some, F.col("_c"))).alias("n_nonzero"),
        total(F.when(some, F.col("_p") * r)).alias("w_plus"), total(F.when(some, F.col("_m") * r)).alias("w_minus"), total(F.when(some, F.col("_c") * r * r)).alias("_q"),
    )
    out = out.withColumn("rank_biserial", 1 - 2 * F.least("_ap", "_am") / (F.col("n") * (F.col("n") + 1) / 2)).select(*keys, "n", "n_nonzero", "w_plus", "w_minus", "_q", "rank_biserial")
    return out.withColumn("p", F.when(F.col("n_nonzero").isNull(), 1.0).otherwise(signed_rank_udf(F.least("w_plus", "w_minus"), "n_nonzero", "_q"))).drop("_q") if exact else out.drop("_q")


def holm_sidak(df: DataFrame, family: list[str], p: str, ties: list[str]) -> DataFrame:
    """df with p_adjusted: step-down 1 - (1 - p)^(m - i), its running maximum, at most 1. Null p stay null and out of m."""
    whole, by = Window.partitionBy(*family), Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *ties)
    m, i = F.count(p).over(whole), F.row_number().over(by) - 1
    step = F.when(F.col(p).isNotNull(), 1 - F.pow(1 - F.col(p), m - i))
    ranked = df.withColumn("_step", step)
    return ranked.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(by.rowsBetween(Window.unboundedPreceding, 0))))).drop("_step")


def cohens_d(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Pooled-sd effect (0 with fewer than two values or no spread) and its label."""
    n = F.count("*")
    pooled = F.sqrt((F.var_samp(x) + F.var_samp(y)) / 2)
    d = F.when((n < 2) | (pooled == 0), 0.0).otherwise((F.avg(x) - F.avg(y)) / pooled)
    out = df.groupBy(*keys).agg(d.alias("cohens_d"))
    a = F.abs("cohens_d")
    return out.withColumn("effect", F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, tail: bool = False) -> DataFrame:
    """Rank correlation with averaged ranks; its two-sided p by the t distribution on request.

    Equal pairs are counted first; each side's ranks are told of its distinct values and joined to the pairs.
    """
    pairs = df.groupBy(*keys, F.col(x).alias("_vx"), F.col(y).alias("_vy")).agg(F.count(F.lit(1)).alias("_c"))
    pairs = durable(pairs)
    for v in ("x", "y"):
        values = pairs.groupBy(*keys, f"_v{v}").agg(F.sum("_c").alias("_n"))
        ranks = running(values, keys, [f"_v{v}"], {"_before": "_n"}).select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.col(f"_v{v}").alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_{v}"))
        met = [*[F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)], F.col(f"_v{v}").eqNullSafe(F.col("_v"))]
        pairs = pairs.join(ranks, met).drop("_v", *[f"_of_{i}" for i in range(len(keys))])
    # The mean rank is (n + 1) / 2; sums of products of the distances from it are small enough for doubles.
    sized = pairs.join(pairs.groupBy(*keys).agg(F.sum("_c").alias("n")), keys)
    dx, dy, c = F.col("_x") - (F.col("n") + 1) / 2, F.col("_y") - (F.col("n") + 1) / 2, F.col("_c")
    sums = sized.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(c * dx * dy).alias("_xy"), F.sum(c * dx * dx).alias("_xx"), F.sum(c * dy * dy).alias("_yy"))
    out = sums.select(*keys, F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"), "n")
    if not tail:
        return out
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") ** 2))
    return out.withColumn("p", t_tail_udf(t, (F.col("n") - 2).cast("double")))


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, rounds: int = 10_000, seed: int = 20260101, block: int = 100) -> DataFrame:
    """Percentile interval (2.5, 97.5) of the mean over resamples of subjects.

    A group's values are one sorted array; each round draws from it by hash of (seed, round, place), so that reruns
    agree. Blocks of rounds spread over tasks: a group's array is copied once a block, not once a round.
    """
    held = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value)))[value].alias("_v"))
    blocks = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // block) - 1))).alias("_block"))
    n = F.size("_v")
    places = F.sequence(F.lit(1), n)

    def mean(b):
        drawn = F.transform(places, lambda i: F.element_at("_v", (F.pmod(F.xxhash64(F.lit(seed), b, i), n) + 1).cast("int")))
        return F.aggregate(drawn, F.lit(0.0), lambda s, x: s + x) / n

    first = F.col("_block").cast("long") * block
    own = F.sequence(first, F.least(first + block, F.lit(rounds).cast("long")) - 1)
    means = blocks.select(*keys, F.explode(F.transform(own, mean)).alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high"))


POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def poisson_weights(identity: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """rows x rounds Poisson(1) draws, each by a hash of (seed, round, the row's identity hash): the same in any task."""
    with np.errstate(over="ignore"):
        z = identity.astype(np.uint64)[:, None] + np.uint64(seed) * np.uint64(0xD1342543DE82EF95) + (np.arange(rounds, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / float(1 << 53), side="right")


def poisson_bootstrap(df: DataFrame, keys: list[str], value: str, identity: list[str], rounds: int = 10_000, seed: int = 20260101, most_groups: int = 64) -> DataFrame:
    """keys, n, ci_low, ci_high: percentile interval (2.5, 97.5) of the mean, of groups of any size.

    Each row stands in each resample a Poisson(1) number of times, drawn by hash of its identity. A task keeps weighted
    sums by round of the groups it meets, and what is shuffled is one array a task and group: no group is ever one array
    of its rows. For large groups the interval is that of drawing rows with replacement. Null and NaN values drop out; a
    round that draws no row of a group is left out.
    """
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keys) + ", n bigint, v array<double>"
    kinds = [to_arrow_type(df.schema[c].dataType) for c in keys]

    def table(held: dict) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in held.values()], pa.int64()), pa.array([v.ravel() for _, v in held.values()], pa.list_(pa.float64()))], names=[*keys, "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            x, h = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            order: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                order.setdefault(g, []).append(i)
            for g, at in order.items():
                own = held.setdefault(g, [0, np.zeros((2, rounds))])
                own[0] += len(at)
                for i in range(0, len(at), 512):
                    rows = at[i : i + 512]
                    w = poisson_weights(h[rows], rounds, seed)
                    own[1] += np.stack((w.sum(axis=0), x[rows] @ w))
                if len(held) >= most_groups:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    def met(key: tuple, got: pa.Table) -> pa.Table:
        v = got.column("v").combine_chunks()
        count, total = np.asarray(v.flatten()).reshape(len(v), 2, rounds).sum(axis=0)
        means = total[count > 0] / count[count > 0]
        low, high = np.quantile(means, [0.025, 0.975]) if len(means) else (None, None)
        return pa.table({**{c: got.column(c).slice(0, 1) for c in keys}, "n": pa.array([sum(got.column("n").to_pylist())], pa.int64()), "ci_low": pa.array([low], pa.float64()), "ci_high": pa.array([high], pa.float64())})

    rows = df.where(not_nan(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(*identity).alias("_h"))
    out = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keys) + ", n bigint, ci_low double, ci_high double"
    return rows.mapInArrow(run, schema).groupBy(*keys).applyInArrow(met, out)


def bundle(df: DataFrame, keys: list[str], subject: str, method: str, value: str, alpha: float = 0.05) -> DataFrame:
    """keys, part, a, b, name, x of everything that is told of a matrix of subjects and methods, as one long table.

    descriptive (mean, sd, median, min, max, n of each method), friedman (chi2, f, p), nemenyi (rank_diff, cd, p of pairs; only
    where Friedman's p is below alpha), wilcoxon (w_plus, w_minus, p, and p_adjusted by Holm-Sidak), cohens_d of pairs.
    """

    def long(rows: DataFrame, part: str, a, b, *names: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names]))
        none = F.lit(None).cast("string")
        return rows.select(*keys, F.lit(part).alias("part"), (F.col(a).cast("string") if a else none).alias("a"), (F.col(b).cast("string") if b else none).alias("b"), cells.alias("_c")).select(*keys, "part", "a", "b", "_c.name", "_c.x")

    fr = friedman(df, keys, subject, method, value, tail=True)
    each = pairs(df, keys, subject, method, value)
    told = holm_sidak(signed_ranks(each, [*keys, "a", "b"], exact=True), keys, "p", ["a", "b"])
    near = nemenyi(df, keys, subject, method, value, alpha, tail=True).join(fr.where(F.col("p") < alpha).select(*keys), keys, "left_semi")
    parts = [
        long(descriptive(df, [*keys, method], value, interval=False), "descriptive", method, None, "mean", "sd", "median", "min", "max", "n"),
        long(fr, "friedman", None, None, "chi2", "f", "p"), long(near, "nemenyi", "a", "b", "rank_diff", "cd", "p"),
        long(told, "wilcoxon", "a", "b", "w_plus", "w_minus", "p", "p_adjusted"), long(cohens_d(each, [*keys, "a", "b"]), "cohens_d", "a", "b", "cohens_d"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stars(p: str) -> Column:
    return F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("")


def p_text(p: str) -> Column:
    return F.when(F.col(p) < 0.001, F.lit("< 0.001")).otherwise(F.format_string("%.3f", p))
