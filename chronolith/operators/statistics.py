"""Statistics over clustered samples: intervals, tests, resampling, percentiles.

The unit of independence is the cluster. Everything aggregates to one row for each cluster first, so
cost after that grows with clusters, not items.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered, summed_before

Z = 1.959963985


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a proportion; [0, 1] for n = 0."""
    p = hits / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def mcnemar(wins: Column, losses: Column) -> Column:
    """Exact two-sided p-value of the discordant pairs."""
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    step = F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("total"))
    terms = F.aggregate(
        F.sequence(F.lit(0), k),
        step,
        lambda s, i: F.struct((s["log_c"] + F.log((n - i).cast("double") / (i + 1))).alias("log_c"), (s["total"] + F.exp(s["log_c"] - n * math.log(2))).alias("total")),
        lambda s: s["total"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms))


def clusters(items: DataFrame, key: str, *sums: str) -> DataFrame:
    """One row for each cluster: n and the sums of columns."""
    return items.groupBy(F.col(key).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in sums])


#: P(a Poisson variable of mean 1 is at most i), up to the last that differs from 1 in 32 bits.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(12)]


def poisson_weight(cluster: Column, sample: Column) -> Column:
    """How often a cluster enters a resample: Poisson of mean 1, from 32 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws(":", cluster.cast("string"), sample.cast("string")).cast("binary")), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    return sum((F.when(u > p, 1).otherwise(0) for p in _POISSON), F.lit(0))


def resampled_ratio(per_cluster: DataFrame, hits: str, samples: int = 2000) -> DataFrame:
    """lo and hi of the pooled ratio sum(hits) / sum(n) when clusters are drawn again.

    Poisson weights stand for draws with replacement, so each cluster is worked on alone, whatever
    their number, and only one partial sum for each sample leaves a task.
    """
    rows = per_cluster.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    w = poisson_weight(F.col("cluster"), F.col("sample"))
    ratios = rows.groupBy("sample").agg(F.sum(w * F.col(hits)).alias("h"), F.sum(w * F.col("n")).alias("n"))
    ratios = ratios.select(F.round(F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0), 9).alias("ratio"), F.row_number().over(Window.orderBy(F.when(F.col("n") > 0, F.round(F.col("h") / F.col("n"), 9)).otherwise(0.0))).alias("i"))
    lo, hi = int(0.025 * (samples - 1)) + 1, math.ceil(0.975 * (samples - 1)) + 1
    return ratios.agg(F.max(F.when(F.col("i") == lo, F.col("ratio"))).alias("lo"), F.max(F.when(F.col("i") == hi, F.col("ratio"))).alias("hi"))


def seeded_bootstrap(hits: list[float], sizes: list[int], samples: int = 2000, seed: int = 0) -> tuple[float, float]:
    """The same interval by a seeded generator on the driver, for few clusters, as published tables have it."""
    n = len(sizes)
    if n == 0:
        return 0.0, 0.0
    if n == 1:
        p, z, m = hits[0] / sizes[0], Z, sizes[0]
        centre, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
        return max(0.0, centre - half), min(1.0, centre + half)
    draw = random.Random(seed)
    means = []
    for _ in range(samples):
        picked = [draw.randrange(n) for _ in range(n)]
        total = sum(sizes[i] for i in picked)
        means.append(sum(hits[i] for i in picked) / total if total else 0.0)
    means.sort()
    return means[int(0.025 * (samples - 1))], means[math.ceil(0.975 * (samples - 1))]


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row for each cluster of two runs (item, key, value): n, diff, and items that only one got right."""
    both = a.select("item", key, F.col("value").cast("double").alias("a")).join(b.select("item", F.col("value").cast("double").alias("b")), "item")
    return both.groupBy(F.col(key).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") - F.col("b")).alias("diff"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))


def nearest_rank(rows: DataFrame, value: str, quantiles: list[float], *by: str) -> DataFrame:
    """The value of rank ceil(q n) for each quantile.

    Equal values are counted first and ranks come from sums of counts, so no group of rows is sorted whole.
    """
    return _at_rank(rows, value, {f"p{round(q * 100)}": F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("__n"))) for q in quantiles}, *by)


def index_quantile(rows: DataFrame, value: str, quantiles: list[float], *by: str) -> DataFrame:
    """The value at index min(n - 1, floor(q n)), a second definition in use."""
    return _at_rank(rows, value, {f"q{round(q * 100)}": F.least(F.col("__n"), F.floor(F.lit(q) * F.col("__n")) + 1) for q in quantiles}, *by)


def _at_rank(rows: DataFrame, value: str, ranks: dict[str, Column], *by: str) -> DataFrame:
    counts = rows.groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    # a hot group's values lie in many ranges; its first place is taken off afterwards
    placed = summed_before(counts, "__before", F.col("__c"), *by, "__v")
    groups = placed.groupBy(*by).agg(F.min("__before").alias("__first"), F.sum("__c").alias("__n"))
    if by:
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
        groups = groups.withColumnsRenamed({c: f"__g{i}" for i, c in enumerate(by)})
        counts = placed.join(groups, same)
    else:
        counts = placed.crossJoin(F.broadcast(groups))  # one row
    counts = counts.withColumn("__upto", F.col("__before") - F.col("__first") + F.col("__c"))
    out = [F.min(F.when(F.col("__upto") >= r, F.col("__v"))).alias(name) for name, r in ranks.items()]
    return counts.groupBy(*by).agg(F.max("__n").alias("n"), *out) if by else counts.agg(F.max("__n").alias("n"), *out)


def hash_split(section: Column, share: float) -> Column:
    """dev or test by the first 52 bits of a hash of the section."""
    bits = F.conv(F.substring(F.sha2(section.cast("string"), 256), 1, 13), 16, 10).cast("double")
    return F.when(bits / float(1 << 52) < share, "dev").otherwise("test")


def midpoint(start: Column, end: Column, horizon: Column, margin: int = 14) -> Column:
    """A date inside [start, end or horizon): the middle, where at least `margin` days are on both sides, else null."""
    span = F.datediff(F.coalesce(end, horizon), start)
    return F.when(span >= 2 * margin, F.date_add(start, F.floor(span / 2).cast("int")))


def stride(rows: DataFrame, every: int, *order: str) -> DataFrame:
    """Each every-th row in this order, the first among them."""
    return numbered(rows, "__i", *order).filter(F.col("__i") % every == 0).drop("__i")


def satisfied(sets: Column, got: Column) -> Column:
    """Whether any of the acceptable sets was retrieved whole; an empty set always is."""
    return F.exists(sets, lambda s: F.size(F.array_except(s, got)) == 0)


def leaked(distractors: Column, got: Column) -> Column:
    """Distractors that were retrieved, in the order of retrieval."""
    return F.filter(got, lambda x: F.array_contains(distractors, x))
