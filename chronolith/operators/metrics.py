"""Metrics, load analysis and corpus shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import summed_before

INF = float("inf")


def bucket_edge(value: Column, edges: Sequence[float]) -> Column:
    """The least edge not below the value, infinity above all."""
    out = F.lit(INF)
    for edge in sorted(edges, reverse=True):
        out = F.when(value <= edge, float(edge)).otherwise(out)
    return out


def histogram(rows: DataFrame, value: str, edges: Sequence[float], *labels: str) -> DataFrame:
    """labels, le, and the cumulative count of values up to le; every edge appears for every label set."""
    edges = [*sorted(float(e) for e in edges), INF]
    # one pass: a conditional count for each edge, then one row for each
    wide = rows.groupBy(*labels).agg(*[F.count_if(F.col(value) <= e if e < INF else F.col(value).isNotNull()).alias(f"__{i}") for i, e in enumerate(edges)])
    points = F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"__{i}").alias("n")) for i, e in enumerate(edges)]))
    return wide.select(*labels, points.alias("p")).select(*labels, "p.le", "p.n")


def exposition(hist: DataFrame, name: str, *labels: str) -> DataFrame:
    """Text lines `name_bucket{label="value",le="edge"} count`."""
    le = F.when(F.col("le") == INF, "+Inf").otherwise(F.regexp_replace(F.col("le").cast("string"), r"\.0$", ""))
    inside = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in labels], F.concat(F.lit('le="'), le, F.lit('"')))
    return hist.select(F.concat(F.lit(name + "_bucket{"), inside, F.lit("} "), F.col("n").cast("string")).alias("line"))


def parse_exposition(lines: DataFrame) -> DataFrame:
    """name, labels as a map, and value of text lines (line); comments and blanks are left out."""
    line = F.trim("line")
    rows = lines.filter((line != "") & ~line.startswith("#"))
    inside = F.regexp_extract("line", r"\{(.*)\}", 1)
    keys, values = F.regexp_extract_all(inside, F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), 1), F.regexp_extract_all(inside, F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), 2)
    number = F.regexp_replace(F.regexp_extract("line", r"\s(\S+)\s*$", 1), r"^\+?Inf$", "Infinity")
    return rows.select(F.regexp_extract("line", r"^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)", 1).alias("name"), F.map_from_arrays(keys, values).alias("labels"), number.try_cast("double").alias("value"))


def bucket_quantile(hist: DataFrame, q: float, *labels: str) -> DataFrame:
    """The q-quantile by linear interpolation inside its bucket; clipped to the last finite edge where it lies above."""
    order = Window.partitionBy(*labels).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*labels))
    rows = hist.withColumns({"total": total, "lo": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(order), F.lit(0))})
    rows = rows.filter((F.col("n") >= q * F.col("total")) & (F.col("total") > 0))
    first = rows.groupBy(*labels).agg(F.min_by(F.struct("le", "n", "total", "lo", "below"), "le").alias("b"))
    inside = F.col("b.lo") + (F.col("b.le") - F.col("b.lo")) * (q * F.col("b.total") - F.col("b.below")) / (F.col("b.n") - F.col("b.below"))
    clipped = F.col("b.le") == INF
    return first.select(*labels, F.round(F.when(clipped, F.col("b.lo")).otherwise(inside), 9).alias("value"), clipped.alias("clipped"))


def load_summary(samples: DataFrame, *by: str) -> DataFrame:
    """Of samples (intended, sent, done, status): counts by outcome, goodput, latencies and what waiting hid."""
    ok = F.col("status") == 200
    waited = F.col("done") - F.col("intended")
    span = F.max("done") - F.min("intended")
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == 503).alias("refused"), F.count_if(~ok & (F.col("status") != 503)).alias("failed"),
        F.round(F.count_if(ok) / span, 6).alias("goodput"), F.round(F.avg(waited), 6).alias("mean_latency"), F.round(F.max(waited - (F.col("done") - F.col("sent"))), 6).alias("most_omitted"),
    )


def ramp(samples: DataFrame, value: Column, *by: str) -> DataFrame:
    """Median of the last fifth less median of the first fifth, in order of `intended`."""
    order, whole = Window.partitionBy(*by).orderBy("intended", "id"), Window.partitionBy(*by)
    rows = samples.withColumns({"__v": value, "__i": F.row_number().over(order), "__n": F.count(F.lit(1)).over(whole)})
    fifth = F.greatest(F.lit(1), F.floor(F.col("__n") / 5))
    first, last = F.when(F.col("__i") <= fifth, F.col("__v")), F.when(F.col("__i") > F.col("__n") - fifth, F.col("__v"))
    return rows.groupBy(*by).agg(F.round(F.percentile(last, 0.5) - F.percentile(first, 0.5), 6).alias("ramp"))


def arrivals(session, n: int, rate: float, poisson: bool = False, seed: int = 0) -> DataFrame:
    """id and offset in seconds of n arrivals: evenly spaced, or with exponential gaps from hashes."""
    rows = session.range(n)
    if not poisson:
        return rows.select("id", (F.col("id") / rate).alias("offset"))
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)).cast("double") + 0.5) / float(1 << 31)
    gaps = rows.withColumn("gap", -F.log(u) / rate)
    return summed_before(gaps, "before", F.col("gap"), "id").select("id", (F.col("before") + F.col("gap")).alias("offset"))


def zipf_slope(vocabulary: DataFrame, least: int = 1) -> DataFrame:
    """Slope of log frequency over log rank of vocabulary (term, n).

    Terms of equal frequency share the mean of their log ranks' place, so counts by frequency are enough.
    """
    counts = vocabulary.filter(F.col("n") >= least).groupBy("n").agg(F.count(F.lit(1)).alias("terms"))
    counts = summed_before(counts, "above", F.col("terms"), F.col("n").desc())
    points = counts.select(F.log(F.col("above") + (F.col("terms") + 1) / 2).alias("x"), F.log("n").alias("y"), F.col("terms").cast("double").alias("w"))
    sums = points.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"))
    return sums.select(F.round((F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") * F.col("x")), 6).alias("slope"))


def vocabulary_growth(first_seen: DataFrame) -> DataFrame:
    """at and the number of terms first seen up to there, of first_seen (term, at)."""
    new = first_seen.groupBy("at").agg(F.count(F.lit(1)).alias("new"))
    return summed_before(new, "before", F.col("new"), "at").select("at", (F.col("before") + F.col("new")).alias("terms"))


def synthetic_chunks(session, n: int, versions: int = 3, words: int = 12, vocabulary: int = 5000, seed: int = 0) -> DataFrame:
    """n chunks with chained version intervals and Zipf-like words, all from hashes of ids."""
    def u(*parts):
        return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 31)).cast("double") + 0.5) / float(1 << 31)

    rows = session.range(n).withColumn("k", (1 + F.floor(u("id") * versions)).cast("int"))
    rows = rows.withColumn("v", F.explode(F.sequence(F.lit(1), F.col("k"))))
    start = F.date_add(F.to_date(F.lit("2017-01-01")), (F.col("v") - 1) * 200)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), F.floor(F.pow(F.lit(float(vocabulary)), u("id", "v", i))).cast("string"))), " ")
    ends = F.when(F.col("v") < F.col("k"), F.date_add(start, 200))
    return rows.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.col("v").alias("version"), text.alias("text"), start.alias("valid_from"), ends.alias("valid_to"))


def draw(u: Column, quantiles: Sequence[float]) -> Column:
    """A value by linear interpolation in a table of evenly spaced quantiles."""
    table = F.array(*[F.lit(float(x)) for x in quantiles])
    at = u * (len(quantiles) - 1)
    i = F.least(F.floor(at).cast("int"), F.lit(len(quantiles) - 2))
    return F.get(table, i) + (F.get(table, i + 1) - F.get(table, i)) * (at - i)
