"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token target. Complete epochs of the source are taken first; what is then left
of the target is filled by documents in the order of exponential keys -ln(u) / weight, where u is a
hash of the document's id and text and the weight its quality, so that a better document tends to
come earlier. The prefix of that order which fits is taken; then the one further document whose size
lies nearest to what is still open is added, if the total comes closer to the target by it.

Nothing hot is gathered in one task: rows that agree in everything the mix looks at are counted as one
group; keys are cut into buckets by their logarithm, as many as the number of groups asks for; sizes
are summed by (source, bucket), and only buckets get running sums. Sources themselves are numbered by
ranges, and the level of the targets is found by sums over them. Only DataFrame functions are used.

Defined results: a null source is a source; a null or empty text has size 0 and is taken with 0
words; documents of equal or null id are told apart by their text; of rows equal in id, text and
source, which are interchangeable here, as many as the total asks for are taken once more; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from .common import BROADCAST_KEYS, free_prefix, table, word_count, written

#: Buckets for each factor e of the keys at least, and the number of groups that asks for one more.
GRAIN, GROUPS = 64, 100_000
#: Rows that one row is repeated into at once.
REPEAT = 1000


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from an id and a text: 48 bits of the MD5 of "seed:id:MD5 of the text"."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weight(text: Column, size: Column) -> Column:
    """Words in relation to words and symbols: 1 for plain prose, near 0 for rows of symbols."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return (size + 1) / (size + symbols + 1)


def sampling_key(id_col: Column, text: Column, size: Column, seed: int) -> Column:
    return -F.log(uniform(id_col, text, seed)) / quality_weight(text, size)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """A row for each source: its size, target, epochs and remainder.

    sizes has source and size, one row a source. Sources by code point, null last, weigh `weights`,
    repeating. A target stops at max_epochs times the source's size; what is above is shared again
    by weight until none is above: each round caps the sources whose share at the present level is
    above, and the level of the others rises. The driver sees sums only.
    """
    ws = F.array(*[F.lit(float(x)) for x in weights])
    df = numbered(sizes, "__i", F.col("source").isNull(), F.col("source").cast("binary"))
    df = df.select("source", "size", F.get(ws, (F.col("__i") % len(weights)).cast("int")).alias("__w"), (F.col("size").cast("double") * max_epochs).alias("__cap"))
    df = written(df, "mix-sources")
    level, capped = 0.0, -1
    while True:
        below = F.col("__cap") / F.col("__w") < level
        sums = df.agg(F.sum("size").alias("t"), F.count_if(below).alias("n"), F.sum(F.when(below, F.col("__cap")).otherwise(0.0)).alias("c"), F.sum(F.when(~below, F.col("__w"))).alias("w")).first()
        if sums["n"] == capped or not sums["w"]:
            break
        capped, level = sums["n"], (float(sums["t"]) * share - sums["c"]) / sums["w"]
    target = F.col("__cap") if not sums["w"] else F.least(F.col("__cap"), F.lit(level) * F.col("__w"))
    df = df.withColumn("target", target)
    epochs = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_epochs))).otherwise(0).cast("long")
    return df.select("source", F.col("size").alias("source_size"), "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("size")).alias("rest"))


def mixed_groups(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """A row for each group of equal rows of sized, which has source, size, key and any others.

    n rows of a group are there; the mix takes each of them `epochs` times and `extra` of them once more.
    """
    names = sized.columns
    rows = sized.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in names])), "mix-groups")
    grain = max(GRAIN, rows.count() // GROUPS)
    rows = rows.withColumn("__bucket", F.floor(F.log("key") * grain))
    whole = F.col("size") * F.col("n")
    buckets = rows.groupBy("source", "__bucket").agg(F.sum(whole).alias("__sum"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("__sum").alias("size")), weights, max_epochs, share).withColumnRenamed("source", "__s")
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "__sum")
    starts = written(starts.withColumnsRenamed({"source": "__s", "__bucket": "__b"}), "mix-starts")
    df = rows.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    running = Window.partitionBy("source", "__bucket").orderBy("key", "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__open", F.col("rest") - F.col("__start") - F.sum(whole).over(running) + whole)  # of the remainder, before this group
    fits = F.when(F.col("size") > 0, F.greatest(F.least(F.floor(F.col("__open") / F.col("size")), F.col("n")), F.lit(0))).otherwise(0).cast("long")
    df = written(df.withColumn("__fits", fits).drop("__bucket", "__start"), "mix-prefix")
    # what the prefix leaves open, and the document nearest to it
    left = F.col("__open") - F.col("__fits") * F.col("size")
    gaps = df.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("__fits") > 0, left)), F.max("rest")).alias("__gap")).withColumnRenamed("source", "__s")
    near = df.filter((F.col("__fits") < F.col("n")) & (F.col("size") > 0)).groupBy("source", "size").agg(F.min(F.struct("key", "__tie")).alias("first"))
    near = near.join(gaps, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__off", F.abs(F.col("size") - F.col("__gap")))
    last = near.groupBy("source", "__gap").agg(F.min(F.struct("__off", "first.key", "first.__tie", "size")).alias("x")).filter(F.col("x.__off") < F.col("__gap"))
    last = last.select(F.col("source").alias("__s"), F.col("x.key").alias("__k"), F.col("x.__tie").alias("__t"), F.col("x.size").alias("__z"))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k")) & (F.col("__tie") == F.col("__t")) & (F.col("size") == F.col("__z"))
    df = df.join(last, same, "left")
    epochs = F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.greatest("epochs", F.lit(1)))
    extra = F.col("__fits") + F.col("__k").isNotNull().cast("long")
    return df.select(*[f"`{c}`" for c in names], "n", "source_size", "target", epochs.alias("epochs"), extra.alias("extra"))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as `times` says; a row of many is first cut into parts that are dealt out."""
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / REPEAT))))
    many = parts.filter(F.col(times) > REPEAT).repartition("__part")
    parts = parts.filter(F.col(times) <= REPEAT).unionByName(many)
    count = F.least(F.lit(REPEAT), F.col(times) - F.col("__part") * REPEAT)
    return parts.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), count))).drop("__part", "__i", times)


def mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """sized, with columns source, size and key and any others, with source_size, target and copies.

    copies is how often the mix takes the document. sized is read once and should be cheap.
    """
    groups = mixed_groups(sized, weights, max_epochs, share)
    kinds = F.array(F.struct((F.col("epochs") + 1).alias("copies"), F.col("extra").alias("times")), F.struct(F.col("epochs").alias("copies"), (F.col("n") - F.col("extra")).alias("times")))
    rows = groups.withColumn("__kind", F.explode(F.filter(kinds, lambda k: k["times"] > 0)))
    rows = rows.select(*[f"`{c}`" for c in sized.columns], "source_size", "target", "__kind.copies", F.col("__kind.times").alias("__times"))
    return _repeated(rows, "__times")


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8) -> DataFrame:
    """id, source, size in words and sampling key of each document, without its text."""
    text = F.col(f"`{text_col}`")
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), text.alias("__text"))
    return df.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("__text"), F.col("size"), seed).alias("key"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(sized_documents(docs))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 8, **plan) -> DataFrame:
    """docs, with doc_id, text and source, as the mix takes them: a document that is taken twice has two rows.

    Only counts are joined back, so texts move once at most. Where the prefix ends inside a group of
    rows of equal id, text and source, the rows of that group are numbered, by ranges.
    """
    p = free_prefix(docs)
    groups = written(mixed_groups(sized_documents(docs, seed=seed), **plan), "mix-plan")
    named = {c: F.col(c).alias(f"{p}{c}") for c in ("doc_id", "source", "key", "n", "epochs", "extra")}
    taken = groups.filter("epochs + extra > 0").select(*named.values())
    if taken.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        taken = F.broadcast(taken)
    # never null; said so, as the join would else compute the key once more to sift nulls out
    key = F.coalesce(sampling_key(F.col("doc_id"), F.col("text"), word_count(F.col("text")), seed), F.lit(0.0))
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}doc_id")) & F.col("source").eqNullSafe(F.col(f"{p}source")) & (F.col(f"{p}own") == F.col(f"{p}key"))
    rows = docs.withColumn(f"{p}own", key).join(taken, same)
    n, extra = F.col(f"{p}n"), F.col(f"{p}extra")
    split = (extra > 0) & (extra < n)
    copies = F.col(f"{p}epochs") + F.when(extra == n, 1).otherwise(0)
    plain = rows.filter(~split).withColumn(f"{p}copies", copies)
    if not groups.filter("extra > 0 and extra < n").isEmpty():
        order = [F.col(f"{p}source"), F.col(f"{p}doc_id"), F.col(f"{p}key")]
        inside = numbered(rows.filter(split), f"{p}i", *order, F.monotonically_increasing_id())
        firsts = inside.groupBy(f"{p}source", f"{p}doc_id", f"{p}key").agg(F.min(f"{p}i").alias(f"{p}first")).withColumnsRenamed({f"{p}source": f"{p}s", f"{p}doc_id": f"{p}d", f"{p}key": f"{p}k"})
        inside = inside.join(firsts, F.col(f"{p}source").eqNullSafe(F.col(f"{p}s")) & F.col(f"{p}doc_id").eqNullSafe(F.col(f"{p}d")) & (F.col(f"{p}key") == F.col(f"{p}k")))
        inside = inside.withColumn(f"{p}copies", F.col(f"{p}epochs") + (F.col(f"{p}i") - F.col(f"{p}first") < extra).cast("long"))
        plain = plain.unionByName(inside.select(*[f"`{c}`" for c in plain.columns]))
    return plain.filter(F.col(f"{p}copies") > 0).withColumn(f"{p}c", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies")))).select(*[f"`{c}`" for c in docs.columns])
