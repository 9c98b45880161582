"""Host-level quality rules: rules on each whole text, and a verdict on each host.

Two base rules (length, repeated windows) fail a document by themselves. Three more (symbols, repeated
lines, word length) are evidence: alone they only make a document suspect. Documents that fail any of
the five are counted by host; the hosts' failure rates are shrunk with a beta prior that is fitted to
all hosts by the method of moments, and the verdicts are joined back to the documents:

* a host whose rate surely lies above `limit` falls with all its documents;
* a host whose rate surely lies above `tolerated` loses its suspect documents;
* on a cleaner host a suspect document stays.

"Surely" is by `z` posterior standard deviations. Only DataFrame functions are used.

Defined results: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows count each; an empty table gives no rows; input columns named like a result give way, all
others pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, free_prefix, table, with_columns, words, written

#: The most words of a text for which a window's place fits into the low bits of a long.
_PLACES = 1 << 20


def repeat_coverage(p: str) -> list[dict[str, Column]]:
    """Successive projections that end in `{p}repeat`: the words of array column `{p}w` that lie in a
    3-word window found twice or more in the array. All columns that they add start with p.

    Windows are hashed to 64 bits. Each hash is cut to 43 bits and packed with its place into one
    long, so that a primitive sort brings equal windows together; if cutting made two different
    windows of a text equal, that text takes the slower way over structs.
    """
    n = F.size(f"{p}w")
    hashes = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col(f"{p}w"), i), F.get(F.col(f"{p}w"), i + 1), F.get(F.col(f"{p}w"), i + 2))),
    ).otherwise(F.expr("array(cast(0 as bigint))"))
    cut = F.transform(f"{p}h", lambda h: h.bitwiseAND((1 << 43) - 1))
    simple = (F.size(f"{p}h") <= _PLACES) & (F.size(F.array_distinct(cut)) == F.col(f"{p}distinct"))
    packed = F.sort_array(F.transform(f"{p}h", lambda h, i: F.shiftleft(h.bitwiseAND((1 << 43) - 1), 20).bitwiseOR(i.cast("long"))))
    structs = F.sort_array(F.transform(f"{p}h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def shared(xs: str, key) -> Column:
        at = lambda i: key(F.get(F.col(xs), i))
        return F.filter(xs, lambda x, i: F.coalesce((key(x) == at(i + 1)) | F.lit(False), F.lit(False)) | F.coalesce(key(x) == at(i - 1), F.lit(False)))

    places = F.when(F.col(f"{p}packed").isNotNull(), F.transform(shared(f"{p}packed", lambda x: F.shiftright(x, 20)), lambda x: x.bitwiseAND(_PLACES - 1))).when(
        F.col(f"{p}structs").isNotNull(), F.transform(shared(f"{p}structs", lambda x: x["h"]), lambda x: x["i"].cast("long"))
    )
    covered = F.when(
        F.size(f"{p}places") > 0,
        F.aggregate(
            f"{p}places",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda s, q: F.struct((s["n"] + F.least(F.lit(3).cast("long"), q - s["last"])).alias("n"), q.alias("last")),
            lambda s: s["n"],
        ),
    ).otherwise(F.lit(0).cast("long"))
    return [
        {f"{p}h": hashes},
        {f"{p}distinct": F.size(F.array_distinct(f"{p}h"))},
        {f"{p}some": (n >= 3) & (F.col(f"{p}distinct") < F.size(f"{p}h"))},
        {f"{p}packed": F.when(F.col(f"{p}some") & simple, packed), f"{p}structs": F.when(F.col(f"{p}some") & ~simple, structs)},
        {f"{p}places": F.sort_array(F.coalesce(places, F.expr("array(cast(null as bigint))")))},
        {f"{p}places": F.filter(f"{p}places", lambda q: q.isNotNull())},
        {f"{p}repeat": covered},
    ]


#: What document_rules() adds, and the names of the rules among it.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = [*COUNTS, "base_failed"]
SUSPECT = "suspect"


def document_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10, max_dup_line_pct: int = 30, word_length: tuple[int, int] = (3, 10)) -> DataFrame:
    """docs with the counts of STATS of each whole text; base_failed tells whether a base rule fails
    it, suspect whether one of the others does."""
    p = free_prefix(docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({f"{p}w": words(text), f"{p}lines": lines})
    for step in repeat_coverage(p):
        df = df.withColumns(step)
    n, n_lines, chars = F.size(f"{p}w").cast("long"), F.size(f"{p}lines"), F.length(F.array_join(f"{p}w", "")).cast("long")
    symbols, dup = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), (n_lines - F.size(F.array_distinct(f"{p}lines"))).cast("long")
    stats = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": F.col(f"{p}repeat"), f"{p}n_lines": n_lines}
    df = with_columns(df, stats)
    lo, hi = word_length
    n, symbols, dup, chars = F.col("n_words"), F.col("n_symbols"), F.col("n_dup_lines"), F.col("word_chars")
    failed = (n < min_words) | (F.col("n_repeat_words") * 100 > n * max_repeat_pct)
    suspect = (symbols * 100 > n * max_symbol_pct) | (dup * 100 > F.col(f"{p}n_lines") * max_dup_line_pct) | (chars < n * lo) | (chars > n * hi)
    keep = [c for c in df.columns if not c.startswith(p)]
    return with_columns(df, {"base_failed": failed, SUSPECT: suspect}).select(*[f"`{c}`" for c in keep if c.lower() not in ("base_failed", SUSPECT)], "base_failed", SUSPECT)


def host_rates(rows: DataFrame, host_col: str = "source", limit: float = 0.5, tolerated: float = 0.05, z: float = 3.0) -> DataFrame:
    """A row for each host: rows, failures, the shrunk rate and the two verdicts.

    The prior's mean is the failures' share of all rows; its strength follows from the variance of
    the rates between hosts, less what chance alone would give, and lies between 2 and 1000 rows.
    """
    failed = (F.col("base_failed") | F.col(SUSPECT)).cast("long")
    hosts = rows.groupBy(F.col(f"`{host_col}`").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed"))
    hosts = written(hosts, "host-counts")
    sums = hosts.agg(
        F.sum("failed").alias("f"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("h"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ffn"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    if not sums["n"]:
        return hosts.select("host", "n", "failed", F.lit(0.0).alias("rate"), F.lit(False).alias("host_failed"), F.lit(False).alias("host_distrusted"))
    total, h = float(sums["n"]), sums["h"]
    mean = min(max(sums["f"] / total, 1e-6), 1 - 1e-6)
    # weighted one-way analysis of variance of the hosts' rates
    between = sums["ffn"] - total * (sums["f"] / total) ** 2
    spread = total - sums["nn"] / total
    excess = (between - (h - 1) * mean * (1 - mean)) / spread if spread > 0 else 0.0
    strength = min(max(mean * (1 - mean) / excess - 1, 2.0), 1000.0) if excess > 0 else 1000.0
    a, b = F.col("failed") + mean * strength, F.col("n") - F.col("failed") + (1 - mean) * strength
    rate = a / (a + b)
    surely = rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (surely > limit).alias("host_failed"), (surely > tolerated).alias("host_distrusted"))


def judged(rows: DataFrame, host_col: str = "source", **limits: float) -> DataFrame:
    """rows, which have base_failed and suspect, with kept: neither a base rule nor the host's verdict fails the document.

    The hosts with a verdict are broadcast once their count is known to be small, else joined by shuffle.
    """
    p = free_prefix(rows)
    bad = host_rates(rows, host_col, **limits).filter("host_failed or host_distrusted").select(F.col("host").alias(f"{p}host"), F.col("host_failed").alias(f"{p}bad"))
    if bad.limit(BROADCAST_KEYS // 100 + 1).count() <= BROADCAST_KEYS // 100:
        bad = F.broadcast(bad)
    df = rows.join(bad, F.col(f"`{host_col}`").eqNullSafe(F.col(f"{p}host")), "left")
    kept = ~F.col("base_failed") & F.when(F.col(f"{p}bad").isNull(), True).when(F.col(f"{p}bad"), False).otherwise(~F.col(SUSPECT))
    return with_columns(df, {"kept": kept}).drop(f"{p}host", f"{p}bad")


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits: float) -> DataFrame:
    """docs with STATS, suspect and kept. The counted rows are written once to the shared folder, as
    the hosts need all of them before the first verdict."""
    rows = written(document_rules(docs, text_col), "quality-rules")
    return judged(rows, host_col, **limits)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = document_rules(docs.select("doc_id", "source", "text")).drop("text")
    return judged(written(rows, "op10"), "source").select("doc_id", *STATS, SUSPECT, "kept")
