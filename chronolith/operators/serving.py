"""Guards, the answer cache and serving metadata, over rows of requests instead of single calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered

# Characters that look like ASCII ones, and what they look like.
CONFUSABLE, ASCII = "‘’“”–—−…", "''\"\"---."


def normalise(text: Column) -> Column:
    """Controls to blanks, look-alikes to ASCII, blanks run together. For NFKC see normalise_nfkc."""
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cc}\p{Cf}]", " "), CONFUSABLE, ASCII), r"\s+", " "))


def normalise_nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFKC")

    return normalise(nfkc(text))


def refusal(question: Column, most_chars: int = 2000, most_tokens: int = 64, most_repeats: int = 20) -> Column:
    """The first reason to refuse a question, in fixed order; null if there is none."""
    tokens = F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")
    return (
        F.when(F.length(F.trim(F.coalesce(question, F.lit("")))) == 0, "empty")
        .when(F.length(question) > most_chars, "too_long")
        .when(F.size(tokens) == 0, "no_words")
        .when(F.size(F.array_distinct(tokens)) > most_tokens, "too_many_terms")
        .when(F.size(tokens) - F.size(F.array_distinct(tokens)) > most_repeats, "repetition")
    )


def bounded(excerpts: Column, each: int, total: int) -> Column:
    """Excerpts cut to `each` characters, those left out that would not fit into `total` any more."""
    cut = F.transform(excerpts, lambda x: F.left(x, F.lit(each)))
    none = F.array().cast("array<string>")
    fits = lambda s, x: F.when(s["n"] + F.length(x) <= total, F.struct((s["n"] + F.length(x)).alias("n"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    return F.aggregate(cut, F.struct(F.lit(0).alias("n"), none.alias("kept")), fits, lambda s: s["kept"])


def neutralised(text: Column) -> Column:
    """Control tokens of chat templates made harmless."""
    return F.regexp_replace(text, r"<\|([^|>]*)\|>", "[$1]")


def cost(prompt_tokens: Column, new_tokens: Column, prefill: float = 2000.0, decode: float = 29.0) -> Column:
    """Seconds that an answer may take."""
    return prompt_tokens / prefill + new_tokens / decode


def cache_key(question: Column, as_of: Column, facets: Column, config: Column) -> Column:
    """32 hexadecimal digits of what decides an answer; facets is an array of name=value."""
    return F.substring(F.sha2(F.to_json(F.struct(F.lower(normalise(question)).alias("q"), as_of.alias("at"), F.sort_array(facets).alias("f"), config.alias("c"))), 256), 1, 32)


def cache_outcome(entries: DataFrame, believed: DataFrame, now: Column) -> DataFrame:
    """For each cached entry (key, expires, cited: version_id and hash): hit, expired, retracted or changed."""
    rows = entries.select("key", "expires", F.explode_outer("cited").alias("c"))
    b = believed.select(F.col("version_id").alias("__v"), F.col("content_hash").alias("__h"))
    rows = rows.join(b, F.col("c.version_id") == F.col("__v"), "left")
    seen = rows.groupBy("key", "expires").agg(F.count_if(F.col("c").isNotNull() & F.col("__v").isNull()).alias("gone"), F.count_if(F.col("__h") != F.col("c.hash")).alias("other"))
    outcome = F.when(F.col("expires") <= now, "expired").when(F.col("gone") > 0, "retracted").when(F.col("other") > 0, "changed").otherwise("hit")
    return seen.select("key", outcome.alias("outcome"))


def expiry(cited: DataFrame, now: Column, ttl: str) -> DataFrame:
    """key and expires of cited (key, valid_to): the least end among what is cited, dropped if past, capped by ttl."""
    least = cited.groupBy("key").agg(F.min("valid_to").alias("m"))
    cap = now + F.expr(f"interval {ttl}")
    return least.select("key", F.least(F.when(F.col("m") > now, F.col("m")), cap).alias("expires"))


def cache_put(candidates: DataFrame, believed: DataFrame, now: Column, ttl: str) -> DataFrame:
    """key, outcome and expires of entries to be stored (key, cited: version ids): refused where something cited
    is not believed (version_id, valid_to), else stored until expiry() ends it; what cites nothing is stored."""
    rows = candidates.select("key", F.explode_outer(F.array_distinct("cited")).alias("__c"))
    rows = rows.join(believed.select(F.col("version_id").alias("__v"), "valid_to"), F.col("__c") == F.col("__v"), "left")
    gone = rows.groupBy("key").agg(F.count_if(F.col("__c").isNotNull() & F.col("__v").isNull()).alias("__gone"))
    ends = expiry(rows, now, ttl)
    out = gone.withColumnRenamed("key", "__k").join(ends, F.col("__k").eqNullSafe(F.col("key")))
    return out.select("key", F.when(F.col("__gone") > 0, "refused").otherwise("stored").alias("outcome"), F.when(F.col("__gone") == 0, F.col("expires")).alias("expires"))


def evicted(entries: DataFrame, cap: int) -> DataFrame:
    """What a cache of `cap` entries loses: all but the most recently used."""
    return numbered(entries, "__i", F.col("used_seq").desc()).filter(F.col("__i") >= cap).drop("__i")


def admitted(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """Token buckets: client, id, allowed and wait of requests (client, id, at seconds).

    A bucket's state depends on each decision before, so a client's requests are walked in order. They
    are cut from the sorted partition as a stream; a client is never held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = None, burst, 0.0
        for batch in batches:
            allowed, waits = [], []
            for c, at in zip(batch["client"], batch["at"], strict=True):
                if c != client:
                    client, tokens, last = c, burst, at
                tokens = min(burst, tokens + (at - last) * rate)
                last = at
                ok = tokens >= 1
                tokens -= ok
                allowed.append(ok)
                waits.append(0.0 if ok else (1 - tokens) / rate)
            yield pd.DataFrame({"client": batch["client"], "id": batch["id"], "allowed": allowed, "wait": waits})

    rows = requests.select(F.col("client").cast("string").alias("client"), "id", "at").repartition("client").sortWithinPartitions("client", "at", "id")
    return rows.mapInPandas(run, "client string, id long, allowed boolean, wait double")


def answer_problems(claims: DataFrame, evidence: DataFrame, in_force: DataFrame) -> DataFrame:
    """answer, claim and problem of claims (answer, claim, text, cited: ids) against evidence (answer, id) and ids in force (id)."""
    base = claims.select("answer", "claim", "text", "cited")
    simple = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_claim"), F.when(F.size("cited") == 0, "uncited"), F.when(F.size("cited") != F.size(F.array_distinct("cited")), "repeated_citation"),
            F.when(F.length("text") > 2000, "long_claim"), F.when(F.col("text").rlike(r"<\|[^|>]*\|>"), "control_token"),
        )
    )
    own = base.select("answer", "claim", F.explode(simple).alias("problem"))
    cites = base.select("answer", "claim", F.explode(F.array_distinct("cited")).alias("id"))
    foreign = cites.join(evidence, ["answer", "id"], "left_anti").select("answer", "claim", F.lit("not_in_evidence").alias("problem"))
    stale = cites.join(in_force, "id", "left_anti").select("answer", "claim", F.lit("not_in_force").alias("problem"))
    return own.unionByName(foreign).unionByName(stale).distinct()


def parse_response(raw: Column, excerpts: Column) -> Column:
    """claims of a model's JSON reply, citations outside of 1..excerpts dropped; null without JSON."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "struct<claims: array<struct<text: string, cites: array<int>>>>")["claims"]
    return F.transform(parsed, lambda c: F.struct(c["text"].alias("text"), F.filter(c["cites"], lambda n: (n >= 1) & (n <= excerpts)).alias("cites")))


def prompt(question: Column, excerpts: Column) -> Column:
    """Numbered excerpts under the question."""
    lines = F.transform(excerpts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), neutralised(x)))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.array_join(lines, "\n"), F.lit('Answer as JSON: {"claims": [{"text": "...", "cites": [1]}]}'))


def iso_date(text: Column) -> Column:
    """A date that is written in full ISO form, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
