"""Smaller operators composed of others (remaining C, E, G, H, W and X keys)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import ranking as R
from ..operators import temporal as T
from ..operators import text as X
from .base import AT, VERSIONS_SQL, instant, query, table, versions
from .calibration import _LOGITS, _logits
from .evaluation import _ITEMS, _items
from .localisation import _TRACE, trace

_PROBS = f"{_LOGITS}, s AS (SELECT id, gold, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l), p AS (SELECT id, gold, list_transform(e, lambda v: v / list_sum(e)) AS p FROM s)"


@query("x9_decisive_window", f"WITH {_PROBS}, w AS (SELECT id // 5 AS claim, id, round(p[1], 9) AS entail, round(p[3], 9) AS contra FROM p) SELECT claim, arg_max(id, (greatest(entail, contra), -id)) AS window_id, max(greatest(entail, contra)) AS decisive FROM w GROUP BY claim")
def x9(spark, sf):
    p = _logits(spark, sf).withColumn("p", C.softmax(F.col("x")))
    score = F.greatest(F.round(F.get("p", 0), 9), F.round(F.get("p", 2), 9))
    rows = p.select(F.floor(F.col("id") / 5).alias("claim"), "id", score.alias("score"))
    return rows.groupBy("claim").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("window_id"), F.max("score").alias("decisive"))


@query(
    "x10_verdict_calibration",
    f"WITH {_PROBS}, c AS (SELECT round(list_max(p), 9) AS conf, list_position(p, list_max(p)) - 1 = gold AS ok, list_sum(list_transform(list_zip(p, range(0, 3)), lambda z: power(z[1] - (z[2] = gold)::INTEGER, 2))) AS b FROM p) SELECT least(floor(conf * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(ok::INTEGER), 6) AS accuracy, round(avg(b), 6) AS brier FROM c GROUP BY 1",
)
def x10(spark, sf):
    p = _logits(spark, sf).withColumn("p", C.softmax(F.col("x")))
    conf = F.round(F.array_max("p"), 9)
    brier = F.aggregate(F.transform("p", lambda v, i: F.pow(v - F.when(i == F.col("gold"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, v: a + v)
    rows = p.select(conf.alias("c"), (F.array_position("p", F.array_max("p")) - 1 == F.col("gold")).cast("int").alias("ok"), brier.alias("b"))
    return rows.groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("confidence"), F.round(F.avg("ok"), 6).alias("accuracy"), F.round(F.avg("b"), 6).alias("brier"))


@query("h13_macro_accuracy", f"WITH {_LOGITS}, c AS (SELECT gold, avg((list_position(x, list_max(x)) - 1 = gold)::INTEGER) AS a FROM l GROUP BY gold) SELECT round(avg(a), 9) AS macro FROM c")
def h13(spark, sf):
    right = (F.array_position("x", F.array_max("x")) - 1 == F.col("gold")).cast("int")
    return _logits(spark, sf).groupBy("gold").agg(F.avg(right).alias("a")).agg(F.round(F.avg("a"), 9).alias("macro"))


@query("h3_synthetic_index")
def h3(spark, sf):
    """Unit vectors from hashes of ids, for every believed row."""
    u = lambda i, s: (F.pmod(F.xxhash64("id", i, F.lit(s)), F.lit(1 << 31)).cast("double") + 0.5) / float(1 << 31)
    normal = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sqrt(-2 * F.log(u(i, 1))) * F.cos(6.283185307179586 * u(i, 2)))
    rows = versions(spark, sf).filter(T.believed_at()).select("id", normal.alias("v"))
    norm = F.sqrt(R.dot(F.col("v"), F.col("v")))
    return rows.withColumn("norm", norm).select("id", F.transform("v", lambda x: F.round(x / F.col("norm"), 6)).alias("embedding"))


@query("h17_significance", f"WITH {_ITEMS}, d AS (SELECT section, round(avg(ok::INTEGER), 6) AS rate, count(*) AS n FROM items GROUP BY section) SELECT section, rate < 0.8 AND n >= 20 AS significant FROM d")
def h17(spark, sf):
    d = _items(spark, sf).groupBy("section").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    return d.select("section", ((F.col("rate") < 0.8) & (F.col("n") >= 20)).alias("significant"))


@query("h19_trace_json", f"""WITH {_TRACE} SELECT query_id, stage, '[' || string_agg('{{"rank":' || rank::VARCHAR || ',"id":' || id::VARCHAR || '}}', ',' ORDER BY rank) || ']' AS document FROM tr GROUP BY query_id, stage""")
def h19(spark, sf):
    rows = trace(spark, sf).groupBy("query_id", "stage").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return rows.select("query_id", "stage", F.to_json("x").alias("document"))


@query("h34_document_text", "SELECT doc_id, md5(source || '. ' || text) AS digest FROM documents")
def h34(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws(". ", "source", "text").cast("binary")).alias("digest"))


@query("h26_retry_after", "SELECT event_id, greatest(1, ceil(value / 10))::BIGINT AS retry_after, coalesce(nullif(json_extract_string(props, '$.client'), ''), user_id::VARCHAR) AS client FROM events WHERE event_type = 'click'")
def h26(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'click'")
    client = F.coalesce(F.nullif(F.get_json_object("props", "$.client"), F.lit("")), F.col("user_id").cast("string"))
    return e.select("event_id", F.greatest(F.lit(1), F.ceil(F.col("value") / 10)).cast("long").alias("retry_after"), client.alias("client"))


@query("e26_incomplete_items", "WITH a AS (SELECT conv_id AS item, count(DISTINCT role) AS arms FROM conversations GROUP BY conv_id) SELECT item, arms FROM a WHERE arms < 3")
def e26(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.countDistinct("role").alias("arms")).filter("arms < 3")


@query("e12_leaks", "SELECT conv_id, count(*) FILTER (role = 'system') AS leaked, count(*) AS shown FROM conversations GROUP BY conv_id")
def e12(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("leaked"), F.count(F.lit(1)).alias("shown"))


@query("e19_functional_bootstrap")
def e19(spark, sf):
    """The area under risk over coverage, resampled by cluster: sections are few, their curves are counted per section."""
    from .calibration import items

    rows = items(spark, sf).groupBy("section", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("wrong")).collect()  # a row for each section and rounded confidence
    pdf = pd.DataFrame([r.asDict() for r in rows], columns=["section", "confidence", "n", "wrong"])
    names = sorted(pdf["section"].unique())
    import random

    draw, out = random.Random(0), []
    parts = {s: g for s, g in pdf.groupby("section")}
    for _ in range(200):
        picked = pd.concat([parts[names[draw.randrange(len(names))]] for _ in names]).groupby("confidence")[["n", "wrong"]].sum().sort_index(ascending=False).cumsum()
        coverage, risk = picked["n"] / picked["n"].iloc[-1], picked["wrong"] / picked["n"]
        before, last = coverage.shift(fill_value=0.0), risk.shift().fillna(risk)
        out.append(float(((coverage - before) * (risk + last) / 2).sum()))
    out.sort()
    return spark.createDataFrame([(out[int(0.025 * 199)], out[-(-975 * 199 // 1000)])], "lo double, hi double")


@query("c8_units")
def c8(spark, sf):
    """Retrieval units: small paragraphs merge with the one before, large ones are packed by sentences, each under its source as context."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    rows = rows.withColumn("tokens", X.token_count(F.col("text"))).filter("tokens > 0")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("unit", F.sum((F.col("tokens") >= 15).cast("int")).over(order))
    whole = rows.groupBy("doc_id", "source", "unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    spans = whole.select("doc_id", "unit", F.col("source").alias("context"), "text", F.posexplode(X.packed_spans(F.col("text"))).alias("part", "s"))
    return spans.select("doc_id", "unit", "part", "context", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


@query("w10_embedding_coverage", f"WITH {VERSIONS_SQL} SELECT part, count(*) AS believed, count(e.vec_id) AS covered FROM v LEFT JOIN embeddings e ON e.vec_id = v.id WHERE system_to IS NULL GROUP BY part")
def w10(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id")
    rows = versions(spark, sf).filter(T.believed_at()).join(vectors, F.col("id") == F.col("vec_id"), "left")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("believed"), F.count("vec_id").alias("covered"))


@query("p10_post_filter", f"WITH {VERSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY text::DOUBLE DESC, id) AS rank FROM v) SELECT section_id, id, rank::INTEGER AS rank FROM r WHERE rank <= 10 AND valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def p10(spark, sf):
    ranked = R.top(versions(spark, sf).withColumn("query_id", F.col("section_id")), 10, F.col("text").cast("double").desc(), F.col("id"))
    return ranked.filter(T.valid_at(instant(AT))).select("section_id", "id", "rank")
