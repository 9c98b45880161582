"""Metrics, load and scale analytics (B keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..operators import metrics as M
from ..operators import ranking as R
from .base import VERSIONS_SQL, query, table, versions

_EDGES = (5, 10, 25, 50, 75, 100)
_E_SQL = ", ".join(f"({e}.0::DOUBLE)" for e in _EDGES) + ", ('Infinity'::DOUBLE)"
_HIST = f"hist AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES {_E_SQL}) AS b(le) GROUP BY event_type, le)"


def _hist(spark, sf):
    return M.histogram(table(spark, sf, "events"), "value", _EDGES, "event_type")


@query("b14_histogram", f"WITH {_HIST} SELECT event_type, CASE WHEN le = 'Infinity' THEN '+Inf' ELSE le::BIGINT::VARCHAR END AS le, n FROM hist")
def b14(spark, sf):
    le = F.when(F.col("le") == M.INF, "+Inf").otherwise(F.col("le").cast("long").cast("string"))
    return _hist(spark, sf).select("event_type", le.alias("le"), "n")


@query("b14_registry", "SELECT event_type, count(*) AS count, round(sum(value), 4) AS total, round(max(value), 6) AS peak FROM events GROUP BY event_type")
def b14_registry(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("peak"))


_LINE = """'latency_bucket{event_type="' || event_type || '",le="' || CASE WHEN le = 'Infinity' THEN '+Inf' ELSE le::BIGINT::VARCHAR END || '"} ' || n::VARCHAR"""


@query("b15_exposition", f"WITH {_HIST} SELECT {_LINE} AS line FROM hist")
def b15(spark, sf):
    return M.exposition(_hist(spark, sf), "latency", "event_type")


@query("b16_parse_exposition", f"WITH {_HIST} SELECT 'latency_bucket' AS name, event_type, CASE WHEN le = 'Infinity' THEN '+Inf' ELSE le::BIGINT::VARCHAR END AS le, n::DOUBLE AS value FROM hist")
def b16(spark, sf):
    rows = M.parse_exposition(M.exposition(_hist(spark, sf), "latency", "event_type"))
    return rows.select("name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["le"].alias("le"), "value")


@query(
    "b17_quantile",
    f"WITH {_HIST}, o AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le)), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS i FROM o WHERE n >= 0.9::DOUBLE * total) SELECT event_type, round(CASE WHEN le = 'Infinity' THEN lo ELSE lo + (le - lo) * (0.9::DOUBLE * total - below) / (n - below) END, 9) AS value, le = 'Infinity' AS clipped FROM f WHERE i = 1",
)
def b17(spark, sf):
    return M.bucket_quantile(_hist(spark, sf), 0.9, "event_type")


_LOAD = "s AS (SELECT event_id AS id, event_type AS arm, epoch(ts)::DOUBLE AS intended, epoch(ts)::DOUBLE + event_id % 3 AS sent, epoch(ts)::DOUBLE + event_id % 3 + round(value, 3) AS done, CASE WHEN event_id % 11 = 0 THEN 503 WHEN event_id % 13 = 0 THEN 500 ELSE 200 END AS status FROM events)"


def _samples(spark, sf):
    t = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    sent = t + F.col("event_id") % 3
    status = F.when(F.col("event_id") % 11 == 0, 503).when(F.col("event_id") % 13 == 0, 500).otherwise(200)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("arm"), t.alias("intended"), sent.alias("sent"), (sent + F.round("value", 3)).alias("done"), status.alias("status"))


@query(
    "b13_load_summary",
    f"WITH {_LOAD.replace('epoch(ts)', 'floor(epoch(ts))')} SELECT arm, count(*) AS requests, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 503) AS refused, count(*) FILTER (status = 500) AS failed, round(count(*) FILTER (status = 200) / (max(done) - min(intended)), 6) AS goodput, round(avg(done - intended), 6) AS mean_latency, round(max((done - intended) - (done - sent)), 6) AS most_omitted FROM s GROUP BY arm",
)
def b13(spark, sf):
    return M.load_summary(_samples(spark, sf), "arm")


@query(
    "b13_ramp",
    f"WITH {_LOAD.replace('epoch(ts)', 'floor(epoch(ts))')}, r AS (SELECT arm, done - sent AS v, row_number() OVER (PARTITION BY arm ORDER BY intended, id) AS i, count(*) OVER (PARTITION BY arm) AS n FROM s) SELECT arm, round(median(v) FILTER (i > n - greatest(1, n // 5)) - median(v) FILTER (i <= greatest(1, n // 5)), 6) AS ramp FROM r GROUP BY arm",
)
def b13_ramp(spark, sf):
    return M.ramp(_samples(spark, sf), F.col("done") - F.col("sent"), "arm")


@query("b11_uniform_arrivals", "SELECT i AS id, i / 7.5::DOUBLE AS \"offset\" FROM range(0, 300) AS r(i)")
def b11(spark, sf):
    return M.arrivals(spark, 300, 7.5)


@query("b11_poisson_arrivals")
def b11_poisson(spark, sf):
    return M.arrivals(spark, 300, 7.5, poisson=True)


_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_VOC = f"voc AS (SELECT term, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS term FROM documents) GROUP BY term)"


def _vocabulary(spark, sf):
    tokens = table(spark, sf, "documents").select(F.explode(R.tokens(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("b2_ranked_vocab", f"WITH {_VOC} SELECT term, n, row_number() OVER (ORDER BY n DESC, term)::INTEGER AS rank FROM voc")
def b2(spark, sf):
    ranked = numbered(_vocabulary(spark, sf), "i", F.col("n").desc(), "term")
    return ranked.select("term", "n", (F.col("i") + 1).cast("int").alias("rank"))


@query(
    "b4_zipf",
    f"WITH {_VOC}, c AS (SELECT n, count(*)::DOUBLE AS terms FROM voc GROUP BY n), p AS (SELECT ln(coalesce(sum(terms) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (terms + 1) / 2) AS x, ln(n::DOUBLE) AS y, terms AS w FROM c) SELECT round((sum(w) * sum(w*x*y) - sum(w*x) * sum(w*y)) / (sum(w) * sum(w*x*x) - power(sum(w*x), 2)), 6) AS slope FROM p",
)
def b4(spark, sf):
    return M.zipf_slope(_vocabulary(spark, sf))


@query("b4_heaps", f"WITH f AS (SELECT term, min(doc_id) // 50 AS \"at\" FROM (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents) GROUP BY term), g AS (SELECT \"at\", count(*) AS new FROM f GROUP BY \"at\") SELECT \"at\", (sum(new) OVER (ORDER BY \"at\"))::BIGINT AS terms FROM g")
def b4_heaps(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    return M.vocabulary_growth(tokens.groupBy("term").agg(F.floor(F.min("doc_id") / 50).cast("long").alias("at")))


@query(
    "b1_corpus_shape",
    f"WITH {VERSIONS_SQL}, c AS (SELECT chunk_id, count(*) AS versions, count(*) FILTER (system_to IS NOT NULL) AS removed FROM v GROUP BY chunk_id) SELECT versions, count(*) AS chunks, sum(removed)::BIGINT AS removed FROM c GROUP BY versions",
)
def b1(spark, sf):
    c = versions(spark, sf).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("system_to").isNotNull()).alias("removed"))
    return c.groupBy("versions").agg(F.count(F.lit(1)).alias("chunks"), F.sum("removed").alias("removed"))


@query("b6_synthetic_chunks")
def b6(spark, sf):
    return M.synthetic_chunks(spark, 2000)


@query("b7_query_sample", f"SELECT doc_id, array_to_string({_SPLIT}[1:6], ' ') AS query FROM documents WHERE doc_id % 50 = 0")
def b7(spark, sf):
    # the study's sample of queries
    return table(spark, sf, "documents").filter("doc_id % 50 = 0").select("doc_id", F.array_join(F.slice(R.tokens(F.col("text")), 1, 6), " ").alias("query"))


@query("b8_match_fraction", f"WITH t AS (SELECT doc_id, list_distinct({_SPLIT}) AS t FROM documents), q AS (SELECT ['the', 'of', 'de', 'und', 'la'] AS words) SELECT w AS term, count(*) FILTER (list_contains(t, w)) AS matched, count(*) AS n, round(count(*) FILTER (list_contains(t, w))::DOUBLE / count(*), 6) AS fraction FROM t, (SELECT unnest(words) AS w FROM q) GROUP BY w")
def b8(spark, sf):
    asked = ["the", "of", "de", "und", "la"]
    rows = table(spark, sf, "documents").select(R.tokens(F.col("text")).alias("t"))
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("t", w)).alias(w) for w in asked])
    return wide.select("n", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(w).alias("matched")) for w in asked])).alias("p")).select("p.term", "p.matched", "n", F.round(F.col("p.matched") / F.col("n"), 6).alias("fraction"))


@query("b18_json_log", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click'")
def b18(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("h1_inverse_cdf", "WITH u AS (SELECT doc_id, ((doc_id * 7919) % 1000)::DOUBLE / 1000 * 4 AS z FROM documents), q AS (SELECT [0.0::DOUBLE, 10, 30, 80, 500] AS q) SELECT doc_id, round(q[least(floor(z), 3)::INTEGER + 1] + (q[least(floor(z), 3)::INTEGER + 2] - q[least(floor(z), 3)::INTEGER + 1]) * (z - least(floor(z), 3)), 6) AS drawn FROM u, q")
def h1(spark, sf):
    u = (F.col("doc_id") * 7919 % 1000).cast("double") / 1000
    return table(spark, sf, "documents").select("doc_id", F.round(M.draw(u, [0, 10, 30, 80, 500]), 6).alias("drawn"))
