"""Benchmark mining, scores, clustered statistics and the quality gate (E keys, C11, B3, B9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..operators import temporal as T
from .base import VERSIONS_SQL, query, table, versions

_ITEMS = "items AS (SELECT doc_id AS item, source AS section, lang, l.quality = 1 AS ok, l.toxic = 1 AS bad FROM documents JOIN labels l USING (doc_id))"


def _items(spark, sf):
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("item"), F.col("source").alias("section"), "lang", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("bad"))


@query("e1_split", "SELECT source AS section, CASE WHEN ('0x' || left(sha256(source), 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE < 0.5 THEN 'dev' ELSE 'test' END AS split FROM (SELECT DISTINCT source FROM documents)")
def e1(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("section")).distinct().withColumn("split", S.hash_split(F.col("section"), 0.5))


@query(
    "e2_midpoint",
    f"WITH {VERSIONS_SQL}, s AS (SELECT version_id, valid_from::DATE AS a, coalesce(valid_to::DATE, DATE '2024-03-15') AS b FROM v) SELECT version_id, CASE WHEN b - a >= 4 THEN (a + ((b - a) // 2)::INTEGER)::VARCHAR END AS sampled FROM s",
)
def e2(spark, sf):
    v = versions(spark, sf)
    at = S.midpoint(F.to_date("valid_from"), F.to_date("valid_to"), F.to_date(F.lit("2024-03-15")), 2)
    return v.select("version_id", at.cast("string").alias("sampled"))


_WORDS = "regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{2,}')"


@query("e4_document_frequency", f"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(list_transform({_WORDS}, lambda w: lower(w)))) AS word FROM documents) GROUP BY word")
def e4(spark, sf):
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z\-]{2,}"), 0), F.lower))
    return table(spark, sf, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


@query(
    "e3_salient_terms",
    f"WITH w AS (SELECT doc_id, list_filter({_WORDS}, lambda w: lower(w) NOT IN ('the', 'and', 'that', 'this', 'with', 'for', 'was')) AS w FROM documents), k AS (SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS k FROM w) SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, k, range(1, len(w) + 1)), lambda z: list_position(k, z[2]) = z[3]), lambda z: z[1])[1:14], ' ') AS terms FROM k",
)
def e3(spark, sf):
    from ..operators.text import salient_terms

    return table(spark, sf, "documents").select("doc_id", F.array_join(salient_terms(F.col("text"), ["the", "and", "that", "this", "with", "for", "was"]), " ").alias("terms"))


@query(
    "e6_temporal_items",
    f"WITH {VERSIONS_SQL}, n AS (SELECT chunk_id, part, text, id, lead(text) OVER w AS after, lead(id) OVER w AS after_id FROM v WHERE system_to IS NULL WINDOW w AS (PARTITION BY chunk_id ORDER BY valid_from, id)), c AS (SELECT * FROM n WHERE after IS NOT NULL AND after <> text) SELECT chunk_id, side, CASE side WHEN 'before' THEN id ELSE after_id END AS evidence, CASE side WHEN 'before' THEN after_id ELSE id END AS distractor FROM c, (VALUES ('before'), ('after')) AS s(side)",
)
def e6(spark, sf):
    v = versions(spark, sf).filter(T.believed_at())
    order = Window.partitionBy("chunk_id").orderBy("valid_from", "id")
    pairs = v.withColumns({"after": F.lead("text").over(order), "after_id": F.lead("id").over(order)}).filter("after is not null and after <> text")
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("id").alias("evidence"), F.col("after_id").alias("distractor")), F.struct(F.lit("after").alias("side"), F.col("after_id").alias("evidence"), F.col("id").alias("distractor"))))
    return pairs.select("chunk_id", sides.alias("s")).select("chunk_id", "s.*")


@query(
    "e7_ambiguous",
    "WITH i AS (SELECT md5(text) AS query, lang AS as_of, doc_id, source AS evidence FROM documents), c AS (SELECT *, count(DISTINCT evidence) OVER (PARTITION BY query, as_of) AS n, row_number() OVER (PARTITION BY query, as_of ORDER BY doc_id) AS i FROM i) SELECT query, as_of, doc_id FROM c WHERE n = 1 AND i = 1",
)
def e7(spark, sf):
    items = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("query"), F.col("lang").alias("as_of"), "doc_id", F.col("source").alias("evidence"))
    kept = items.groupBy("query", "as_of").agg(F.min("doc_id").alias("doc_id"), F.min("evidence").alias("a"), F.max("evidence").alias("b"))
    return kept.filter("a = b").select("query", "as_of", "doc_id")


@query("e8_scope_items", "SELECT lang AS part, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS i FROM documents) WHERE i <= 12")
def e8(spark, sf):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("source", "doc_id"))
    return table(spark, sf, "documents").withColumn("i", rank).filter("i <= 12").select(F.col("lang").alias("part"), "doc_id", "source")


@query("e9_stride", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS i FROM documents) WHERE (i - 1) % 9 = 0")
def e9(spark, sf):
    return S.stride(table(spark, sf, "documents").select("source", "doc_id"), 9, "source", "doc_id")


_GOT = "g AS (SELECT conv_id, list(role || turn::VARCHAR ORDER BY turn) AS got FROM conversations GROUP BY conv_id)"


@query(
    "e11_sufficiency",
    f"WITH {_GOT} SELECT conv_id, list_has_all(got, ['user0', 'assistant1']) OR list_has_all(got, ['system0']) AS satisfied, array_to_string(list_filter(got, lambda x: x IN ('assistant3', 'user2')), ',') AS leaked FROM g",
)
def e11(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    got = F.transform("t", lambda x: F.concat(x["role"], x["turn"].cast("string")))
    sets = F.array(F.array(F.lit("user0"), F.lit("assistant1")), F.array(F.lit("system0")))
    bad = F.array(F.lit("assistant3"), F.lit("user2"))
    return c.select("conv_id", S.satisfied(sets, got).alias("satisfied"), F.array_join(S.leaked(bad, got), ",").alias("leaked"))



@query(
    "e13_bucket_score",
    f"WITH {_ITEMS} SELECT lang AS bucket, count(*) AS n, round(avg(ok::INTEGER), 6) AS sufficiency, round(avg(bad::INTEGER), 6) AS distractor_rate, count(DISTINCT section) AS clusters FROM items GROUP BY lang",
)
def e13(spark, sf):
    flag = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return _items(spark, sf).groupBy(F.col("lang").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), flag("ok").alias("sufficiency"), flag("bad").alias("distractor_rate"), F.countDistinct("section").alias("clusters"))


_W_SQL = "round(greatest(0, (h/n + 1.959963985*1.959963985/(2*n) - 1.959963985*sqrt(h/n*(1-h/n)/n + 1.959963985*1.959963985/(4*n*n))) / (1 + 1.959963985*1.959963985/n)), 6) AS lo, round(least(1, (h/n + 1.959963985*1.959963985/(2*n) + 1.959963985*sqrt(h/n*(1-h/n)/n + 1.959963985*1.959963985/(4*n*n))) / (1 + 1.959963985*1.959963985/n)), 6) AS hi"


@query("e14_wilson", f"WITH {_ITEMS}, c AS (SELECT section, sum(ok::INTEGER)::DOUBLE AS h, count(*)::DOUBLE AS n FROM items GROUP BY section) SELECT section, {_W_SQL} FROM c".replace("1.959963985", "1.959963985::DOUBLE"))
def e14(spark, sf):
    c = S.clusters(_items(spark, sf).withColumn("hits", F.col("ok").cast("int")), "section", "hits")
    lo, hi = S.wilson(F.col("hits"), F.col("n"))
    return c.select(F.col("cluster").alias("section"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("e15_cluster_counts", f"WITH {_ITEMS} SELECT section AS cluster, count(*) AS n, sum(ok::INTEGER)::DOUBLE AS ok FROM items GROUP BY section")
def e15_counts(spark, sf):
    return S.clusters(_items(spark, sf).withColumn("ok", F.col("ok").cast("int")), "section", "ok")


_POISSON_SQL = " + ".join(f"(u > {p!r}::DOUBLE)::INTEGER" for p in S._POISSON)


@query(
    "e15_cluster_bootstrap",
    f"""WITH {_ITEMS}, c AS (SELECT section, count(*)::DOUBLE AS n, sum(ok::INTEGER)::DOUBLE AS h FROM items GROUP BY section),
w AS (SELECT sample, n, h, (('0x' || left(md5(section || ':' || sample::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM c, range(0, 500) AS s(sample)),
r AS (SELECT sample, round(CASE WHEN sum(({_POISSON_SQL}) * n) > 0 THEN sum(({_POISSON_SQL}) * h) / sum(({_POISSON_SQL}) * n) ELSE 0 END, 9) AS ratio FROM w GROUP BY sample),
o AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS i FROM r) SELECT max(ratio) FILTER (i = 13) AS lo, max(ratio) FILTER (i = 488) AS hi FROM o""",
)
def e15_boot(spark, sf):
    c = S.clusters(_items(spark, sf).withColumn("ok", F.col("ok").cast("int")), "section", "ok")
    return S.resampled_ratio(c, "ok", 500)


@query("e15_seeded_bootstrap")
def e15_seeded(spark, sf):
    rows = S.clusters(_items(spark, sf).withColumn("ok", F.col("ok").cast("int")), "section", "ok").orderBy("cluster").collect()  # one row a section
    lo, hi = S.seeded_bootstrap([r["ok"] for r in rows], [r["n"] for r in rows])
    return spark.createDataFrame([(lo, hi)], "lo double, hi double")


_PAIR = "p AS (SELECT section AS cluster, count(*) AS n, sum(ok::INTEGER - (item % 7 <> 2)::INTEGER)::DOUBLE AS diff, count(*) FILTER (ok AND item % 7 = 2) AS wins, count(*) FILTER (NOT ok AND item % 7 <> 2) AS losses FROM items GROUP BY section)"


def _pairs(spark, sf):
    items = _items(spark, sf)
    a = items.select("item", "section", F.col("ok").cast("int").alias("value"))
    b = items.select("item", (F.col("item") % 7 != 2).cast("int").alias("value"))
    return S.paired(a, b, "section")


@query("e16_paired_clusters", f"WITH {_ITEMS}, {_PAIR} SELECT * FROM p")
def e16(spark, sf):
    return _pairs(spark, sf)


@query("e16_paired_delta", f"WITH {_ITEMS}, {_PAIR} SELECT round(sum(diff) / sum(n), 9) AS delta, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses FROM p")
def e16_delta(spark, sf):
    return _pairs(spark, sf).agg(F.round(F.sum("diff") / F.sum("n"), 9).alias("delta"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


@query(
    "e16_paired_interval",
    f"""WITH {_ITEMS}, {_PAIR}, w AS (SELECT sample, n::DOUBLE AS n, diff AS h, (('0x' || left(md5(cluster || ':' || sample::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM p, range(0, 500) AS s(sample)),
r AS (SELECT sample, round(CASE WHEN sum(({_POISSON_SQL}) * n) > 0 THEN sum(({_POISSON_SQL}) * h) / sum(({_POISSON_SQL}) * n) ELSE 0 END, 9) AS ratio FROM w GROUP BY sample),
o AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS i FROM r) SELECT max(ratio) FILTER (i = 13) AS lo, max(ratio) FILTER (i = 488) AS hi FROM o""",
)
def e16_interval(spark, sf):
    return S.resampled_ratio(_pairs(spark, sf), "diff", 500)


_FACT = "list_sum(list_transform(range(1, ({x})::BIGINT + 1), lambda i: ln(i::DOUBLE)))"


@query(
    "e17_mcnemar",
    f"""WITH {_ITEMS}, {_PAIR}, k AS (SELECT cluster, wins, losses, unnest(range(0, least(wins, losses) + 1)) AS i FROM p),
s AS (SELECT cluster, wins, losses, sum(exp(coalesce({_FACT.format(x='wins + losses')}, 0) - coalesce({_FACT.format(x='i')}, 0) - coalesce({_FACT.format(x='wins + losses - i')}, 0) - (wins + losses) * ln(2::DOUBLE))) AS t FROM k GROUP BY ALL)
SELECT cluster, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * t) END, 9) AS p_value FROM s""",
)
def e17(spark, sf):
    return _pairs(spark, sf).select("cluster", "wins", "losses", F.round(S.mcnemar(F.col("wins"), F.col("losses")), 9).alias("p_value"))


@query("e18_paired_mean", f"WITH {_ITEMS} SELECT section AS cluster, count(*) AS n, round(sum(length(lang)::DOUBLE - item % 5), 6) AS diff FROM items GROUP BY section")
def e18(spark, sf):
    items = _items(spark, sf)
    a = items.select("item", "section", F.length("lang").alias("value"))
    return S.paired(a, items.select("item", (F.col("item") % 5).alias("value")), "section").select("cluster", "n", F.round("diff", 6).alias("diff"))


@query(
    "e20_gate",
    f"""WITH {_ITEMS}, r AS (SELECT lang AS bucket, count(*) AS n, avg(ok::INTEGER) AS sufficiency FROM items GROUP BY lang),
f(bucket, floor_n, floor) AS (VALUES ('en', 100, 0.8), ('fr', 100, 0.99), ('it', 10, 0.5))
SELECT coalesce(f.bucket, r.bucket) AS bucket, CASE WHEN r.bucket IS NULL THEN 'missing' WHEN f.bucket IS NULL THEN 'new' WHEN n < floor_n THEN 'incomparable' WHEN sufficiency < floor THEN 'violation' ELSE 'pass' END AS verdict FROM f FULL JOIN r ON f.bucket = r.bucket""",
)
def e20(spark, sf):
    from ..operators.localisation import gate

    run = _items(spark, sf).groupBy(F.col("lang").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("sufficiency"))
    floors = spark.createDataFrame([("en", 100, 0.8), ("fr", 100, 0.99), ("it", 10, 0.5)], "bucket string, floor_n long, floor double")
    return gate(run, floors)


@query(
    "e21_generation_2x2",
    f"WITH {_ITEMS} SELECT lang AS bucket, count(*) FILTER (ok AND bad) AS answered_wrong, count(*) FILTER (ok AND NOT bad) AS answered_right, count(*) FILTER (NOT ok AND bad) AS abstained_right, count(*) FILTER (NOT ok AND NOT bad) AS abstained_wrong, round(count(*) FILTER (ok AND bad)::DOUBLE / nullif(count(*) FILTER (ok), 0), 6) AS hallucination FROM items GROUP BY lang",
)
def e21(spark, sf):
    ok, bad = F.col("ok"), F.col("bad")
    return _items(spark, sf).groupBy(F.col("lang").alias("bucket")).agg(
        F.count_if(ok & bad).alias("answered_wrong"), F.count_if(ok & ~bad).alias("answered_right"), F.count_if(~ok & bad).alias("abstained_right"), F.count_if(~ok & ~bad).alias("abstained_wrong"),
        F.round(F.count_if(ok & bad) / F.nullif(F.count_if(ok), F.lit(0)), 6).alias("hallucination"),
    )


@query(
    "e22_strata",
    f"WITH {_ITEMS} SELECT section AS stratum, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, round(avg(ok::INTEGER), 6) AS micro FROM items GROUP BY section",
)
def e22(spark, sf):
    items = _items(spark, sf)
    wide = items.groupBy(F.col("section").alias("stratum")).pivot("lang", ["en", "fr"]).agg(F.count(F.lit(1))).na.fill(0, ["en", "fr"])
    return wide.join(items.groupBy(F.col("section").alias("stratum")).agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("micro")), "stratum")


@query(
    "e24_arms",
    "WITH a AS (SELECT conv_id AS item, role AS arm, count(*) AS turns FROM conversations GROUP BY ALL), c AS (SELECT item FROM a GROUP BY item HAVING count(DISTINCT arm) = 3) SELECT arm, count(*) AS items, sum(turns)::BIGINT AS turns FROM a WHERE item IN (SELECT item FROM c) GROUP BY arm",
)
def e24(spark, sf):
    arms = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("item"), F.col("role").alias("arm")).agg(F.count(F.lit(1)).alias("turns"))
    complete = arms.groupBy("item").agg(F.countDistinct("arm").alias("n")).filter("n = 3")
    return arms.join(complete, "item", "left_semi").groupBy("arm").agg(F.count(F.lit(1)).alias("items"), F.sum("turns").alias("turns"))


@query("e25_prompt_reuse", "SELECT sha256(text || chr(0) || role) AS prompt, min(conv_id) AS first_item, count(*) AS uses FROM conversations GROUP BY 1")
def e25(spark, sf):
    prompt = F.sha2(F.concat_ws("\0", "text", "role"), 256)
    return table(spark, sf, "conversations").groupBy(prompt.alias("prompt")).agg(F.min("conv_id").alias("first_item"), F.count(F.lit(1)).alias("uses"))


@query(
    "c11_distribution",
    "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n) AS n, round(avg(n_chars), 6) AS mean, max(n_chars) AS largest, count(*) FILTER (n_chars < 200) AS under, max(n_chars) FILTER (i = greatest(1, ceil(0.1 * n))) AS p10, max(n_chars) FILTER (i = greatest(1, ceil(0.5 * n))) AS p50, max(n_chars) FILTER (i = greatest(1, ceil(0.9 * n))) AS p90 FROM r GROUP BY lang",
)
def c11(spark, sf):
    d = table(spark, sf, "documents")
    ranks = S.nearest_rank(d, "n_chars", [0.1, 0.5, 0.9], "lang")
    rest = d.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("largest"), F.count_if(F.col("n_chars") < 200).alias("under"))
    return ranks.join(rest, "lang")


@query(
    "c12_populations",
    "SELECT unit, count(*) AS n, sum(size)::BIGINT AS total FROM (SELECT 'citation' AS unit, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS size FROM documents UNION ALL SELECT 'retrieval', 1 FROM documents) GROUP BY unit",
)
def c12(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select(F.lit("citation").alias("unit"), F.size(F.filter(F.split("text", "\n", -1), lambda x: x != "")).alias("size"))
    return lines.unionByName(d.select(F.lit("retrieval").alias("unit"), F.lit(1).alias("size"))).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


@query(
    "b3_index_quantiles",
    "WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(n) AS n, max(x) FILTER (i = least(n - 1, floor(0.25 * n))) AS q25, max(x) FILTER (i = least(n - 1, floor(0.99 * n))) AS q99 FROM r GROUP BY l_returnflag",
)
def b3(spark, sf):
    return S.index_quantile(table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.99], "l_returnflag")


@query("b9_nearest_rank", "WITH r AS (SELECT l_quantity AS x, row_number() OVER (ORDER BY l_quantity) AS i, count(*) OVER () AS n FROM lineitem) SELECT max(n) AS n, max(x) FILTER (i = ceil(0.5 * n)) AS p50, max(x) FILTER (i = ceil(0.95 * n)) AS p95 FROM r")
def b9(spark, sf):
    return S.nearest_rank(table(spark, sf, "lineitem"), "l_quantity", [0.5, 0.95])


@query(
    "e27_latency_frontier",
    "WITH e AS (SELECT event_type AS config, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), s AS (SELECT config, value FROM e WHERE (k - 1) % 5 = 0), r AS (SELECT config, value, row_number() OVER (PARTITION BY config ORDER BY value) AS i, count(*) OVER (PARTITION BY config) AS n FROM s) SELECT config, round(median(value), 6) AS p50, max(value) FILTER (i = ceil(0.95 * n)) AS p95 FROM r GROUP BY config",
)
def e27(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    s = e.filter("(k - 1) % 5 = 0").select(F.col("event_type").alias("config"), "value")  # the study's stride sample
    return s.groupBy("config").agg(F.round(F.percentile("value", 0.5), 6).alias("p50")).join(S.nearest_rank(s, "value", [0.95], "config").drop("n"), "config")


@query("e28_ablations", f"WITH {_ITEMS}, r AS (SELECT 'full' AS config, section, ok FROM items UNION ALL SELECT 'no_fr', section, ok AND lang <> 'fr' FROM items UNION ALL SELECT 'strict', section, ok AND NOT bad FROM items) SELECT config, count(*) AS n, round(avg(ok::INTEGER), 6) AS rate, count(DISTINCT section) AS clusters FROM r GROUP BY config")
def e28(spark, sf):
    items = _items(spark, sf)
    runs = {"full": F.col("ok"), "no_fr": F.col("ok") & (F.col("lang") != "fr"), "strict": F.col("ok") & ~F.col("bad")}
    rows = items.select("section", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in runs]), F.array(*runs.values()))).alias("config", "ok"))
    return rows.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"), F.countDistinct("section").alias("clusters"))


@query("e10_current_versions", f"WITH {VERSIONS_SQL} SELECT section_id, count(*) AS current FROM v WHERE system_to IS NULL AND valid_to IS NULL GROUP BY section_id")
def e10(spark, sf):
    return versions(spark, sf).filter(T.believed_at() & F.col("valid_to").isNull()).groupBy("section_id").agg(F.count(F.lit(1)).alias("current"))


@query(
    "d8_load_versions",
    f"WITH {VERSIONS_SQL} SELECT section_id, strftime(valid_from, '%Y-%m-%d') AS day, count(*) AS anchors, md5(string_agg(part || '=' || text, ';' ORDER BY valid_from, id)) AS content FROM v WHERE system_to IS NULL GROUP BY 1, 2",
)
def d8(spark, sf):
    v = versions(spark, sf).filter(T.believed_at())
    rows = v.groupBy("section_id", F.date_format("valid_from", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("anchors"), F.sort_array(F.collect_list(F.struct("valid_from", "id", "part", "text"))).alias("x"))
    content = F.md5(F.array_join(F.transform("x", lambda x: F.concat_ws("=", x["part"], x["text"])), ";").cast("binary"))
    return rows.select("section_id", "day", "anchors", content.alias("content"))
