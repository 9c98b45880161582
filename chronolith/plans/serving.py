"""Guards, cache and serving metadata (V keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving as V
from ..operators import temporal as T
from .base import AT, NOW, VERSIONS_SQL, day, instant, query, table, versions

_FORCE = f"valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')"


@query(
    "v1_normalise",
    r"""SELECT doc_id, md5(trim(regexp_replace(translate(regexp_replace(text, '[\p{Cc}\p{Cf}]', ' ', 'g'), '‘’“”–—−…', chr(39) || chr(39) || '""---.'), '\s+', ' ', 'g'))) AS digest FROM documents""",
)
def v1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(V.normalise(F.col("text")).cast("binary")).alias("digest"))


@query("v1_nfkc")
def v1_nfkc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(V.normalise_nfkc(F.col("text")).cast("binary")).alias("digest"))


_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(
    "v3_refusals",
    f"WITH t AS (SELECT doc_id, text, {_TOK} AS k FROM documents) SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) > 2000 THEN 'too_long' WHEN len(k) = 0 THEN 'no_words' WHEN len(list_distinct(k)) > 64 THEN 'too_many_terms' WHEN len(k) - len(list_distinct(k)) > 20 THEN 'repetition' END AS reason FROM t",
)
def v3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.refusal(F.col("text")).alias("reason"))


@query("v2_tokens", f"SELECT doc_id, len({_TOK})::INTEGER AS tokens, len(list_distinct({_TOK}))::INTEGER AS different FROM documents")
def v2(spark, sf):
    from ..operators.ranking import tokens

    return table(spark, sf, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("tokens"), F.size(F.array_distinct(tokens(F.col("text")))).alias("different"))


@query("v4_bounded_excerpts")
def v4(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"))
    kept = V.bounded(F.col("x"), 200, 500)
    return c.select("conv_id", F.size("x").alias("given"), F.size(kept).alias("kept"), F.length(F.array_join(kept, "")).alias("chars"))


@query("v5_neutralise", r"SELECT conv_id, turn, regexp_replace('<|' || role || '|>' || text, '<\|([^|>]*)\|>', '[\1]', 'g') AS safe FROM conversations")
def v5(spark, sf):
    raw = F.concat(F.lit("<|"), "role", F.lit("|>"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", V.neutralised(raw).alias("safe"))


@query("v6_cost", "SELECT doc_id, round(n_chars / 4::DOUBLE / 2000 + 200 / 29::DOUBLE, 6) AS seconds, n_chars / 4::DOUBLE / 2000 + 200 / 29::DOUBLE > 8 AS refused FROM documents")
def v6(spark, sf):
    c = V.cost(F.col("n_chars") / 4, F.lit(200))
    return table(spark, sf, "documents").select("doc_id", F.round(c, 6).alias("seconds"), (c > 8).alias("refused"))


@query("v7_token_bucket")
def v7(spark, sf):
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return V.admitted(table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), at.alias("at")), 1 / 20000, 3)


@query(
    "v9_answer_problems",
    f"""WITH {VERSIONS_SQL}, c AS (SELECT user_id AS answer, event_id AS claim, CASE WHEN event_id % 31 = 0 THEN ' ' ELSE event_type END AS text, CASE WHEN event_id % 23 = 0 THEN []::BIGINT[] WHEN event_id % 19 = 0 THEN [event_id, event_id] ELSE [event_id, event_id + 1] END AS cited FROM events),
e AS (SELECT DISTINCT user_id AS answer, event_id AS id FROM events), f AS (SELECT id FROM v WHERE system_to IS NULL), x AS (SELECT answer, claim, unnest(list_distinct(cited)) AS id FROM c)
SELECT answer, claim, 'empty_claim' AS problem FROM c WHERE trim(text) = '' UNION SELECT answer, claim, 'uncited' FROM c WHERE len(cited) = 0 UNION SELECT answer, claim, 'repeated_citation' FROM c WHERE len(cited) <> len(list_distinct(cited))
UNION SELECT answer, claim, 'not_in_evidence' FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.answer = x.answer AND e.id = x.id) UNION SELECT answer, claim, 'not_in_force' FROM x WHERE id NOT IN (SELECT id FROM f)""",
)
def v9(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    cited = F.when(i % 23 == 0, F.array().cast("array<bigint>")).when(i % 19 == 0, F.array(i, i)).otherwise(F.array(i, i + 1))
    claims = e.select(F.col("user_id").alias("answer"), i.alias("claim"), F.when(i % 31 == 0, " ").otherwise(F.col("event_type")).alias("text"), cited.alias("cited"))
    evidence = e.select(F.col("user_id").alias("answer"), i.alias("id")).distinct()
    return V.answer_problems(claims, evidence, versions(spark, sf).filter(T.believed_at()).select("id"))


@query(
    "v10_cache_key",
    "SELECT conv_id, turn, left(sha256('{\"q\":\"' || lower(role) || '\",\"at\":\"2024-01-16\",\"f\":[\"a=1\",\"t=' || turn::VARCHAR || '\"],\"c\":\"cfg\"}'), 32) AS key FROM conversations",
)
def v10(spark, sf):
    facets = F.array(F.concat(F.lit("t="), F.col("turn").cast("string")), F.lit("a=1"))
    return table(spark, sf, "conversations").select("conv_id", "turn", V.cache_key(F.upper("role"), F.lit("2024-01-16"), facets, F.lit("cfg")).alias("key"))


_ENTRIES = "en AS (SELECT chunk_id AS key, max(valid_from) + INTERVAL 10 DAY AS expires, list(version_id) AS cited FROM v GROUP BY chunk_id)"


@query(
    "v11_cache_outcome",
    f"WITH {VERSIONS_SQL}, {_ENTRIES}, x AS (SELECT key, any_value(expires) AS expires, count(*) FILTER (b.version_id IS NULL) AS gone, count(*) FILTER (b.id % 37 = 0) AS other FROM (SELECT key, expires, unnest(cited) AS version_id FROM en) u LEFT JOIN (SELECT * FROM v WHERE system_to IS NULL) b USING (version_id) GROUP BY key) SELECT key, CASE WHEN expires <= TIMESTAMP '2024-02-05 00:00:00' THEN 'expired' WHEN gone > 0 THEN 'retracted' WHEN other > 0 THEN 'changed' ELSE 'hit' END AS outcome FROM x",
)
def v11(spark, sf):
    v = versions(spark, sf)
    seen = F.when(F.col("id") % 37 == 0, "stale").otherwise(F.col("content_hash"))
    entries = v.groupBy(F.col("chunk_id").alias("key")).agg((F.max("valid_from") + F.expr("interval 10 days")).alias("expires"), F.collect_list(F.struct("version_id", seen.alias("hash"))).alias("cited"))
    return V.cache_outcome(entries, v.filter(T.believed_at()), instant("2024-02-05 00:00:00"))


@query("v12_cache_put", f"WITH {VERSIONS_SQL}, m AS (SELECT section_id AS key, min(valid_to) AS m, count(*) FILTER (system_to IS NOT NULL) AS gone FROM v WHERE valid_from > TIMESTAMP '2024-01-18' GROUP BY section_id) SELECT key, CASE WHEN gone > 0 THEN 'refused' ELSE 'stored' END AS outcome, CASE WHEN gone = 0 THEN strftime(least(CASE WHEN m > TIMESTAMP '{NOW}' THEN m END, TIMESTAMP '{NOW}' + INTERVAL 2 DAY), '%Y-%m-%d %H:%M:%S') END AS expires FROM m")
def v12(spark, sf):
    v = versions(spark, sf)
    asked = v.filter(F.col("valid_from") > instant("2024-01-18 00:00:00")).groupBy(F.col("section_id").alias("key")).agg(F.collect_list("version_id").alias("cited"))
    return V.cache_put(asked, v.filter(T.believed_at()), instant(NOW), "2 days").select("key", "outcome", day("expires").alias("expires"))


@query("v13_expiry", f"WITH {VERSIONS_SQL}, m AS (SELECT section_id AS key, min(valid_to) AS m FROM v WHERE valid_from > TIMESTAMP '2024-01-18' GROUP BY section_id) SELECT key, strftime(least(CASE WHEN m > TIMESTAMP '{NOW}' THEN m END, TIMESTAMP '{NOW}' + INTERVAL 2 DAY), '%Y-%m-%d %H:%M:%S') AS expires FROM m")
def v13(spark, sf):
    cited = versions(spark, sf).filter(F.col("valid_from") > instant("2024-01-18 00:00:00")).select(F.col("section_id").alias("key"), "valid_to")
    return V.expiry(cited, instant(NOW), "2 days").select("key", day("expires").alias("expires"))


@query("v14_lru", "WITH e AS (SELECT user_id AS key, max(event_id) AS used_seq FROM events GROUP BY user_id) SELECT key, used_seq FROM (SELECT *, row_number() OVER (ORDER BY used_seq DESC) AS i FROM e) WHERE i > 64")
def v14(spark, sf):
    return V.evicted(table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("used_seq")), 64)


@query("v15_cache_stats", "SELECT event_type AS outcome, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def v15(spark, sf):
    e = table(spark, sf, "events")
    total = e.agg(F.count(F.lit(1)).alias("t"))
    return e.groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("v15_invalidate", f"WITH {VERSIONS_SQL} SELECT key FROM (SELECT DISTINCT section_id AS key FROM v) WHERE key NOT IN (SELECT section_id FROM v WHERE part = 'purchase' AND id % 5 = 0)")
def v15_invalidate(spark, sf):
    v = versions(spark, sf)
    gone = v.filter("part = 'purchase' and id % 5 = 0").select(F.col("section_id").alias("key"))
    return v.select(F.col("section_id").alias("key")).distinct().join(gone, "key", "left_anti")


@query("v16_believed_lookup", f"WITH {VERSIONS_SQL} SELECT version_id, left(sha256(text), 16) AS content_hash FROM v WHERE system_to IS NULL AND id % 101 = 3")
def v16(spark, sf):
    v = versions(spark, sf)
    asked = v.filter("id % 101 = 3").select("version_id")
    return v.filter(T.believed_at()).join(asked, "version_id", "left_semi").select("version_id", "content_hash")


@query("v17_pinned", "WITH g AS (SELECT conv_id, list(turn) FILTER (turn < 4) AS parent, list(turn) FILTER (role = 'assistant') AS cited FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(list_has_all(coalesce(parent, []), coalesce(cited, [])), true) AS pinned FROM g")
def v17(spark, sf):
    none = F.array().cast("array<bigint>")
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") < 4, F.col("turn"))).alias("parent"), F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("cited"))
    return g.select("conv_id", (F.size(F.array_except(F.coalesce("cited", none), F.coalesce("parent", none))) == 0).alias("pinned"))


@query("v18_meta", f"WITH {VERSIONS_SQL} SELECT part, count(*) AS versions, count(DISTINCT section_id) AS sections, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') AS first_from, strftime(max(valid_from), '%Y-%m-%d %H:%M:%S') AS last_from FROM v GROUP BY part")
def v18(spark, sf):
    return versions(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("section_id").alias("sections"), day(F.min("valid_from")).alias("first_from"), day(F.max("valid_from")).alias("last_from"))


@query("v19_timeline", f"WITH {VERSIONS_SQL} SELECT section_id, strftime(valid_from, '%Y-%m-%d') AS day, min(part) AS heading, count(*) AS chunks FROM v WHERE system_to IS NULL GROUP BY 1, 2")
def v19(spark, sf):
    return versions(spark, sf).filter(T.believed_at()).groupBy("section_id", F.date_format("valid_from", "yyyy-MM-dd").alias("day")).agg(F.min("part").alias("heading"), F.count(F.lit(1)).alias("chunks"))


@query("v20_version_text", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def v20(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return c.select("conv_id", F.md5(F.array_join("x.text", " ").cast("binary")).alias("digest"))


@query("v21_iso_date", "SELECT x AS text, CASE WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(x AS DATE)::VARCHAR END AS date FROM (VALUES ('2024-02-29'), ('2023-02-29'), ('2024-2-9'), ('24-02-09'), (''), ('2024-01-01T00:00')) AS t(x)")
def v21(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("2024-02-29", "2023-02-29", "2024-2-9", "24-02-09", "", "2024-01-01T00:00")], "text string")
    return rows.select("text", V.iso_date(F.col("text")).cast("string").alias("date"))


@query("v23_parse_response", "SELECT conv_id, turn, 'a' AS claim, '1,2' AS cites FROM conversations UNION ALL SELECT conv_id, turn, role, '3' FROM conversations")
def v23(spark, sf):
    raw = F.concat(F.lit('Sure: {"claims": [{"text": "a", "cites": [1, 9, 2]}, {"text": "'), "role", F.lit('", "cites": [0, 3]}]} done'))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(V.parse_response(raw, F.lit(3))).alias("c"))
    return c.select("conv_id", "turn", F.col("c.text").alias("claim"), F.array_join(F.transform("c.cites", lambda n: n.cast("string")), ",").alias("cites"))
