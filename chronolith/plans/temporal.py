"""Scans, predicates, versioning and invariants (S, P, W and inv keys)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import temporal as T
from .base import AT, NOW, VERSIONS_SQL, chunks, day, instant, query, table, versions

_FORCE = f"valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')"
_BELIEF = f"system_from <= TIMESTAMP '{NOW}' AND (system_to IS NULL OR system_to > TIMESTAMP '{NOW}')"
_SHOWN = "version_id, chunk_id, part, source, authority"
_DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("p1_asof_events", f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM v WHERE {_FORCE} AND {_BELIEF}")
def p1(spark, sf):
    return T.as_of(versions(spark, sf), instant(AT), instant(NOW)).select(*_SHOWN.split(", "))


@query("p1_asof_part", f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM v WHERE {_FORCE} AND system_to IS NULL AND part = 'click'")
def p1_part(spark, sf):
    return T.as_of(versions(spark, sf), instant(AT), part="click").select(*_SHOWN.split(", "))


@query("p2_exclude", f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM v WHERE {_FORCE} AND system_to IS NULL AND part NOT IN ('click', 'view')")
def p2(spark, sf):
    return T.as_of(versions(spark, sf), instant(AT), exclude_parts=["view", "click"]).select(*_SHOWN.split(", "))


@query("p3_authority", f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM v WHERE {_FORCE} AND system_to IS NULL AND source IN ('s0', 's2') AND authority <= 3")
def p3(spark, sf):
    return T.as_of(versions(spark, sf), instant(AT), sources=["s0", "s2"], max_authority=3).select(*_SHOWN.split(", "))


@query("p4_admitted_by_scope", f"WITH {VERSIONS_SQL} SELECT part, count(*) AS admitted, min(id) AS first_id, max(id) AS last_id FROM v WHERE {_FORCE} AND {_BELIEF} AND source <> 's1' GROUP BY part")
def p4(spark, sf):
    rows = T.as_of(versions(spark, sf), instant(AT), instant(NOW), sources=["s0", "s2"])
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("admitted"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("p5_ablate_asof", f"WITH {VERSIONS_SQL} SELECT part, count(*) AS rows_all, count(*) FILTER ({_FORCE}) AS rows_in_force FROM v WHERE system_to IS NULL GROUP BY part")
def p5(spark, sf):
    every = T.as_of(versions(spark, sf), instant(AT), temporal=False)
    return every.groupBy("part").agg(F.count(F.lit(1)).alias("rows_all"), F.count_if(T.valid_at(instant(AT))).alias("rows_in_force"))


_FACETS = "(VALUES ('click', 'device', ['web', 'app']), ('view', 'device', ['web']), ('view', 'plan', ['free']), ('purchase', 'plan', ['paid'])) AS f(part, facet, allowed)"


@query("p8_excluded_parts", f"SELECT DISTINCT part FROM {_FACETS} WHERE (facet = 'device' AND NOT list_contains(allowed, 'app')) OR (facet = 'plan' AND NOT list_contains(allowed, 'paid'))")
def p8(spark, sf):
    facets = spark.createDataFrame([("click", "device", ["web", "app"]), ("view", "device", ["web"]), ("view", "plan", ["free"]), ("purchase", "plan", ["paid"])], "part string, facet string, allowed array<string>")
    return T.excluded_parts(facets, {"device": "app", "plan": "paid"})


@query("p7_governs", f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM v WHERE {_FORCE} AND system_to IS NULL AND part NOT IN (SELECT part FROM {_FACETS} WHERE facet = 'device' AND NOT list_contains(allowed, 'app'))")
def p7(spark, sf):
    facets = spark.createDataFrame([("click", "device", ["web", "app"]), ("view", "device", ["web"]), ("view", "plan", ["free"]), ("purchase", "plan", ["paid"])], "part string, facet string, allowed array<string>")
    rows = T.as_of(versions(spark, sf), instant(AT))
    return rows.join(T.excluded_parts(facets, {"device": "app"}), "part", "left_anti").select(*_SHOWN.split(", "))


@query(
    "p9_in_force_cited",
    f"""WITH {VERSIONS_SQL}, cited AS (SELECT version_id FROM v WHERE id % 97 = 0 UNION ALL SELECT 'bad id' UNION ALL SELECT '1#click@-1')
SELECT c.version_id, regexp_matches(c.version_id, '^[0-9]+#[a-z_]+@[0-9]+$') AS well_formed, coalesce(v.system_to IS NULL AND {_FORCE}, false) AS in_force FROM cited c LEFT JOIN v USING (version_id)""",
)
def p9(spark, sf):
    v = versions(spark, sf)
    cited = v.filter(F.col("id") % 97 == 0).select("version_id").unionByName(spark.createDataFrame([("bad id",), ("1#click@-1",)], "version_id string"))
    found = cited.join(v.select("version_id", "valid_from", "valid_to", "system_to"), "version_id", "left")
    return found.select("version_id", F.col("version_id").rlike("^[0-9]+#[a-z_]+@[0-9]+$").alias("well_formed"), F.coalesce(T.believed_at() & T.valid_at(instant(AT)) & F.col("valid_from").isNotNull(), F.lit(False)).alias("in_force"))


@query("p11_superseded", f"WITH {VERSIONS_SQL} SELECT part, count(*) FILTER ({_FORCE}) AS in_force, count(*) FILTER (coalesce(valid_to <= TIMESTAMP '{AT}', false)) AS superseded FROM v GROUP BY part")
def p11(spark, sf):
    return versions(spark, sf).groupBy("part").agg(F.count_if(T.valid_at(instant(AT))).alias("in_force"), F.count_if(F.col("valid_to") <= instant(AT)).alias("superseded"))


@query("p12_uncovered", "SELECT doc_id AS id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def p12(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return chunks(spark, sf).select("id", "source").join(vectors, "id", "left_anti")


@query(
    "p13_reachability",
    f"WITH {VERSIONS_SQL} SELECT source, count(*) FILTER (valid_from <= TIMESTAMP '2024-01-02 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-02 00:00:00')) AS at_floor, count(*) FILTER ({_FORCE}) AS at_latest, count(*) AS believed FROM v WHERE system_to IS NULL GROUP BY source",
)
def p13(spark, sf):
    rows = versions(spark, sf).filter(T.believed_at())
    return rows.groupBy("source").agg(F.count_if(T.valid_at(instant("2024-01-02 00:00:00"))).alias("at_floor"), F.count_if(T.valid_at(instant(AT))).alias("at_latest"), F.count(F.lit(1)).alias("believed"))


@query("s1_believed_scan", f"WITH {VERSIONS_SQL} SELECT id, version_id, text FROM v WHERE system_to IS NULL")
def s1(spark, sf):
    return versions(spark, sf).filter(T.believed_at()).select("id", "version_id", "text")


@query("s2_point_lookup", "SELECT doc_id AS id, source, n_chars FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 999999999)")
def s2(spark, sf):
    return table(spark, sf, "documents").filter(F.col("doc_id").isin(3, 5, 8, 13, 21, 999999999)).select(F.col("doc_id").alias("id"), "source", "n_chars")


@query("s3_ordered_lookup", "SELECT pos, doc_id AS id, source FROM (VALUES (0, 21), (1, 3), (2, -1), (3, 8), (4, 3)) AS r(pos, id) JOIN documents ON doc_id = r.id")
def s3(spark, sf):
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in (21, 3, -1, 8, 3)])).alias("pos", "id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return docs.join(asked, "id").select("pos", "id", "source").orderBy("pos")


@query("s7_counts", f"WITH {VERSIONS_SQL} SELECT count(*) AS rows_all, count(*) FILTER (system_to IS NULL) AS rows_believed, count(*) = 0 AS is_empty FROM v")
def s7(spark, sf):
    return versions(spark, sf).agg(F.count(F.lit(1)).alias("rows_all"), F.count_if(T.believed_at()).alias("rows_believed"), (F.count(F.lit(1)) == 0).alias("is_empty"))


@query("s9_version_dates", "SELECT DISTINCT event_type AS part, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE ts >= TIMESTAMP '2024-01-10' UNION SELECT event_type, strftime(max(ts), '%Y-%m-%d') FROM events GROUP BY 1")
def s9(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("part"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return e.filter("date >= '2024-01-10'").unionByName(e.groupBy("part").agg(F.max("date").alias("date"))).distinct()


@query("s10_latest_issue", "SELECT event_type AS part, strftime(max(ts), '%Y-%m-%d') AS latest FROM events GROUP BY 1")
def s10(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("part")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("latest"))


@query(
    "s11_final_absence",
    "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), l AS (SELECT max(ts::DATE) AS latest FROM events), n AS (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d) SELECT user_id, (day + 1)::VARCHAR AS absent, date_diff('day', day + 1, latest) > 7 AS is_final FROM n, l WHERE nxt > day + 1 OR (nxt IS NULL AND day < latest)",
)
def s11(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    latest = days.agg(F.max("day").alias("latest"))
    rows = days.withColumn("nxt", F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))).crossJoin(F.broadcast(latest))
    rows = rows.filter("nxt > day + 1 or (nxt is null and day < latest)").withColumn("absent", F.date_add("day", 1))
    return rows.select("user_id", F.col("absent").cast("string").alias("absent"), (F.datediff("latest", "absent") > 7).alias("is_final"))


@query(
    "s12_skipped_dates",
    "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, day::VARCHAR AS skipped FROM u, d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.ts::DATE = d.day)",
)
def s12(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    span = e.agg(F.collect_set("day").alias("days"))  # a calendar, not the data
    asked = e.select("user_id").distinct().crossJoin(F.broadcast(span)).select("user_id", F.explode("days").alias("day"))
    return asked.join(e, ["user_id", "day"], "left_anti").select("user_id", F.col("day").cast("string").alias("skipped"))


_SNAP = "s AS (SELECT user_id AS section, ts::DATE AS date, arg_max(event_type, (ts, event_id)) AS text FROM events GROUP BY 1, 2)"


def _snapshots(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("section"), F.to_date("ts").alias("date")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("text"))


_SCD2_SQL = f"""{_SNAP}, o AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM s)),
r AS (SELECT s.*, ord, CASE WHEN lag(text) OVER w IS NULL OR lag(ord) OVER w < ord - 1 OR lag(text) OVER w <> text THEN 1 ELSE 0 END AS new FROM s JOIN o USING (date) WINDOW w AS (PARTITION BY section ORDER BY ord)),
n AS (SELECT *, sum(new) OVER (PARTITION BY section ORDER BY ord) AS version FROM r),
g AS (SELECT section, version, min(ord) AS first, max(ord) AS last, min(date) AS valid_from, any_value(text) AS text FROM n GROUP BY section, version)"""


@query("w5_scd2_build", f"WITH {_SCD2_SQL} SELECT section, version::BIGINT AS version, text, CASE WHEN first = 1 THEN '2017-01-01' ELSE valid_from::VARCHAR END AS valid_from, o.date::VARCHAR AS valid_to FROM g LEFT JOIN o ON o.ord = last + 1")
def w5(spark, sf):
    out = T.scd2(_snapshots(spark, sf), F.to_date(F.lit("2017-01-01")))
    return out.select("section", "version", "text", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query(
    "w2_close_valid",
    f"WITH {VERSIONS_SQL}, c AS (SELECT DISTINCT section_id, source, TIMESTAMP '2024-01-25 00:00:00' AS closed_at FROM v WHERE authority = 2) SELECT version_id, {_DAY.format('CASE WHEN valid_to IS NULL AND system_to IS NULL AND valid_from < closed_at THEN closed_at ELSE valid_to END')} AS valid_to FROM v LEFT JOIN c USING (section_id, source)",
)
def w2(spark, sf):
    v = versions(spark, sf)
    closings = v.filter("authority = 2").select("section_id", "source").distinct().withColumn("closed_at", instant("2024-01-25 00:00:00"))
    return T.close_valid(v, closings).select("version_id", day("valid_to").alias("valid_to"))


@query(
    "w3_retract_belief",
    f"WITH {VERSIONS_SQL} SELECT version_id, {_DAY.format(f"coalesce(system_to, CASE WHEN id % 29 = 0 THEN TIMESTAMP '{NOW}' END)")} AS system_to FROM v",
)
def w3(spark, sf):
    v = versions(spark, sf)
    return T.retract(v, v.filter("id % 29 = 0").select("version_id", instant(NOW).alias("at"))).select("version_id", day("system_to").alias("system_to"))


@query("w1_append_stamps", "SELECT 'd' || doc_id::VARCHAR || '@2024-01-01' AS version_id, source AS doc_id, left(sha256(text), 16) AS content_hash, '2024-02-01 00:00:00' AS system_from FROM documents")
def w1(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("section_id"), F.lit(None).cast("string").alias("doc_id"), "text", F.to_date(F.lit("2024-01-01")).alias("valid_from"))
    return T.stamp(d, instant("2024-02-01 00:00:00")).select("version_id", "doc_id", "content_hash", day("system_from").alias("system_from"))


@query(
    "w7_hash_diff",
    """WITH cur AS (SELECT source AS doc, doc_id AS chunk, left(sha256(text), 16) AS hash FROM documents WHERE source <> 'src4' AND doc_id % 41 <> 7),
inc AS (SELECT source AS doc, doc_id AS chunk, left(sha256(CASE WHEN doc_id % 53 = 5 THEN upper(text) ELSE text END), 16) AS hash FROM documents WHERE source <> 'src9' AND doc_id % 41 <> CASE WHEN source IN ('src1', 'src2') THEN 7 ELSE 8 END),
b AS (SELECT coalesce(c.doc, i.doc) AS doc, c.hash AS was, i.hash AS now FROM cur c FULL JOIN inc i ON c.doc = i.doc AND c.chunk = i.chunk),
g AS (SELECT doc, count(now) AS chunks, count(*) FILTER (was IS NULL AND now IS NOT NULL) AS added, count(*) FILTER (was IS NOT NULL AND now IS NULL) AS removed, count(*) FILTER (was <> now) AS altered FROM b GROUP BY doc)
SELECT doc, chunks, added, removed, altered, CASE WHEN doc NOT IN (SELECT doc FROM cur) THEN 'new' WHEN added + removed + altered > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM g WHERE chunks > 0""",
)
def w7(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk"), "text")
    current = d.filter("doc <> 'src4' and chunk % 41 <> 7").withColumn("hash", T.content_hash(F.col("text")))
    changed = F.when(F.col("chunk") % 53 == 5, F.upper("text")).otherwise(F.col("text"))
    incoming = d.filter("doc <> 'src9'").filter(F.col("chunk") % 41 != F.when(F.col("doc").isin("src1", "src2"), 7).otherwise(8)).withColumn("hash", T.content_hash(changed))
    return T.hash_diff(current, incoming)


@query("w6_section_rows", f"WITH {VERSIONS_SQL} SELECT section_id, count(*) AS chunks, min(version_id) AS first_version, count(DISTINCT part) AS parts FROM v WHERE {_FORCE} GROUP BY section_id")
def w6(spark, sf):
    rows = versions(spark, sf).filter(T.valid_at(instant(AT)))
    return rows.groupBy("section_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("version_id").alias("first_version"), F.countDistinct("part").alias("parts"))


# Invariants: numbers of violations, all of them 0 over the events' versions.


@query("inv1_one_version", f"WITH {VERSIONS_SQL} SELECT count(*) AS violations FROM (SELECT chunk_id FROM v WHERE system_to IS NULL AND {_FORCE} GROUP BY 1 HAVING count(*) > 1)")
def inv1(spark, sf):
    return T.several_in_force(versions(spark, sf), instant(AT)).agg(F.count(F.lit(1)).alias("violations"))


@query("inv2_no_zero_width", f"WITH {VERSIONS_SQL} SELECT count(*) AS violations FROM v WHERE valid_to <= valid_from OR system_to < system_from")
def inv2(spark, sf):
    return T.zero_width(versions(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))


@query("inv3_one_open", f"WITH {VERSIONS_SQL} SELECT count(*) AS violations FROM (SELECT chunk_id FROM v WHERE system_to IS NULL AND valid_to IS NULL GROUP BY 1 HAVING count(*) > 1)")
def inv3(spark, sf):
    return T.several_open(versions(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))


@query(
    "inv4_belief_replay",
    f"WITH {VERSIONS_SQL} SELECT part, count(*) FILTER ({_BELIEF}) AS believed_then, count(*) FILTER (system_to IS NULL) AS believed_now FROM v GROUP BY part",
)
def inv4(spark, sf):
    return versions(spark, sf).groupBy("part").agg(F.count_if(T.believed_at(instant(NOW))).alias("believed_then"), F.count_if(T.believed_at()).alias("believed_now"))


@query(
    "inv5_no_overlap",
    f"WITH {VERSIONS_SQL} SELECT count(*) AS violations FROM (SELECT valid_from, max(coalesce(valid_to, TIMESTAMP '9999-12-31')) OVER (PARTITION BY chunk_id ORDER BY valid_from, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v WHERE system_to IS NULL) WHERE before > valid_from",
)
def inv5(spark, sf):
    return T.overlapping(versions(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))
