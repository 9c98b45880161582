"""Chunking, change detection, questions and claims (C, D, Q and X1 to X6 keys)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import questions as Q
from ..operators import temporal as T
from ..operators import text as X
from ..operators import verification as C
from .base import VERSIONS_SQL, query, table, versions


@query("c1_token_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''))::INTEGER AS tokens FROM documents")
def c1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query("c2_sentence_spans")
def c2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.sentence_spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query("c4_packed_spans")
def c4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.packed_spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


_ANCHORS = "a(anchor) AS (VALUES ('a-1-i'), ('b'), ('p4'), ('c-2'), (''))"


@query("c5_designator_path", f"WITH {_ANCHORS} SELECT anchor, CASE WHEN anchor = '' THEN '' ELSE array_to_string(list_transform(range(1, len(string_split(anchor, '-')) + 1), lambda n: array_to_string(string_split(anchor, '-')[1:n], '-')), '|') END AS path FROM a")
def c5(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("a-1-i", "b", "p4", "c-2", "")], "anchor string")
    return rows.select("anchor", F.array_join(X.designator_path(F.col("anchor")), "|").alias("path"))


@query(
    "c6_chapeaux",
    "WITH p AS (SELECT conv_id AS section, turn AS pos, CASE WHEN role = 'user' THEN '' ELSE 'a' || turn::VARCHAR END AS anchor, CASE WHEN role = 'user' AND turn % 4 = 0 THEN text || ':' ELSE text END AS text FROM conversations), g AS (SELECT *, CASE WHEN anchor = '' THEN CASE WHEN regexp_matches(text, ':\\s*$') THEN text ELSE '' END END AS governs FROM p) SELECT section, pos, nullif(last_value(governs IGNORE NULLS) OVER (PARTITION BY section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS chapeau FROM g",
)
def c6(spark, sf):
    user = F.col("role") == "user"
    text = F.col("text")
    p = table(spark, sf, "conversations").select(F.col("conv_id").alias("section"), F.col("turn").alias("pos"), F.when(user, "").otherwise(F.concat(F.lit("a"), F.col("turn").cast("string"))).alias("anchor"), F.when(user & (F.col("turn") % 4 == 0), F.concat(text, F.lit(":"))).otherwise(text).alias("text"))
    return X.chapeaux(p).select("section", "pos", "chapeau")


@query("c7_descendants", "WITH c AS (SELECT DISTINCT conv_id::VARCHAR AS id FROM conversations) SELECT a.id AS ancestor, count(*) AS below FROM c a JOIN c b ON starts_with(b.id, a.id) AND length(b.id) = length(a.id) + 1 GROUP BY a.id")
def c7(spark, sf):
    # a prefix join as an equi-join on what remains without the last character
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id")).distinct()
    parents = c.filter(F.length("id") > 1).select(F.expr("left(id, length(id) - 1)").alias("ancestor"))
    return parents.join(c.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").groupBy("ancestor").agg(F.count(F.lit(1)).alias("below"))


@query(
    "c9_budgeted_context",
    "WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations) SELECT conv_id, turn FROM r WHERE upto <= 600",
)
def c9(spark, sf):
    return X.budgeted(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.length("text"), 600).select("conv_id", "turn")


@query("c10_section_lines", "SELECT doc_id, 'Source ' || source || ' (' || lang || '). ' || left(split_part(text, '.', 1), 80) AS header FROM documents")
def c10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Source "), "source", F.lit(" ("), "lang", F.lit("). "), F.left(F.split_part("text", F.lit("."), F.lit(1)), F.lit(80))).alias("header"))


@query("s19_merge_anchors", "SELECT conv_id AS doc, turn AS pos, CASE WHEN n > 1 THEN role || '.' || n::VARCHAR ELSE role END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)")
def s19(spark, sf):
    return X.merged_anchors(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("role").alias("anchor")))


@query("d2_loose_equal", r"SELECT trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS folded, count(*) AS texts FROM documents GROUP BY 1 HAVING count(*) > 1")
def d2(spark, sf):
    return table(spark, sf, "documents").groupBy(X.loose(F.col("text")).alias("folded")).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")


def _adjacent(spark, sf):
    """Consecutive turns of a role as versions of one text."""
    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf, "conversations").withColumn("before", F.lag("text").over(order)).filter("before is not null").select("conv_id", "turn", "before", F.col("text").alias("after"))


@query("d1_similarity")
def d1(spark, sf):
    return _adjacent(spark, sf).withColumn("d", X.compared(F.col("before"), F.col("after"))).select("conv_id", "turn", F.round("d.similarity", 6).alias("similarity"), "d.changed")


@query("d3_change_class")
def d3(spark, sf):
    rows = _adjacent(spark, sf).withColumn("d", X.compared(F.col("before"), F.col("after")))
    return rows.select("conv_id", "turn", X.change_class(F.col("before"), F.col("after"), F.col("d")).alias("kind"))


@query("d6_word_ops")
def d6(spark, sf):
    rows = _adjacent(spark, sf).select("conv_id", "turn", F.explode(X.compared(F.col("before"), F.col("after"))["ops"]).alias("o"))
    return rows.select("conv_id", "turn", "o.*")


@query("d4_snapshot_diff")
def d4(spark, sf):
    d = table(spark, sf, "documents")
    before = d.filter("doc_id % 9 <> 2").select(F.col("doc_id").cast("string").alias("section"), "text", F.col("text").alias("raw"))
    moved = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("r"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    edited = F.when(F.col("doc_id") % 9 == 5, F.concat("text", F.lit(" one two three four"))).when(F.col("doc_id") % 9 == 6, F.upper("text")).otherwise(F.col("text"))
    after = d.filter("doc_id % 9 <> 3").select(moved.alias("section"), edited.alias("text"), F.when(F.col("doc_id") % 9 == 7, F.concat("text", F.lit("[note]"))).otherwise(edited).alias("raw"))
    return X.snapshot_diff(before, after)


@query("d5_pivot_changes", f"WITH {VERSIONS_SQL}, c AS (SELECT part, CASE WHEN lag(text) OVER w IS NULL THEN 'added' WHEN lag(text) OVER w = text THEN 'unchanged' WHEN abs(lag(text) OVER w::DOUBLE - text::DOUBLE) < 1 THEN 'editorial' ELSE 'substantive' END AS kind FROM v WINDOW w AS (PARTITION BY chunk_id ORDER BY valid_from, id)) SELECT part, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'editorial') AS editorial, count(*) FILTER (kind = 'substantive') AS substantive FROM c GROUP BY part".replace("lag(text) OVER w::DOUBLE", "(lag(text) OVER w)::DOUBLE"))
def d5(spark, sf):
    before = F.lag("text").over(Window.partitionBy("chunk_id").orderBy("valid_from", "id"))
    kind = F.when(before.isNull(), "added").when(before == F.col("text"), "unchanged").when(F.abs(before.cast("double") - F.col("text").cast("double")) < 1, "editorial").otherwise("substantive")
    kinds = ["added", "unchanged", "editorial", "substantive"]
    return versions(spark, sf).withColumn("kind", kind).groupBy("part").pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query("d7_changed_keys", f"WITH {VERSIONS_SQL}, a AS (SELECT chunk_id, text FROM v WHERE valid_from <= TIMESTAMP '2024-01-10' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')), b AS (SELECT chunk_id, text FROM v WHERE valid_from <= TIMESTAMP '2024-01-11' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-11')) SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id FROM a FULL JOIN b ON a.chunk_id = b.chunk_id WHERE a.text IS DISTINCT FROM b.text")
def d7(spark, sf):
    from .base import instant

    at = lambda d: versions(spark, sf).filter(T.valid_at(instant(d))).select("chunk_id", "text")
    both = at("2024-01-10 00:00:00").withColumnRenamed("text", "a").join(at("2024-01-11 00:00:00").withColumnRenamed("text", "b"), "chunk_id", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("chunk_id")


#: Questions about a made-up code: the driver's texts are of invented words.
QUESTIONS = [
    "So, what is the annual leave ceiling as of June 2021?",
    "What changed between 2019 and March 5, 2020 for SES members?",
    "Please tell me about § 630.310 and 5 CFR 351.403 before the 2020 amendment",
    "Am I eligible for a WGI under the general schedule?",
    "Is there any rule on RIF notices in the excepted service?",
    "List all the sections subject to paragraph (b)",
    "What was the rule back in 2018-02-30?",
    "currently, how many sections apply to it",
    "",
]
TODAY = date(2024, 6, 1)
RULES = [("pay", "gs", r"\bgeneral\s+schedule\b"), ("pay", "ses", r"\bSES\b"), ("service", "excepted", r"\bexcepted\s+service\b"), ("service", "competitive", r"\bcompetitive\s+service\b")]
SHORT = {"RIF": "reduction in force", "WGI": "within-grade increase", "SES": "senior executive service"}


def _questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, text string")


@query("q1_dates")
def q1(spark, sf):
    return _questions(spark).select("id", F.array_join(Q.dates(F.col("text"), TODAY), ",").alias("dates"))


_QS = "q(id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUESTIONS)) + ")"


@query("q3_scope", f"""WITH {_QS} SELECT id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\\bgeneral\\s+schedule\\b') <> regexp_matches(text, '(?i)\\bSES\\b') THEN CASE WHEN regexp_matches(text, '(?i)\\bSES\\b') THEN 'pay=ses' ELSE 'pay=gs' END END,
 CASE WHEN regexp_matches(text, '(?i)\\bexcepted\\s+service\\b') <> regexp_matches(text, '(?i)\\bcompetitive\\s+service\\b') THEN CASE WHEN regexp_matches(text, '(?i)\\bexcepted\\s+service\\b') THEN 'service=excepted' ELSE 'service=competitive' END END) AS scope FROM q""")
def q3(spark, sf):
    return _questions(spark).select("id", F.array_join(Q.scope(F.col("text"), RULES), ",").alias("scope"))


@query("q4_citations", f"""WITH {_QS} SELECT id, array_to_string(regexp_extract_all(text, '(?i)(?:\\d{{1,2}}\\s+CFR\\s+)?(?:§{{1,2}}\\s*|\\bsec(?:tion|\\.)?\\s*)?\\b(\\d{{3}}\\.\\d{{1,4}})\\b', 1), ',') AS citations FROM q""")
def q4(spark, sf):
    return _questions(spark).select("id", F.array_join(Q.citations(F.col("text")), ",").alias("citations"))


@query("q5_stripped")
def q5(spark, sf):
    return _questions(spark).select("id", Q.stripped(F.col("text")).alias("stripped"))


@query("q6_expanded", f"WITH {_QS} SELECT id, replace(replace(replace(text, 'SES', 'SES senior executive service'), 'WGI', 'WGI within-grade increase'), 'RIF', 'RIF reduction in force') AS expanded FROM q")
def q6(spark, sf):
    return _questions(spark).select("id", Q.expanded(F.col("text"), SHORT).alias("expanded"))


@query("q7_rewritten")
def q7(spark, sf):
    text = F.col("text")
    return _questions(spark).select("id", Q.rewritten(Q.stripped(Q.without_dates(text, TODAY)), Q.stripped(text), text).alias("rewritten"))


@query("q8_classified")
def q8(spark, sf):
    return _questions(spark).select("id", Q.classified(F.col("text")).alias("c")).select("id", "c.*")


@query("q9_multi_hop", f"""WITH {_QS} SELECT id, regexp_matches(text, '(?i)\\b(subject\\s+to|except\\s+as|pursuant\\s+to|under\\s+(section|paragraph)|referred\\s+to\\s+in)\\b') OR len(list_distinct(regexp_extract_all(text, '(?i)(?:\\d{{1,2}}\\s+CFR\\s+)?(?:§{{1,2}}\\s*|\\bsec(?:tion|\\.)?\\s*)?\\b(\\d{{3}}\\.\\d{{1,4}})\\b', 1))) >= 2 AS multi_hop FROM q""")
def q9(spark, sf):
    return _questions(spark).select("id", Q.multi_hop(F.col("text")).alias("multi_hop"))


@query("q10_plans")
def q10(spark, sf):
    rows = _questions(spark).withColumns({"conv_id": F.floor(F.col("id") / 3), "turn": F.col("id")})
    rows = Q.carried(rows).withColumn("dates", Q.dates(F.col("text"), TODAY))
    own = F.when(F.size("dates") > 0, F.element_at(F.when(F.size("dates") > 0, F.col("dates")), -1))
    held = F.last(own, ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", Q.classified(F.col("text"))["kind"].alias("kind"), held.alias("as_of"), F.array_join(Q.scope(F.col("text"), RULES), ",").alias("scope"), "retrieval")


@query("q11_carry")
def q11(spark, sf):
    return Q.carried(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "elliptical", "retrieval")


@query("x1_align")
def x1(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("source", F.lag("text").over(order)).filter("source is not null and role = 'assistant'")
    return rows.select("conv_id", "turn", C.align(F.col("text"), F.col("source")).alias("a")).select("conv_id", "turn", F.round("a.share", 6).alias("share"), "a.length", "a.start")


@query("x2_grounded")
def x2(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("source", F.lag("text").over(order)).filter("source is not null")
    return rows.groupBy("conv_id").agg(F.bool_or(C.align(F.col("text"), F.col("source")).isNotNull()).alias("grounded"))


CLAIMS = [
    ("An agency may not deny leave unless notice was given; other rules apply.", "Leave cannot be denied, except where notice was given."),
    ("Employees are covered, except temporary (under 90 days) staff. The agency shall act.", "Employees are covered."),
    ("Only if the head approves, subject to § 630.310, provided that funds exist.", "The head must approve; only then, and subject to funds."),
    ("No condition here:", None),
]


@query("x3_qualifiers")
def x3(spark, sf):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLAIMS)], "id int, text string")
    return rows.select("id", F.explode(C.qualifiers(F.col("text"))).alias("q")).select("id", "q.*")


@query("x5_chapeau", "SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ':' ELSE '' END, '[:—–]\\s*$|--\\s*$') AS chapeau, regexp_replace(conv_id::VARCHAR || '#a-' || turn::VARCHAR, '-[^-]*$', '') AS parent FROM conversations")
def x5(spark, sf):
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, ":").otherwise(""))
    chunk = F.concat(F.col("conv_id").cast("string"), F.lit("#a-"), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", C.has_chapeau(text).alias("chapeau"), C.parent_id(chunk).alias("parent"))


@query("x6_unstated")
def x6(spark, sf):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CLAIMS)], "id int, text string, answer string")
    rows = rows.select("id", "answer", F.explode(C.qualifiers(F.col("text"))).alias("q"))
    return rows.select("id", "q.kind", (~F.coalesce(C.acknowledged(F.col("q.clause"), F.col("q.kind"), F.col("answer")), F.lit(False))).alias("unstated"))


_LOW = "list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z\\-]{{2,}}'), lambda w: lower(w)))"


@query(
    "e5_shared_query",
    f"""WITH a AS (SELECT conv_id, turn, text AS after, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations), s AS (SELECT conv_id, turn, unnest(list_intersect({_LOW.format(x='before')}, {_LOW.format(x='after')})) AS w FROM a WHERE before IS NOT NULL),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest({_LOW.format(x='text')}) AS w FROM conversations) GROUP BY w), k AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY df, w) AS i FROM s JOIN df USING (w)) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS query FROM k WHERE i <= 14 GROUP BY conv_id, turn""",
)
def e5(spark, sf):
    rows = _adjacent(spark, sf).withColumn("w", F.explode(F.array_intersect(F.transform(X.words(F.col("before")), F.lower), F.transform(X.words(F.col("after")), F.lower))))
    df = table(spark, sf, "conversations").select(F.explode(F.array_distinct(F.transform(X.words(F.col("text")), F.lower))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(df, "w").groupBy("conv_id", "turn").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "w"))), 1, 14).alias("t"))
    return ranked.select("conv_id", "turn", F.array_join("t.w", " ").alias("query"))
