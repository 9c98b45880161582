"""Failure localisation, replay, traces and training triples (L, T, W11 to W13 keys)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import localisation as L
from ..operators import temporal as T
from .base import AT, VERSIONS_SQL, instant, query, table, versions

_ORDER = ["admitted", "lexical", "fused", "final"]
_TRACE = """tr AS (SELECT conv_id AS query_id, stage, row_number() OVER (PARTITION BY conv_id, stage ORDER BY k, turn)::INTEGER AS rank, turn AS id FROM (
 SELECT conv_id, turn, 'admitted' AS stage, turn AS k FROM conversations UNION ALL SELECT conv_id, turn, 'lexical', -length(text) FROM conversations WHERE role <> 'system'
 UNION ALL SELECT conv_id, turn, 'fused', length(text) FROM conversations WHERE length(text) > 150 UNION ALL SELECT conv_id, turn, 'final', length(text) FROM conversations WHERE length(text) > 300))"""


def trace(spark, sf, least: int = 150):
    """A trace made from conversations: a turn is a candidate of its conversation's query."""
    c = table(spark, sf, "conversations").withColumn("n", F.length("text"))
    stages = [c.withColumns({"stage": F.lit("admitted"), "k": F.col("turn").cast("long")}), c.filter("role <> 'system'").withColumns({"stage": F.lit("lexical"), "k": -F.col("n").cast("long")})]
    stages += [c.filter(F.col("n") > least).withColumns({"stage": F.lit("fused"), "k": F.col("n").cast("long")}), c.filter("n > 300").withColumns({"stage": F.lit("final"), "k": F.col("n").cast("long")})]
    every = stages[0]
    for s in stages[1:]:
        every = every.unionByName(s)
    rank = F.row_number().over(Window.partitionBy("conv_id", "stage").orderBy("k", "turn"))
    return every.select(F.col("conv_id").alias("query_id"), "stage", rank.alias("rank"), F.col("turn").alias("id"))


_FLAGS = """fl AS (SELECT conv_id AS item, bool_or(role = 'assistant') AS admitted, bool_or(role = 'assistant' AND length(text) > 60) AS lexical, bool_or(role = 'assistant' AND length(text) > 150) AS fused, bool_or(role = 'assistant' AND length(text) > 300) AS final FROM conversations GROUP BY conv_id),
los AS (SELECT item, CASE WHEN NOT admitted THEN 'admitted' WHEN NOT lexical THEN 'lexical' WHEN NOT fused THEN 'fused' WHEN NOT final THEN 'final' ELSE 'survived' END AS stage FROM fl)"""


def _losses(spark, sf):
    said = lambda n: F.bool_or((F.col("role") == "assistant") & (F.length("text") > n))
    flags = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.bool_or(F.col("role") == "assistant").alias("admitted"), said(60).alias("lexical"), said(150).alias("fused"), said(300).alias("final"))
    return flags.select("item", L.first_loss({s: F.col(s) for s in _ORDER}).alias("stage"))


@query("l1_first_loss", f"WITH {_FLAGS} SELECT * FROM los")
def l1(spark, sf):
    return _losses(spark, sf)


@query("l3_budget", f"WITH {_FLAGS} SELECT stage, count(*) AS failures, round(count(*)::DOUBLE / (SELECT count(*) FROM los WHERE stage <> 'survived'), 6) AS share FROM los WHERE stage <> 'survived' GROUP BY stage")
def l3(spark, sf):
    return L.budget(_losses(spark, sf))


@query("l2_interventional", f"WITH {_FLAGS} SELECT item, CASE WHEN lexical THEN 'ranking' ELSE 'unreachable' END AS cause FROM fl JOIN los USING (item) WHERE stage <> 'survived'")
def l2(spark, sf):
    lost = _losses(spark, sf).filter("stage <> 'survived'").select("item")
    deep = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.bool_or((F.col("role") == "assistant") & (F.length("text") > 60)).alias("reached"))
    return deep.join(lost, "item", "left_semi").select("item", F.when(F.col("reached"), "ranking").otherwise("unreachable").alias("cause"))


@query("l4_admitted_versions", f"WITH {VERSIONS_SQL} SELECT section_id, count(DISTINCT version_id) AS admitted FROM v WHERE system_to IS NULL AND valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}') GROUP BY section_id")
def l4(spark, sf):
    return T.as_of(versions(spark, sf), instant(AT)).groupBy("section_id").agg(F.countDistinct("version_id").alias("admitted"))


_TRACE2 = _TRACE.replace("tr AS", "t2 AS").replace("length(text) > 150", "length(text) > 250")
_DIFF = f"""{_TRACE}, {_TRACE2}, a AS (SELECT query_id, stage, list(id ORDER BY rank) AS a FROM tr GROUP BY ALL), b AS (SELECT query_id, stage, list(id ORDER BY rank) AS b FROM t2 GROUP BY ALL),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.stage, b.stage) AS stage, coalesce(a, []) AS a, coalesce(b, []) AS b FROM a FULL JOIN b ON a.query_id = b.query_id AND a.stage = b.stage),
df AS (SELECT query_id, stage, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INTEGER AS entered, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS left_out, a <> b AS changed FROM j)"""


def _diffs(spark, sf):
    return L.stage_diff(trace(spark, sf), trace(spark, sf, 250))


@query("l5_stage_diff", f"WITH {_DIFF} SELECT query_id, stage, entered, left_out, changed, changed AND entered = 0 AND left_out = 0 AS reordered FROM df")
def l5(spark, sf):
    return _diffs(spark, sf)


@query("l6_first_divergence", f"WITH {_DIFF} SELECT query_id, arg_min(stage, list_position(['admitted', 'lexical', 'fused', 'final'], stage)) FILTER (changed) AS first_stage, count(*) FILTER (changed) AS changed_stages FROM df GROUP BY query_id")
def l6(spark, sf):
    return L.first_divergence(_diffs(spark, sf), _ORDER)


@query("l7_replay_sweep", f"WITH {_DIFF}, r AS (SELECT DISTINCT query_id FROM tr ORDER BY query_id DESC LIMIT 20) SELECT query_id, bool_or(changed AND stage = 'final') AS answer_changed FROM df WHERE query_id IN (SELECT query_id FROM r) GROUP BY query_id")
def l7(spark, sf):
    recent = trace(spark, sf).select("query_id").distinct().orderBy(F.col("query_id").desc()).limit(20)  # the sweep's last 20
    return _diffs(spark, sf).join(recent, "query_id", "left_semi").groupBy("query_id").agg(F.bool_or(F.col("changed") & (F.col("stage") == "final")).alias("answer_changed"))


@query("w11_trace_rows", f"WITH {_TRACE} SELECT * FROM tr")
def w11(spark, sf):
    return trace(spark, sf)


@query("w12_recent_traces", f"WITH {_TRACE} SELECT query_id, count(*) AS candidates, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM tr WHERE query_id % 9 <> 4 GROUP BY query_id ORDER BY query_id DESC LIMIT 25")
def w12(spark, sf):
    rows = trace(spark, sf)
    deleted = rows.filter("query_id % 9 = 4").select("query_id").distinct()
    left = rows.join(deleted, "query_id", "left_anti").groupBy("query_id")
    return left.agg(F.count(F.lit(1)).alias("candidates"), F.array_join(F.sort_array(F.collect_set("stage")), ",").alias("stages")).orderBy(F.col("query_id").desc()).limit(25)


@query("w13_budget_json", f"WITH {_FLAGS}, b AS (SELECT stage, count(*) AS failures FROM los WHERE stage <> 'survived' GROUP BY stage) SELECT '{{\"stage\":\"' || stage || '\",\"failures\":' || failures::VARCHAR || '}}' AS document FROM b")
def w13(spark, sf):
    return L.budget(_losses(spark, sf)).select(F.to_json(F.struct("stage", "failures")).alias("document"))


_TRIPLES = f"""WITH {VERSIONS_SQL}, n AS (SELECT chunk_id, section_id, part, id, text, lead(id) OVER w AS after_id FROM v WHERE system_to IS NULL WINDOW w AS (PARTITION BY chunk_id ORDER BY valid_from, id)),
f AS (SELECT section_id, part, id, chunk_id FROM v WHERE system_to IS NULL AND valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')),
t AS (SELECT chunk_id AS query, id AS gold, after_id AS negative, 'amendment' AS kind FROM n WHERE after_id IS NOT NULL
 UNION SELECT a.chunk_id, a.id, b.id, 'sibling' FROM f a JOIN f b ON a.section_id = b.section_id AND a.chunk_id <> b.chunk_id)"""


def triples(spark, sf):
    """query, gold, negative and kind: the next version, and siblings in force, as negatives."""
    v = versions(spark, sf)
    order = Window.partitionBy("chunk_id").orderBy("valid_from", "id")
    amended = v.filter(T.believed_at()).withColumn("after_id", F.lead("id").over(order)).filter("after_id is not null")
    force = T.as_of(v, instant(AT))
    other = force.select("section_id", F.col("chunk_id").alias("__c"), F.col("id").alias("negative"))
    siblings = force.join(other, "section_id").filter("chunk_id <> __c")
    both = amended.select(F.col("chunk_id").alias("query"), F.col("id").alias("gold"), F.col("after_id").alias("negative"), F.lit("amendment").alias("kind"))
    return both.unionByName(siblings.select(F.col("chunk_id").alias("query"), F.col("id").alias("gold"), "negative", F.lit("sibling").alias("kind"))).distinct()


@query("t1_triples", f"{_TRIPLES} SELECT * FROM t")
def t1(spark, sf):
    return triples(spark, sf)


@query("t2_siblings", f"{_TRIPLES} SELECT query, count(*) AS siblings FROM t WHERE kind = 'sibling' GROUP BY query")
def t2(spark, sf):
    return triples(spark, sf).filter("kind = 'sibling'").groupBy("query").agg(F.count(F.lit(1)).alias("siblings"))


@query("t3_contradictory", f"{_TRIPLES} SELECT query, count(DISTINCT gold) AS golds FROM t GROUP BY query HAVING count(DISTINCT gold) > 1")
def t3(spark, sf):
    return triples(spark, sf).groupBy("query").agg(F.countDistinct("gold").alias("golds")).filter("golds > 1")


@query("t4_batches", f"{_TRIPLES} SELECT query, gold, negative, row_number() OVER (PARTITION BY query ORDER BY gold, negative)::INTEGER AS batch FROM t")
def t4(spark, sf):
    # at most one example of a paragraph in a batch
    return triples(spark, sf).select("query", "gold", "negative", F.row_number().over(Window.partitionBy("query").orderBy("gold", "negative")).alias("batch"))
