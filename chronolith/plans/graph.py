"""Cross-references and walks (G keys) over documents as a code of sections.

Six documents make a section; their texts are followed by references that their numbers imply.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import temporal as T
from .base import AT, VERSIONS_SQL, instant, query, table, versions

_ANCHORS = ("a", "a-1", "a-2", "b", "b-1", "b-1-i")


def _section(g):
    return F.concat((100 + g % 800).cast("string"), F.lit("."), (1 + F.floor(g / 800)).cast("string"))


def corpus(spark, sf):
    """chunk_id, section, anchor, n and text."""
    n = F.col("doc_id")
    g = F.floor(n / 6)
    anchor = F.get(F.array(*[F.lit(a) for a in _ANCHORS]), (n % 6).cast("int"))
    said = (
        F.when(n % 4 == 0, F.concat(F.lit("See § "), _section(g + 1), F.lit("(a)(1).")))
        .when(n % 4 == 1, F.concat(F.lit("Under paragraph (b)(1) of this section and § "), _section(g + 2), F.lit(".")))
        .when(n % 4 == 2, F.lit("Paragraphs (1) through (3) apply, see 5 U.S.C. 6304."))
        .otherwise(F.concat(F.lit("No reference but § 99."), (n % 7 + 1).cast("string"), F.lit(" of this chapter.")))
    )
    rows = table(spark, sf, "documents").select("doc_id", g.alias("g"), _section(g).alias("section"), anchor.alias("anchor"), F.concat_ws(" ", "text", said).alias("text"))
    return rows.withColumn("chunk_id", F.concat_ws("#", "section", "anchor"))


def edges(spark, sf):
    found = corpus(spark, sf).select("chunk_id", F.posexplode(G.found_references(F.col("text"), F.col("section"), F.col("anchor"))).alias("pos", "r"))
    return found.select(F.col("chunk_id").alias("source"), "pos", F.col("r.kind").alias("kind"), F.col("r.phrase").alias("phrase"), F.explode_outer("r.targets").alias("target")).na.fill("", ["target"])


def _s(g: str) -> str:
    return f"((100 + ({g}) % 800)::VARCHAR || '.' || (1 + ({g}) // 800)::VARCHAR)"


_C_SQL = f"c AS (SELECT doc_id AS n, doc_id // 6 AS g, {_s('doc_id // 6')} AS section, ({list(_ANCHORS)!r})[(doc_id % 6 + 1)::INTEGER] AS anchor, {_s('doc_id // 6')} || '#' || ({list(_ANCHORS)!r})[(doc_id % 6 + 1)::INTEGER] AS chunk_id FROM documents)"
_E_SQL = f"""e AS (SELECT chunk_id AS source, 0 AS pos, 'section' AS kind, '§ ' || {_s('g + 1')} || '(a)(1)' AS phrase, {_s('g + 1')} || '#a-1' AS target FROM c WHERE n % 4 = 0
UNION ALL SELECT chunk_id, 0, 'paragraph', 'paragraph (b)(1) of this section', section || '#b-1' FROM c WHERE n % 4 = 1 UNION ALL SELECT chunk_id, 1, 'section', '§ ' || {_s('g + 2')}, {_s('g + 2')} FROM c WHERE n % 4 = 1
UNION ALL SELECT chunk_id, 0, 'paragraph', 'Paragraphs (1) through (3)', section || '#' || left(anchor, 1) || '-' || k::VARCHAR FROM c, range(1, 4) AS r(k) WHERE n % 4 = 2 UNION ALL SELECT chunk_id, 1, 'usc', '5 U.S.C. 6304', '' FROM c WHERE n % 4 = 2
UNION ALL SELECT chunk_id, 0, 'section', '§ 99.' || (n % 7 + 1)::VARCHAR, '99.' || (n % 7 + 1)::VARCHAR FROM c WHERE n % 4 = 3 UNION ALL SELECT chunk_id, 1, 'scope', 'this chapter', '' FROM c WHERE n % 4 = 3)"""
_UP = "list_concat(list_transform(range(len(string_split(split_part({x}, '#', 2), '-')), 0, -1), lambda n: split_part({x}, '#', 1) || '#' || array_to_string(string_split(split_part({x}, '#', 2), '-')[1:n], '-')), [split_part({x}, '#', 1)])"
_UPS = "CASE WHEN contains({x}, '#') THEN " + _UP + " ELSE [{x}] END"
_N_SQL = f"n AS (SELECT DISTINCT unnest({_UP.format(x='chunk_id')}) AS name FROM c)"
_R_SQL = f"""t AS (SELECT DISTINCT target FROM e WHERE target <> ''), s AS (SELECT target, {_UPS.format(x='target')} AS up FROM t), f AS (SELECT target, unnest(up) AS name, unnest(range(0, len(up))) AS far FROM s),
res AS (SELECT t.target, coalesce(arg_min(f.name, far) FILTER (n.name IS NOT NULL), '') AS resolved FROM t LEFT JOIN f USING (target) LEFT JOIN n ON n.name = f.name GROUP BY t.target)"""
_V_SQL = f"v2 AS (SELECT chunk_id FROM c WHERE g % 3 = 0), cov AS (SELECT DISTINCT unnest({_UP.format(x='chunk_id')}) AS target FROM v2)"
_D_SQL = f"{_V_SQL}, d AS (SELECT DISTINCT source, target, CASE WHEN target = '' THEN 'unscoped' WHEN resolved = '' THEN 'outside' ELSE 'missing' END AS status FROM e LEFT JOIN res USING (target) WHERE source IN (SELECT chunk_id FROM v2) AND target NOT IN (SELECT target FROM cov))"
_ALL = f"WITH {_C_SQL}, {_E_SQL}, {_N_SQL}, {_R_SQL}, {_D_SQL}"


def _targets(spark, sf):
    return edges(spark, sf).filter("target <> ''").select("target").distinct()


def _evidence(spark, sf):
    return corpus(spark, sf).filter("g % 3 = 0").select("chunk_id")


@query("g1_references", f"WITH {_C_SQL}, {_E_SQL} SELECT * FROM e")
def g1(spark, sf):
    return edges(spark, sf)


@query("g7_nameable", f"WITH {_C_SQL}, {_N_SQL} SELECT name FROM n")
def g7(spark, sf):
    return G.nameable(corpus(spark, sf))


@query("g8_resolve", f"{_ALL} SELECT * FROM res")
def g8(spark, sf):
    return G.resolved(_targets(spark, sf), G.nameable(corpus(spark, sf)))


@query("g9_satisfied", f"{_ALL} SELECT target, target IN (SELECT target FROM cov) AS satisfied FROM t")
def g9(spark, sf):
    return G.satisfied_targets(_targets(spark, sf), _evidence(spark, sf))


@query("g10_dangling", f"{_ALL} SELECT * FROM d")
def g10(spark, sf):
    return G.dangling(edges(spark, sf).select("source", "target"), _evidence(spark, sf), G.nameable(corpus(spark, sf)))


@query("g11_children", f"WITH {_C_SQL}, p AS (SELECT chunk_id, ({_UP.format(x='chunk_id')})[2] AS parent FROM c) SELECT parent, chunk_id FROM p WHERE parent IN (SELECT chunk_id FROM c)")
def g11(spark, sf):
    return G.children(corpus(spark, sf))


@query("g12_chunk_ids", f"WITH {VERSIONS_SQL} SELECT DISTINCT chunk_id FROM v WHERE system_to IS NULL AND valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def g12(spark, sf):
    return T.as_of(versions(spark, sf), instant(AT)).select("chunk_id").distinct()


@query("g14_pointers", f"WITH {_C_SQL}, {_E_SQL} SELECT target, arg_min(source, (source, pos)) AS source, arg_min(pos, (source, pos)) AS pos FROM e WHERE target <> '' GROUP BY target")
def g14(spark, sf):
    """Each target once, at its first place in order of the citing chunk."""
    return edges(spark, sf).filter("target <> ''").groupBy("target").agg(F.min(F.struct("source", "pos")).alias("at")).select("target", "at.source", "at.pos")


@query("g15_representative", f"WITH {_C_SQL}, b AS (SELECT chunk_id, unnest({_UP.format(x='chunk_id')}) AS target FROM c) SELECT target, min(chunk_id) AS representative, count(*) AS members FROM b GROUP BY target")
def g15(spark, sf):
    below = corpus(spark, sf).select("chunk_id", F.explode(G.ancestors(F.col("chunk_id"))).alias("target"))
    return below.groupBy("target").agg(F.min("chunk_id").alias("representative"), F.count(F.lit(1)).alias("members"))


@query("g18_widen", f"{_ALL}, b AS (SELECT chunk_id, unnest({_UP.format(x='chunk_id')}) AS target FROM c) SELECT target, min(chunk_id) AS chunk_id FROM t LEFT JOIN b USING (target) GROUP BY target")
def g18(spark, sf):
    below = corpus(spark, sf).select("chunk_id", F.explode(G.ancestors(F.col("chunk_id"))).alias("target")).groupBy("target").agg(F.min("chunk_id").alias("chunk_id"))
    return _targets(spark, sf).join(below, "target", "left")


@query("g19_widenable", f"{_ALL} SELECT target, min(source) AS source FROM d WHERE status = 'missing' GROUP BY target ORDER BY target LIMIT 8")
def g19(spark, sf):
    found = G.dangling(edges(spark, sf).select("source", "target"), _evidence(spark, sf), G.nameable(corpus(spark, sf)))
    return found.filter("status = 'missing'").groupBy("target").agg(F.min("source").alias("source")).orderBy("target").limit(8)  # offers shown


# Conversations as a graph: a turn cites the turns before it, so walks have a twin in SQL.

_WALK = """r AS (SELECT conv_id, turn, conv_id::VARCHAR || '.1#t' || turn::VARCHAR AS id FROM conversations), e AS (SELECT a.conv_id, a.turn AS f, b.turn AS t FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)),
s AS (SELECT conv_id, max(turn) AS turn FROM r GROUP BY conv_id), h AS (SELECT DISTINCT s.conv_id, e.t FROM s JOIN e ON e.conv_id = s.conv_id AND e.f = s.turn), g AS (SELECT DISTINCT h.conv_id, e.t FROM h JOIN e ON e.conv_id = h.conv_id AND e.f = h.t),
w AS (SELECT conv_id AS query_id, turn AS t, 0 AS round FROM s UNION SELECT conv_id, t, 1 FROM h UNION SELECT conv_id, t, 2 FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = g.conv_id AND h.t = g.t))"""


def _turn_graph(spark, sf):
    """Rows, links and seeds: a walk starts at the last turn of each conversation."""
    c = table(spark, sf, "conversations")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(".1#t"), t.cast("string"))
    links = c.select(name(F.col("turn")).alias("source"), F.posexplode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("pos", "to"), "conv_id").filter("to >= 0")
    seeds = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.col("conv_id").alias("query_id"), name(F.col("turn")).alias("chunk_id"), F.lit(1).alias("rank"))
    return c.select(name(F.col("turn")).alias("chunk_id")), links.select("source", name(F.col("to")).alias("target"), "pos"), seeds


@query("g13_expand_turns", f"WITH {_WALK} SELECT query_id, query_id::VARCHAR || '.1#t' || t::VARCHAR AS chunk_id, round FROM w")
def g13_turns(spark, sf):
    rows, links, seeds = _turn_graph(spark, sf)
    return G.expand(seeds, links, rows, budget=100, depth=2).select("query_id", "chunk_id", "round")


@query("g17_hop_retrieval", f"WITH {_WALK}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round, t DESC)::INTEGER AS rank FROM w WHERE round < 2) SELECT query_id, query_id::VARCHAR || '.1#t' || t::VARCHAR AS chunk_id, round, rank FROM o WHERE rank <= 3")
def g17(spark, sf):
    """The last turn's first hop, one slot of three for itself and two for what it refers to."""
    rows, links, seeds = _turn_graph(spark, sf)
    return G.hop_retrieved(seeds, links, rows, keep=3, budget=2, depth=1)


@query("g16_first_wins", "SELECT role, min(conv_id * 100 + turn) AS pos FROM conversations GROUP BY role")
def g16(spark, sf):
    return G.first_wins(table(spark, sf, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("pos")), "role", "pos")
