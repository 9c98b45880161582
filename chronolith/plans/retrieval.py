"""Lexical, dense and fused retrieval (S4 to S6, R, W9, W10 keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.porter import STEP2, STEP3, STEP4, stemmed
from ..operators import ranking as R
from ..operators import temporal as T
from .base import AT, VERSIONS_SQL, chunks, instant, query, table, versions

_QUERIES = [(1, "the shall thing, erwhea and REENTED of"), (2, "de la tion éaux Oiè"), (3, "schtz keit und; verach einach"), (4, "zzzz qqqq"), (5, "")]
_Q_SQL = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _QUERIES) + ")"
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_QTOK = r"list_filter(regexp_split_to_array(query, '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_ORDERED = "list_transform(list_filter(list_zip(s, range(1, len(s) + 1)), lambda p: list_position(s, p[1]) = p[2]), lambda p: p[1])"


def _porter_sql(words: str) -> str:
    """CTEs that end in st(term, stem): the stemmer as SQL over `words`, a query of column term. Consonant y is
    written Y meanwhile; steps and suffixes are those of functions.porter."""
    ends = lambda w, e: f"suffix({w}, '{e}')"
    cut = lambda w, n: f"{w}[:-{n + 1}]"
    once = lambda w: f"regexp_matches({w}, '[aeiouy][^aeiouy]')"
    twice = lambda w: f"regexp_matches({w}, '[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]')"
    short = lambda w: f"regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywxY]$')"
    vowel = lambda w: f"regexp_matches({w}, '[aeiouy]')"

    def swaps(table):
        rows = sorted(table, key=lambda r: -len(r[0]))
        return "CASE " + " ".join(f"WHEN {ends('w', e)} THEN CASE WHEN {once(cut('w', len(e)))} THEN {cut('w', len(e))} || '{to}' ELSE w END" for e, to in rows) + " ELSE w END"

    fourth = "CASE " + " ".join(f"WHEN {ends('w', e)} THEN CASE WHEN {twice(cut('w', len(e)))}{' AND w[-4:-4] IN (chr(115), chr(116))' if e == 'ion' else ''} THEN {cut('w', len(e))} ELSE w END" for e in sorted(STEP4, key=lambda e: -len(e))) + " ELSE w END"
    tidy = f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN length(w) > 1 AND lower(w[-1:]) = lower(w[-2:-2]) AND regexp_matches(w, '[^aeiouylsz]$') THEN {cut('w', 1)} WHEN {once('w')} AND NOT {twice('w')} AND {short('w')} THEN w || 'e' ELSE w END"
    steps = [
        f"CASE WHEN regexp_matches(w, '(sses|ies)$') THEN {cut('w', 2)} WHEN {ends('w', 's')} AND NOT {ends('w', 'ss')} THEN {cut('w', 1)} ELSE w END",
        None,
        f"CASE WHEN regexp_matches(w, '[yY]$') AND {vowel(cut('w', 1))} THEN {cut('w', 1)} || 'i' ELSE w END",
        swaps(STEP2), swaps(STEP3), fourth,
        f"CASE WHEN {ends('w', 'e')} AND ({twice(cut('w', 1))} OR {once(cut('w', 1))} AND NOT {short(cut('w', 1))}) THEN {cut('w', 1)} ELSE w END",
        f"CASE WHEN {ends('w', 'll')} AND {twice(cut('w', 1))} THEN {cut('w', 1)} ELSE w END",
    ]
    out = [f"p_all AS ({words})", "p_0 AS (SELECT term, regexp_replace(term, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM p_all WHERE length(term) > 2 AND regexp_full_match(term, '[a-z]+'))"]
    last = "p_0"
    for i, step in enumerate(steps, 1):
        if step is None:
            cutting = f"CASE WHEN {ends('w', 'eed')} THEN 0 WHEN {ends('w', 'ed')} AND {vowel(cut('w', 2))} THEN 2 WHEN {ends('w', 'ing')} AND {vowel(cut('w', 3))} THEN 3 ELSE 0 END"
            out.append(f"p_{i}a AS (SELECT term, CASE WHEN {ends('w', 'eed')} THEN CASE WHEN {once(cut('w', 3))} THEN {cut('w', 1)} ELSE w END WHEN k > 0 THEN left(w, length(w) - k) ELSE w END AS w, k FROM (SELECT *, {cutting} AS k FROM {last}))")
            out.append(f"p_{i} AS (SELECT term, CASE WHEN k > 0 THEN {tidy} ELSE w END AS w FROM p_{i}a)")
        else:
            out.append(f"p_{i} AS (SELECT term, {step} AS w FROM {last})")
        last = f"p_{i}"
    out.append(f"st AS (SELECT term, lower(w) AS stem FROM {last} UNION ALL SELECT term, term FROM p_all WHERE NOT (length(term) > 2 AND regexp_full_match(term, '[a-z]+')))")
    return ",\n".join(out)


_D_SQL = f"d AS (SELECT doc_id AS id, source, (1 + try_cast(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5)::INTEGER AS authority, text, {_TOK} AS tokens FROM documents)"
_QW_SQL = f"qw AS (SELECT DISTINCT query_id, lower(unnest({_QTOK})) AS term FROM q)"
_STEMS_SQL = _porter_sql("SELECT DISTINCT unnest(tokens) AS term FROM d UNION SELECT term FROM qw")
_INDEX = f"""{_D_SQL}, {_QW_SQL}, {_STEMS_SQL},
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
t AS (SELECT DISTINCT query_id, stem AS term FROM qw JOIN st USING (term)),
p AS (SELECT id, dl, stem AS term FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM d) JOIN st USING (term)),
h AS (SELECT term, id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term)"""
_BM25 = """round(-sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6)"""
_LEX = f"""lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
  SELECT query_id, id, {_BM25} AS score FROM h JOIN t USING (term) JOIN df USING (term), size WHERE id IN (SELECT id FROM d WHERE source <> 'src3') GROUP BY query_id, id))"""


_BUILT: dict[tuple, R.Index] = {}


def index_of(spark, sf) -> R.Index:
    """The index of documents: built once a session for the same files, then read."""
    docs = table(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _BUILT:
        _BUILT[key] = R.scratch_index(chunks(spark, sf))
    return _BUILT[key]


def _queries(spark):
    return spark.createDataFrame(_QUERIES, "query_id int, query string")


@query("r1_bm25_topk", f"WITH {_Q_SQL}, {_INDEX}, {_LEX} SELECT query_id, id, score, rank::INTEGER AS rank FROM lex WHERE rank <= 10")
def r1(spark, sf):
    rows = chunks(spark, sf)
    scored = R.bm25(index_of(spark, sf), R.query_terms(_queries(spark)), rows.filter("source <> 'src3'").select("id"))
    return R.top(scored, 10, F.col("score"), F.col("id"))


@query("s4_match_scan", f"WITH {_Q_SQL}, {_INDEX} SELECT query_id, count(DISTINCT id) AS matched, sum(tf)::BIGINT AS occurrences FROM h JOIN t USING (term) GROUP BY query_id")
def s4(spark, sf):
    hits = R.matches(index_of(spark, sf), R.query_terms(_queries(spark)))
    return hits.groupBy("query_id").agg(F.countDistinct("id").alias("matched"), F.sum("tf").alias("occurrences"))


_WORDS_SQL = f"{_D_SQL}, {_porter_sql('SELECT DISTINCT unnest(tokens) AS term FROM d')}"


@query("s5_vocabulary", f"WITH {_WORDS_SQL} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, stem AS term FROM (SELECT id, unnest(tokens) AS term FROM d) JOIN st USING (term)) GROUP BY term")
def s5(spark, sf):
    return R.vocabulary(index_of(spark, sf))


@query("s5_postings", f"WITH {_WORDS_SQL} SELECT stem AS term, id, dl, count(*) AS tf FROM (SELECT id, len(tokens)::INTEGER AS dl, unnest(tokens) AS term FROM d) JOIN st USING (term) GROUP BY ALL")
def s5_postings(spark, sf):
    return R.postings(index_of(spark, sf))


@query("s6_index_cardinality", f"WITH {VERSIONS_SQL} SELECT count(*) AS indexed, count(*) FILTER (system_to IS NULL) AS believed FROM v")
def s6(spark, sf):
    return versions(spark, sf).agg(F.count(F.lit(1)).alias("indexed"), F.count_if(T.believed_at()).alias("believed"))


@query("r2_match_expression", f"""WITH {_Q_SQL}, s AS (SELECT query_id, {_QTOK} AS s FROM q) SELECT query_id, coalesce(nullif('"' || array_to_string({_ORDERED}, '" OR "') || '"', '""'), '""') AS expression FROM s""")
def r2(spark, sf):
    return _queries(spark).select("query_id", R.match_expression(F.col("query")).alias("expression"))


@query(
    "r3_df_drop",
    f"WITH {_Q_SQL}, {_INDEX}, k AS (SELECT query_id, term, coalesce(df, 0) AS df, coalesce(df, 0) <= n * 0.5 AS kept, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(df, 0), term) = 1 AS rarest FROM t LEFT JOIN df USING (term), size), a AS (SELECT *, bool_or(kept) OVER (PARTITION BY query_id) AS any_kept FROM k) SELECT query_id, term, df FROM a WHERE kept OR (rarest AND NOT any_kept)",
)
def r3(spark, sf):
    index, terms = index_of(spark, sf), R.query_terms(_queries(spark))
    return R.drop_frequent(terms.crossJoin(F.broadcast(index.stats.select("n"))), R.frequencies(index, terms), F.col("n"), 0.5)


@query("r4_stems", f"WITH {_WORDS_SQL} SELECT term, stem FROM st")
def r4(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(R.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", F.get(stemmed(F.array("term")), 0).alias("stem"))


_DENSE = "dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.query_id, e.vec_id AS id, round(list_sum(list_transform(list_zip(e.embedding, q.vector), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 5) AS score FROM embeddings e, qv q WHERE e.vec_id % 7 <> 3))"
_QV = "qv AS (SELECT vec_id::INTEGER AS query_id, embedding AS vector FROM embeddings WHERE vec_id IN (1, 2, 3))"


def _dense(spark, sf, k):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter(F.col("id").isin(1, 2, 3)).select(F.col("id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))
    return R.top(R.dense(vectors, asked, vectors.filter("id % 7 <> 3").select("id")), k, F.col("score").desc(), F.col("id"))


@query("r5_dense_topk", f"WITH {_QV}, {_DENSE} SELECT query_id, id, score, rank::INTEGER AS rank FROM dense WHERE rank <= 20")
def r5(spark, sf):
    return _dense(spark, sf, 20)


@query("r7_retrieval_text", "SELECT doc_id AS id, md5(CASE WHEN lang = 'en' AND source <> '' THEN source || chr(10) || text WHEN lang <> '' THEN lang || chr(10) || text ELSE text END) AS digest FROM documents")
def r7(spark, sf):
    context = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(R.retrieval_text(context, F.col("lang"), F.col("text")).cast("binary")).alias("digest"))


_FUSE = """u AS (SELECT query_id, id, rank FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM dense WHERE rank <= 50),
f AS (SELECT query_id, id, coalesce(authority, 2) AS authority, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(authority, 2), id)::INTEGER AS rank
  FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM u GROUP BY query_id, id) LEFT JOIN (SELECT id, authority FROM d) a USING (id))"""


def _lists(spark, sf):
    rows = chunks(spark, sf)
    lexical = R.top(R.bm25(index_of(spark, sf), R.query_terms(_queries(spark)), rows.filter("source <> 'src3'").select("id")), 50, F.col("score"), F.col("id"))
    return rows, lexical, _dense(spark, sf, 50)


@query("r8_rrf", f"WITH {_Q_SQL}, {_QV}, {_INDEX}, {_LEX}, {_DENSE}, {_FUSE} SELECT query_id, id, authority, score, rank FROM f")
def r8(spark, sf):
    rows, lexical, near = _lists(spark, sf)
    return R.fused([lexical, near], rows)


@query("r9_rrf_order", f"WITH {_Q_SQL}, {_QV}, {_INDEX}, {_LEX}, {_DENSE}, u AS (SELECT query_id, id, rank FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM dense WHERE rank <= 50) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, id)::INTEGER AS rank FROM u GROUP BY query_id, id")
def r9(spark, sf):
    _, lexical, near = _lists(spark, sf)
    return R.fused([lexical, near]).select("query_id", "id", "rank")


@query("r10_authority", f"WITH {_Q_SQL}, {_QV}, {_INDEX}, {_LEX}, {_DENSE}, u AS (SELECT id FROM lex WHERE rank <= 50 UNION SELECT id FROM dense WHERE rank <= 50) SELECT id, coalesce(authority, 2) AS authority FROM u LEFT JOIN d USING (id)")
def r10(spark, sf):
    rows, lexical, near = _lists(spark, sf)
    union = lexical.select("id").unionByName(near.select("id")).distinct()
    return union.join(rows.select("id", "authority"), "id", "left").select("id", F.coalesce("authority", F.lit(2)).alias("authority"))


_RERANK = f"""qt AS (SELECT query_id, list_distinct(list_transform({_QTOK}, lambda x: lower(x))) AS qt FROM q),
rr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INTEGER AS rank FROM (
  SELECT f.query_id, f.id, f.rank, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, list_distinct(tokens)))::DOUBLE / len(qt) ELSE 0 END, 6) AS score FROM f JOIN d USING (id) JOIN qt USING (query_id) WHERE f.rank <= 20))"""


@query("r11_rerank", f"WITH {_Q_SQL}, {_QV}, {_INDEX}, {_LEX}, {_DENSE}, {_FUSE}, {_RERANK} SELECT * FROM rr")
def r11(spark, sf):
    rows, lexical, near = _lists(spark, sf)
    head = R.fused([lexical, near], rows).filter("rank <= 20")
    return R.reranked(head, _queries(spark), rows)


@query(
    "r12_pipeline_trace",
    f"""WITH {_Q_SQL}, {_QV}, {_INDEX}, {_LEX}, {_DENSE}, {_FUSE}, {_RERANK}
SELECT query_id, 'lexical' AS stage, rank::INTEGER AS rank, id, score FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, 'dense', rank::INTEGER, id, score FROM dense WHERE rank <= 50
UNION ALL SELECT query_id, 'fused', rank, id, score FROM f UNION ALL SELECT query_id, 'reranked', rank, id, score FROM rr UNION ALL SELECT query_id, 'final', rank, id, score FROM rr WHERE rank <= 8""",
)
def r12(spark, sf):
    rows, lexical, near = _lists(spark, sf)
    return R.staged(lexical, near, _queries(spark), rows)


_FORCE = f"valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')"


@query(
    "r14_postfilter_shortfall",
    f"WITH {VERSIONS_SQL}, q AS (SELECT DISTINCT section_id AS query_id FROM v), r AS (SELECT section_id AS query_id, id, valid_from, valid_to, row_number() OVER (PARTITION BY section_id ORDER BY text::DOUBLE DESC, id) AS rank FROM v) SELECT query_id, count(*) FILTER ({_FORCE}) AS kept, count(*) FILTER ({_FORCE}) < 2 AS short FROM r WHERE rank <= 20 GROUP BY query_id",
)
def r14(spark, sf):
    v = versions(spark, sf).withColumn("query_id", F.col("section_id"))
    ranked = R.top(v, 20, F.col("text").cast("double").desc(), F.col("id"))
    return R.shortfall(ranked, T.valid_at(instant(AT)), 20, 2)


@query(
    "r14_naive_versions",
    f"WITH {VERSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY text::DOUBLE DESC, id) AS rank FROM v) SELECT count(*) FILTER (NOT ({_FORCE})) AS wrong_version, count(*) AS shown, round(count(*) FILTER (NOT ({_FORCE}))::DOUBLE / count(*), 6) AS rate FROM r WHERE rank <= 5",
)
def r14_naive(spark, sf):
    ranked = R.top(versions(spark, sf).withColumn("query_id", F.col("section_id")), 5, F.col("text").cast("double").desc(), F.col("id"))
    wrong = F.count_if(~T.valid_at(instant(AT)))
    return ranked.agg(wrong.alias("wrong_version"), F.count(F.lit(1)).alias("shown"), F.round(wrong / F.count(F.lit(1)), 6).alias("rate"))


@query(
    "r15_parent_texts",
    "WITH rows AS (SELECT conv_id * 1000 + turn AS id, conv_id AS parent_id, text FROM conversations), asked AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS pos FROM rows WHERE id % 13 = 4), a AS (SELECT parent_id, min(pos)::INTEGER AS pos FROM asked JOIN rows USING (id) GROUP BY parent_id) SELECT parent_id, pos, md5(string_agg(text, ' ' ORDER BY id)) AS digest FROM rows JOIN a USING (parent_id) GROUP BY parent_id, pos",
)
def r15(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("parent_id"), "text")
    asked = numbered(rows.filter("id % 13 = 4").select("id"), "n", F.col("id").desc()).select("id", (F.col("n") + 1).cast("int").alias("pos"))
    return R.parents(asked, rows).select("parent_id", "pos", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("w9_dense_metadata", "SELECT count(*) AS vectors, min(len(embedding))::INTEGER AS dim, max(len(embedding))::INTEGER AS dim_max, count(*) = count(DISTINCT vec_id) AS ids_unique, bool_and(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 1e-3) AS unit_norm FROM embeddings")
def w9(spark, sf):
    e = table(spark, sf, "embeddings")
    norm = F.sqrt(R.dot(F.col("embedding"), F.col("embedding")))
    return e.agg(
        F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("dim"), F.max(F.size("embedding")).alias("dim_max"), (F.count(F.lit(1)) == F.countDistinct("vec_id")).alias("ids_unique"), F.bool_and(F.abs(norm - 1) < 1e-3).alias("unit_norm")
    )
