"""Ranked retrieval: lexical scores, vector scores, rank fusion and traces, many queries in one plan.

Predicates come before ranking: callers pass admitted rows, while document frequencies and lengths
are those of the whole index. The index is built once and kept as files; queries read the postings of
their terms' buckets. Stems are the same on both sides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.porter import stem, stemmed
from ..functions.storage import scratch, written

K1, B, FUSION_K = 1.2, 0.75, 60
#: The most distinct tokens of a query.
MOST_TOKENS = 64
#: The most ranked rows that are counted and then broadcast.
BROADCAST_KEYS = 1_000_000
#: Queries whose vectors are broadcast at once.
MOST_QUERIES = 4096


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any language."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """A query's distinct tokens in order, spelled as they are, at most MOST_TOKENS."""
    spelled = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")
    return F.slice(F.array_distinct(spelled), 1, MOST_TOKENS)


def match_expression(text: Column) -> Column:
    """The tokens quoted and joined by OR; a pair of quotes where there is none."""
    quoted = F.array_join(F.transform(query_tokens(text), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")
    return F.when(quoted == "", '""').otherwise(quoted)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and distinct term, stemmed as the index is, of queries (query_id, query)."""
    lower = F.transform(query_tokens(F.col("query")), F.lower)
    return queries.select("query_id", stemmed(lower).alias("terms")).select("query_id", F.explode(F.array_distinct("terms")).alias("term"))


#: Folders that terms are dealt to by hash; a query reads those of its terms.
BUCKETS = 64
POSTING = "term string, id long, dl int, tf long, bucket int"
#: Texts whose tokens a worker has as Python objects at once, and the stems that it keeps.
TEXTS_AT_ONCE, MOST_STEMS = 64, 1 << 17


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """A lexical index as files: postings (bucket, term, id, dl, tf) and vocabulary (bucket, term, df, cf) by
    bucket, and one row of stats (n, avgdl)."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame


class _Stems(dict):
    def __missing__(self, token: str) -> str:
        self[token] = out = stem(token)
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of texts whose tokens are joined by blanks: term, id, dl and tf. Few texts at a time become Python objects."""
    known = _Stems()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            terms, each, lengths, tf = [], [], [], []
            for text in part.column("words").to_pylist():
                tokens, found = text.split(" ") if text else [], Counter()
                for token, n in Counter(tokens).items():
                    found[known[token]] += n
                terms += found
                tf += found.values()
                each.append(len(found))
                lengths.append(len(tokens))
            if len(known) > MOST_STEMS:
                known.clear()
            each = np.array(each, np.int64)
            ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), each)))
            columns = [pa.array(terms, pa.string()), ids, pa.array(np.repeat(np.array(lengths, np.int32), each)), pa.array(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "id", "dl", "tf"])


def build_index(rows: DataFrame, path: str, text: Column | None = None) -> Index:
    """Writes the index of rows (id, text) under path. Texts are read once, their terms stemmed and counted where
    they lie; postings move once, to their bucket, where they lie in order of term."""
    spark = rows.sparkSession
    found = rows.select(F.col("id").cast("long").alias("id"), F.array_join(tokens(F.col("text") if text is None else text), " ").alias("words"))
    counted = found.mapInArrow(_counted, "term string, id long, dl int, tf long")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    if size["n"] > size["ids"]:  # texts of one id and length count as one, as their postings are equal but for tf
        counted = counted.groupBy("term", "id", "dl").agg(F.sum("tf").alias("tf"))
    # rebalanced, so that a task's share is bounded however large a bucket is
    dealt = counted.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df = spark.read.schema(POSTING).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    df.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vocabulary")
    total = spark.read.schema("term string, df long, cf long, bucket int").parquet(f"{path}/vocabulary").agg(F.coalesce(F.sum("cf"), F.lit(0)))
    avgdl = total.first()[0] / size["n"] if size["n"] else None
    spark.range(1).select(F.lit(size["n"]).cast("long").alias("n"), F.lit(avgdl).cast("double").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    postings = spark.read.schema(POSTING).parquet(f"{path}/postings")
    vocabulary = spark.read.schema("term string, df long, cf long, bucket int").parquet(f"{path}/vocabulary")
    return Index(postings, vocabulary, spark.read.schema("n long, avgdl double").parquet(f"{path}/stats"))


def scratch_index(rows: DataFrame, text: Column | None = None) -> Index:
    """An index in the shared folder, for as long as the session lives."""
    return build_index(rows, scratch(rows.sparkSession, "index"), text)


def _asked(indexed: DataFrame, terms: DataFrame) -> DataFrame:
    """indexed's rows in the buckets of some query's terms; the driver sees bucket numbers."""
    wanted = [r[0] for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]
    return indexed.filter(F.col("bucket").isin(wanted)) if wanted else indexed.filter(F.lit(False))


def postings(index: Index) -> DataFrame:
    """term, id, dl and tf."""
    return index.postings.select("term", "id", "dl", "tf")


def vocabulary(index: Index) -> DataFrame:
    """term and df: in how many documents a term occurs."""
    return index.vocabulary.select("term", "df")


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, term, id, tf and dl of the documents that hold a query's term."""
    return _asked(index.postings, terms).join(terms, "term").select("query_id", "term", "id", "tf", "dl")


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """term and df of the queries' terms that the index has."""
    return _asked(index.vocabulary, terms).join(terms.select("term").distinct(), "term", "left_semi").select("term", "df")


def drop_frequent(terms: DataFrame, df: DataFrame, n: Column, above: float) -> DataFrame:
    """terms without those in more than `above` of the documents; a query all of whose terms go keeps its rarest."""
    known = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term")) == 1
    kept = F.col("df") <= n * above
    rows = known.withColumns({"__kept": kept, "__rarest": rarest})
    rows = rows.withColumn("__any", F.max(F.col("__kept")).over(Window.partitionBy("query_id")))
    return rows.filter("__kept or (__rarest and not __any)").select("query_id", "term", "df")


def bm25(index: Index, terms: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """query_id, id and score, lower is better, of the documents that hold a term.

    Number, lengths and frequencies are over all of the index; admitted (id) restricts what is scored.
    """
    hits = matches(index, terms)
    if admitted is not None:
        hits = hits.join(admitted, "id", "left_semi")
    rows = hits.join(frequencies(index, terms), "term").crossJoin(F.broadcast(index.stats))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "id").agg(F.round(-F.sum(part), 6).alias("score"))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """scored with rank, the first k of each query."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, queries: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """query_id, id and score, higher is better, of vectors (id, embedding) for queries (query_id, vector).

    The queries are repeated for each vector, vectors never move. Queries go in batches of MOST_QUERIES, so
    what is broadcast is bounded.
    """
    if admitted is not None:
        vectors = vectors.join(admitted, "id", "left_semi")
    batches = -(-queries.count() // MOST_QUERIES) or 1
    dealt = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == i) for i in range(batches)] if batches > 1 else [queries]
    return reduce(DataFrame.unionByName, [_dense(vectors, q) for q in dealt])


def _dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    return vectors.crossJoin(F.broadcast(queries)).select("query_id", "id", F.round(dot(F.col("embedding"), F.col("vector")), 5).alias("score"))


def fused(lists: list[DataFrame], authority: DataFrame | None = None, k: int = FUSION_K) -> DataFrame:
    """query_id, id, score and rank by reciprocal rank fusion of lists (query_id, id, rank).

    Ties go to the stronger authority (2 where unknown), then the id. Scores are rounded before
    ranking, as the order of addition is not fixed.
    """
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    rows = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))
    if authority is not None:
        rows = rows.join(authority.select("id", "authority"), "id", "left")
    else:
        rows = rows.withColumn("authority", F.lit(None).cast("int"))
    rows = rows.withColumn("authority", F.coalesce("authority", F.lit(2)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "authority", "id")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "authority", "score", "rank")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has: a stand-in for a scoring model."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def reranked(candidates: DataFrame, queries: DataFrame, texts: DataFrame, scorer=overlap) -> DataFrame:
    """candidates (query_id, id, rank) in the order of scorer(query, text), ties by their old rank."""
    candidates = written(candidates, "candidates")
    few = candidates.count() <= BROADCAST_KEYS  # then no text moves
    rows = texts.select("id", "text").join(F.broadcast(candidates) if few else candidates, "id").join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("score", F.round(scorer(F.col("query"), F.col("text")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank"))
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")


def retrieval_text(context: Column, heading: Column, text: Column) -> Column:
    """Context, or else heading, over the text."""
    head = F.trim(F.coalesce(F.when(context != "", context), heading))
    return F.concat_ws("\n", F.when(head != "", head), text)


def retrieve(rows: DataFrame, vectors: DataFrame, queries: DataFrame, admitted: DataFrame, k: int = 50, head: int = 20, final: int = 8, index: Index | None = None) -> DataFrame:
    """The pipeline's trace: query_id, stage, rank, id and score of each stage.

    rows (id, text, authority), vectors (id, embedding), queries (query_id, query, vector), and the index
    of rows if there is one. Stages: lexical and dense under the predicates, fused, reranked head, final.
    Heads of a few rows a query are written before they are fused, so no stage is computed twice.
    """
    lexical = top(bm25(index or scratch_index(rows), query_terms(queries), admitted), k, F.col("score"), F.col("id"))
    near = top(dense(vectors, queries.select("query_id", "vector"), admitted), k, F.col("score").desc(), F.col("id"))
    return staged(lexical, near, queries, rows, head, final)


def staged(lexical: DataFrame, near: DataFrame, queries: DataFrame, rows: DataFrame, head: int = 20, final: int = 8) -> DataFrame:
    """The trace of two ranked heads."""
    lexical, near = written(lexical.select("query_id", "rank", "id", "score"), "lexical"), written(near.select("query_id", "rank", "id", "score"), "dense")
    both = written(fused([lexical, near], rows.select("id", "authority")), "fused")
    again = written(reranked(both.filter(F.col("rank") <= head), queries, rows), "reranked")
    stages = {"lexical": lexical, "dense": near, "fused": both, "reranked": again, "final": again.filter(F.col("rank") <= final)}
    return reduce(DataFrame.unionByName, [df.select("query_id", F.lit(s).alias("stage"), "rank", "id", "score") for s, df in stages.items()])


def shortfall(ranked: DataFrame, in_force: Column, k: int, final: int) -> DataFrame:
    """Filtering after ranking, as a baseline: how many of the first k survive, and whether fewer than `final` do."""
    kept = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_if(in_force).alias("kept"))
    return kept.withColumn("short", F.col("kept") < final)


def parents(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """Parent texts of requested (pos, id): rows of a parent joined in id order, parents in first-request order."""
    asked = requested.join(rows.select("id", "parent_id"), "id").groupBy("parent_id").agg(F.min("pos").alias("pos"))
    parts = rows.join(asked, "parent_id").groupBy("parent_id", "pos")
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ").alias("text"))
