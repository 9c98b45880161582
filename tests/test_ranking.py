from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronolith.functions.porter import stem
from chronolith.operators import ranking as R


def docs(spark):
    return spark.createDataFrame([(1, "annual leave ceiling", 1), (2, "sick leave", 2), (3, "annual annual report", 3), (4, None, 4)], "id long, text string, authority int")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_bm25_by_hand(spark):
    got = {(r["query_id"], r["id"]): r["score"] for r in R.bm25(R.scratch_index(docs(spark)), R.query_terms(queries(spark, "Annual", "?!", "zzz"))).collect()}
    n, df, avg = 4, 2, 8 / 4
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    want = lambda tf, dl: round(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)), 6)
    assert got == {(0, 1): want(1, 3), (0, 3): want(2, 3)}


def test_stems_meet_on_both_sides_and_the_index_stays(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Agencies grant leaves"), (2, "the agency granted leave"), (3, "unrelated")], "id long, text string")
    R.build_index(rows, f"{tmp_path}/index")
    index = R.open_index(spark, f"{tmp_path}/index")
    hits = {(r["query_id"], r["id"]) for r in R.matches(index, R.query_terms(queries(spark, "granting leave", "agency's"))).collect()}
    assert hits == {(0, 1), (0, 2), (1, 1), (1, 2)}
    plan = R.matches(index, R.query_terms(queries(spark, "leave")))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [", 1)[1][:80]


def test_query_tokens_keep_spellings_and_stop_at_64(spark):
    row = queries(spark, "Leave leave Leave", "", " ".join(f"w{i}" for i in range(80))).select(R.match_expression(F.col("query")).alias("m"), F.size(R.query_tokens(F.col("query"))).alias("n")).collect()
    assert [r["m"] for r in row[:2]] == ['"Leave" OR "leave"', '""']
    assert row[2]["n"] == 64


def test_fusion_ties_go_to_authority_then_id(spark):
    lists = [spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, id long, rank int"), spark.createDataFrame([(1, 20, 1), (1, 10, 2), (1, 30, 3)], "query_id int, id long, rank int")]
    authority = spark.createDataFrame([(10, 3), (20, 1)], "id long, authority int")
    got = [(r["id"], r["authority"], r["rank"]) for r in R.fused(lists, authority).orderBy("rank").collect()]
    assert got == [(20, 1, 1), (10, 3, 2), (30, 2, 3)]


def test_frequent_terms_go_but_the_rarest_stays(spark):
    terms = spark.createDataFrame([(1, "the"), (1, "of"), (2, "the"), (2, "leave")], "query_id int, term string")
    df = spark.createDataFrame([("the", 90), ("of", 80), ("leave", 5)], "term string, df long")
    got = sorted((r["query_id"], r["term"]) for r in R.drop_frequent(terms, df, F.lit(100), 0.5).collect())
    assert got == [(1, "of"), (2, "leave")]


def test_pipeline_stages(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, "annual leave", [1.0, 0.0])], "query_id int, query string, vector array<float>")
    admitted = spark.createDataFrame([(1,), (3,)], "id long")
    rows = R.retrieve(docs(spark), vectors, asked, admitted).collect()
    assert {r["stage"] for r in rows} == {"lexical", "dense", "fused", "reranked", "final"}
    assert {r["id"] for r in rows} == {1, 3}
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["stage"] == "final"] == [1, 3]


def test_porter_stems():
    # fixed values: pairs from the algorithm's published description
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "hopefulness": "hope", "triplicate": "triplic", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control"}
    assert {w: stem(w) for w in pairs} == pairs
