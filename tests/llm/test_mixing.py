from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import functions as F

from chronolith.functions.ordering import numbered, summed_before
from chronolith.llm import mixing as M


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing what is above a cap again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_agree_with_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5}, {"a": 100}, {"b": 3, None: 50, "": 7, "é": 9}, {"a": 0, "b": 10}, {f"s{i}": i * i for i in range(1, 30)}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in M.source_targets(rows).collect()}
        want = water(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want), sizes


def test_epochs_come_first_and_totals_are_near(spark):
    rows = [(i, f"w{i} " * (5 + i * 7 % 40), "abc"[i % 3]) for i in range(600)] + [(1000, "solo " * 20, None), (1001, None, "a"), (1002, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(M.sized_documents(docs)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for source, rs in by.items():
        size = sum(r["size"] for r in rs)
        epochs = min(3, math.floor(rs[0]["target"] / size))
        assert all(epochs <= r["copies"] <= epochs + 1 for r in rs if r["size"]), source
        taken = sum(r["size"] * r["copies"] for r in rs)
        assert abs(taken - rs[0]["target"]) <= 20, source
        # what is taken once more comes first in key order, save for the one that fills the rest
        extra = [r["key"] for r in rs if r["size"] and r["copies"] > epochs]
        rest = [r["key"] for r in rs if r["size"] and r["copies"] == epochs]
        assert sum(k > min(rest) for k in extra) <= 1 if rest and extra else True


def test_reruns_agree_and_weights_count(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "plain words only here").otherwise("### $$$ %%% ###").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    run = lambda d: {r["doc_id"]: r["copies"] for r in M.mix(M.sized_documents(d)).collect()}
    once = run(docs)
    assert once == run(docs.repartition(7))
    b = {i: c for i, c in once.items() if i >= 1000}
    plain, marks = (sum(c for i, c in b.items() if i % 2 == k) for k in (0, 1))
    assert plain > 2 * marks


def test_copies_become_rows(messy, nothing):
    mixed = M.mixed_documents(messy)
    assert mixed.columns == messy.columns and mixed.count() > 0
    assert M.mixed_documents(nothing).collect() == []
    assert M.mix(M.sized_documents(nothing)).collect() == []


def test_words_of_the_rows_meet_the_targets_whatever_the_ids(spark):
    rows = [(i % 40 if i % 3 else None, f"w{i} " * (5 + i * 7 % 40), "ab"[i % 2], i) for i in range(400)]
    rows += [(7, "the same text " * 4, "a", 1000 + i) for i in range(150)] + [(7, "the same text " * 4, "b", 2000)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __key long")
    sized = M.sized_documents(docs)
    plan = {r["source"]: r for r in M.mix(sized).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()}
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    words = {r["source"]: r["w"] for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("w")).collect()}
    assert sum(r["n"] for r in plan.values()) == len(rows)
    for source, r in plan.items():
        assert words[source] == r["taken"] and abs(r["taken"] - r["target"]) <= 20, source
    most = got.groupBy("__key").count().agg(F.max("count")).first()[0]
    assert most <= 3 * 20  # the 20 rows of key 2000 are 3 each at most


def test_repeats_of_a_row_are_dealt_out(spark):
    rows = spark.createDataFrame([("x", 2500), ("y", 1), ("z", 1000)], "a string, n long")
    assert {r["a"]: r["count"] for r in M._repeated(rows, "n").groupBy("a").count().collect()} == {"x": 2500, "y": 1, "z": 1000}


def test_places_in_an_order_need_no_python_worker(spark):
    out = numbered(spark.range(100).repartition(4), "i", F.desc("id"))
    assert "RDD" not in out._jdf.queryExecution().optimizedPlan().toString(), "rows of Python objects are pickled by workers"
    assert sorted((r["i"], r["id"]) for r in out.collect()) == [(i, 99 - i) for i in range(100)] and out.schema["i"].dataType.typeName() == "long"
    assert numbered(spark.range(0), "i", "id").collect() == []
    out = summed_before(spark.range(9), "s", F.col("id") / 2, "id")
    assert sorted((r["id"], r["s"]) for r in out.collect()) == [(i, i * (i - 1) / 4) for i in range(9)]
