from __future__ import annotations

import numpy as np

from chronolith.llm import quality_gam as G
from chronolith.llm.language import fold_of


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) > 0).astype(float)
    m = G.fit(x, y)
    slow = [m.intercept + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(m.singles, m.edges, row, strict=True)) + sum(t[np.searchsorted(m.edges[i], row[i], side="right"), np.searchsorted(m.edges[j], row[j], side="right")] for (i, j), t in m.pairs.items()) for row in x[:50]]
    assert np.allclose(m.margin(x[:50]), slow)
    assert ((m.score(x) > 0.5) == y).mean() > 0.93


def test_pairs_catch_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = G.fit(x, y, pairs=1)
    assert list(m.pairs) == [(0, 1)]
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    assert ((G.fit(x, y, pairs=0).score(x) > 0.5) == y).mean() < 0.7


def test_few_or_equal_labels():
    assert G.fit(np.empty((0, 2)), np.empty(0)).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert G.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((1, 2)))[0] == 6 / 7


def test_features_of_odd_texts():
    for text in (None, "", "\n\n", "é" * 9, "A!! B!!\nA!! B!!", "x" * 100_000):
        assert len(G.features(text)) == len(G.FEATURES) and np.isfinite(G.features(text)).all()


def test_edges(spark, messy, nothing, messy_rows):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(28)] + [(None, 1, 0), (3, None, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = G.learned(messy.drop("KEPT"), labels)
    got = G.scored(messy, model).collect()
    assert len(got) == len(messy_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert G.learned(messy.withColumnsRenamed({"lang": "y", "source": "id", "n_chars": "h"}).drop("KEPT"), labels.withColumnRenamed("toxic", "y")).margin(np.ones((1, 16))) == model.margin(np.ones((1, 16)))
    empty = G.learned(nothing, labels.limit(0))
    assert G.scored(nothing, empty).collect() == []


def test_repeated_ids_do_not_go_beyond_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 20, f"text {i} !!", i) for i in range(2000)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(G, "fit", lambda x, y: seen.append(len(x)))
    G.learned(docs, labels, sample=5)
    assert seen == [5]


def test_scores_agree_with_a_plain_model(spark):
    """Every row's score, by a walk over the model's tables without numpy, from the query's own training rows."""
    import math
    from bisect import bisect_right

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    taught = sorted((r["doc_id"], int(r["quality"] > 0)) for r in labels.collect() if r["quality"] is not None and fold_of(r["doc_id"], 5) != 0 and r["doc_id"] in texts)
    m = G.fit(np.array([G.features(texts[i]) for i, _ in taught]), np.array([float(y) for _, y in taught]))
    want = {}
    for i, t in texts.items():
        at = [bisect_right(e.tolist(), v) for e, v in zip(m.edges, G.features(t), strict=True)]
        margin = m.intercept + sum(t[b] for t, b in zip(m.singles, at, strict=True)) + sum(t[at[j]][at[k]] for (j, k), t in m.pairs.items())
        want[i] = 1 / (1 + math.exp(-margin))
    got = {r["doc_id"]: r for r in G.op7_quality_gam(spark, sf).collect()}
    assert set(got) == set(want)
    assert all(abs(r["score"] - want[i]) < 1e-6 and r["held_out"] == (fold_of(i, 5) == 0) for i, r in got.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = G.op7_quality_gam(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(fold_of(r["doc_id"], 5) == 0 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9
