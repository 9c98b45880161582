from __future__ import annotations

import sys

import numpy as np

from chronolith.llm import near_dedup as N
from chronolith.llm.components import connected_components

from .conftest import SCHEMA, edited, prose


def groups(rows, words, percent):
    """The smallest id of each row's group, by comparing all pairs of shingle sets."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((row[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else row[0]))
    return sorted(out, key=repr)


def test_messy_rows_agree_with_all_pairs(messy, messy_rows):
    got = N.near_duplicates(messy, 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == groups(messy_rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_group_of_near_copies_loses_no_link(spark):
    base = prose(150, 77)
    rows = [(i, edited(base, 0.002 * (i % 30), i), None, None, None, None, None) for i in range(260)]
    rows += [(1000 + i, prose(100, 500 + i // 2), None, None, None, None, None) for i in range(80)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == groups(rows, 3, 85)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    base = prose(150, 78)
    rows = [(i, edited(base, 0.003 * (i % 25), i), None, None, None, None, None) for i in range(120)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == groups(rows, 3, 85)


def test_long_texts_reach_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    plainly = N.shingle_set

    def watched(text, words):
        assert sys._getframe(1).f_locals["batch"].nbytes < 8 << 20, "a batch of many texts"
        return plainly(text, words)

    monkeypatch.setattr(N, "shingle_set", watched)
    base = [prose(3000, s) for s in range(8)]
    rows = [(i, f"{i // 2} {base[i % 8 // 2]} {base[4 + i // 80]}", None, None, None, None, None) for i in range(320)]
    before = spark.conf.get(key, None)
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1), 3, 85).collect()
    assert len(got) == 320 and spark.conf.get(key, None) == before
    assert len({r["component_id"] for r in got}) == 16


def test_empty_table(nothing):
    assert N.near_duplicates(nothing).collect() == []
    assert N.without_near_duplicates(nothing).collect() == []


def test_one_row_of_each_group_stays(messy, messy_rows):
    left = N.without_near_duplicates(messy, 3, 85)
    assert left.columns == messy.columns
    rows = left.collect()
    expected = groups(messy_rows, 3, 85)
    groups_with_id = {c for i, n, c in expected if n and c is not None}
    assert sorted(r["doc_id"] for r in rows if (r["text"] or "").split() and r["doc_id"] is not None) == sorted(groups_with_id)


def test_unrelated_rows_of_null_or_equal_id_stay(spark):
    ids = [None] * 4 + [7] * 4 + [9, 8]
    texts = [prose(60, 900 + i) for i in range(8)]
    rows = [(i, t, None, None, None, None, None) for i, t in zip(ids, [*texts, texts[0], texts[4]], strict=True)]
    rows += [(None, "", None, None, None, None, None), (None, None, None, None, None, None, None), (7, " ", None, None, None, None, None), rows[1], rows[5]]
    got = [(r["doc_id"], r["text"]) for r in N.without_near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()]
    want = [(9, texts[0])] + [(None, t) for t in texts[1:4]] + [(7, t) for t in texts[4:]] + [(None, ""), (None, None), (7, " ")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
        x, y = (N.odd_sketch(N.minhashes(np.unique(np.concatenate((shared, s))))).view(np.uint64) for s in (a, b))
        errors.append(N.estimate(int(np.bitwise_count(x ^ y).sum())) - 0.9)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_plans_miss_little():
    for words, percent in ((3, 85), (5, 80), (3, 60)):
        p = N.plan(words, percent)
        assert (1 - (percent / 100) ** p.rows) ** p.bands <= N.MISS and p.bands * p.rows <= N.SAMPLES
        assert N.estimate(p.most_bits) < percent / 100


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    hub = [(7, j) for j in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*chain, *hub, (5, 5)], "a long, b long")).collect()}
    assert {got[i] for i in range(100, 165)} == {100} and {got[j] for j in range(1000, 1100)} == {7} and 5 not in got
