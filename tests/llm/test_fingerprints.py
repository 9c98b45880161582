from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import fingerprints as P

from .conftest import prose


def plain(spark, rows):
    """The query's rows by a plain walk; rows are (id, text)."""
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""], r[1] or ""))
    want = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = P.sketch_of(text), P.sketch_of(changed), P.sketch_of(after)
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), P.fingerprint(own), P.fingerprint(other), P.likeness(own, other), P.likeness(own, following), P.containment(own, other), P.containment(own, following)))
    return sorted(want, key=repr)


def test_rows_agree_with_a_plain_walk(spark, messy, messy_rows, nothing):
    want = plain(spark, [(r[0], r[1]) for r in messy_rows])
    for size in (P.RANGE_CHARS, 3000):  # one range a task, and many
        assert sorted((tuple(r) for r in P.fingerprints(messy, size).collect()), key=repr) == want
    assert P.fingerprints(nothing).collect() == []


def test_hot_and_null_ids_are_split_among_ranges(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(20, i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in P.fingerprints(docs, 2000).collect()), key=repr) == plain(spark, rows)
    dealt = P.with_next(docs, 2000).filter("not __copy")
    assert dealt.filter("doc_id is null").select("__range").distinct().count() > 3
    assert dealt.filter("doc_id = 7").select("__range").distinct().count() > 3


def test_every_hash_below_the_fraction_is_kept():
    h = np.unique(P.shingle_hashes(P.code_points(prose(5000, 3))))
    kept = P.sketch_of(prose(5000, 3))
    assert np.array_equal(kept, h[h < np.uint64((1 << 64) // P.SCALE)])
    assert abs(len(kept) / len(h) - 1 / P.SCALE) < 0.01


def test_sketches_merge_and_estimate_containment_of_unequal_documents():
    part, rest = prose(3000, 1), prose(60000, 2)
    a, b = P.sketch_of(part), P.sketch_of(part + " " + rest)
    both = P.merged(a, P.sketch_of(rest))
    assert len(np.setdiff1d(b, both)) <= 3
    assert P.containment(a, b) == 1.0 and P.containment(np.empty(0, np.uint64), a) == 1.0
    assert abs(P.containment(b, a) - len(a) / len(b)) < 1e-9


def test_fingerprints_merge_as_texts_do():
    texts = ["abcdefg", "hijklmn", "xyz", "", prose(200, 4), prose(3, 5)]
    for x in texts:
        for y in texts:
            hashes = np.concatenate([P.shingle_hashes(P.code_points(t)) for t in (x, y)])
            assert P.fingerprint(P.merged(P.sketch_of(x), P.sketch_of(y))) == P.fingerprint(P.kept(hashes))
            again = P.merged(P.parsed(P.fingerprint(P.sketch_of(x))), P.parsed(P.fingerprint(P.sketch_of(y))))
            assert P.fingerprint(again) == P.fingerprint(P.kept(hashes))


def test_short_texts_are_told_apart():
    assert P.fingerprint(P.sketch_of("abc")) != P.fingerprint(P.sketch_of("abd")) != ""
    assert P.likeness(P.sketch_of("abc"), P.sketch_of("abc")) == 1.0 and P.likeness(P.sketch_of("abc"), P.sketch_of("abd")) == 0.0


def test_likeness_follows_the_share_of_shingles():
    errors = []
    for s in range(20):
        x, y = prose(600, s), prose(600, 100 + s)
        z = P.edited(x, y)
        a, b = ({t[i : i + P.SHINGLE] for i in range(len(t) - P.SHINGLE + 1)} for t in (x, z))
        errors.append(P.likeness(P.sketch_of(x), P.sketch_of(z)) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_empty_texts():
    empty = P.sketch_of("")
    assert P.fingerprint(empty) == "" and P.likeness(empty, empty) == 1.0 and P.likeness(empty, P.sketch_of("a")) == 0.0
