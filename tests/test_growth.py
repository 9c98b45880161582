"""Work that grows with the input and not with its square; plain versions beside it."""

from __future__ import annotations

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from chronolith.operators import text as X


def invented(n: int, letters: str = "abcdefghij", seed: int = 1) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(4)) for _ in range(n))


def test_salient_terms_of_long_texts(spark):
    texts = ["The cat The CAT and dog Dog bird-s the", "", None, " ".join(["The"] * 12_000 + ["last"] + ["the"] * 3), invented(12_000)]
    start = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.salient_terms(F.col("t"), ["the", "and"]).alias("x"))
    got = {r["id"]: r["x"] for r in rows.collect()}
    assert time.time() - start < 20  # with a list of words for each word it took minutes
    assert got == {0: ["cat", "dog", "bird-s"], 1: [], 2: None, 3: ["last"], 4: list(dict.fromkeys(texts[4].split()))[:14]}


def test_matching_blocks_are_difflib_s(monkeypatch):
    from difflib import SequenceMatcher

    draw = random.Random(5)
    for few in (24, 0):
        monkeypatch.setattr(X, "FEW_WORDS", few)
        monkeypatch.setattr(X, "MANY", 10 * few)
        for _ in range(150):
            words = draw.choice([1, 2, 5, 40])
            a = [str(draw.randrange(words)) for _ in range(draw.randrange(70))]
            b = [w if draw.random() < 0.8 else str(draw.randrange(words + 2)) for w in a if draw.random() < 0.9] if draw.random() < 0.6 else [str(draw.randrange(words)) for _ in range(draw.randrange(70))]
            want = SequenceMatcher(None, a, b, autojunk=False)
            assert X.token_ops(" ".join(a), " ".join(b)) == [(op, " ".join(a[i:j]), " ".join(b[k:m])) for op, i, j, k, m in want.get_opcodes()]
            assert X.is_alike(" ".join(a), " ".join(b), 0.6) == (want.ratio() >= 0.6)


def test_words_that_repeat_do_not_cost_their_cube():
    a = [w for i in range(1500) for w in (f"x{i}", "|")]
    start = time.time()
    ops = X.token_ops(" ".join(a), " ".join(a).upper())
    assert time.time() - start < 10  # difflib takes minutes
    assert [o for o, _, _ in ops] == ["replace", "equal"] * 1500


def test_postings_are_counted_where_their_texts_lie(spark, tmp_path):
    from collections import Counter

    from chronolith.functions.porter import stem
    from chronolith.operators import ranking as R

    texts = {i: invented(i % 40, "ab", i) + (" Leaves, leaving" if i % 3 else "") for i in range(300)} | {300: None, 301: " ?! "}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = R.build_index(rows, f"{tmp_path}/index")
    words = {i: [w.strip(",").lower() for w in (t or "").split() if w != "?!"] for i, t in texts.items()}
    want = {(t, i, len(ws), n) for i, ws in words.items() for t, n in Counter(map(stem, ws)).items()}
    assert {tuple(r) for r in R.postings(index).collect()} == want
    assert {tuple(r) for r in R.vocabulary(index).collect()} == set(Counter(t for t, *_ in want).items())
    assert tuple(index.stats.first()) == (302, sum(map(len, words.values())) / 302)
    batches = rows.select("id", F.array_join(R.tokens(F.col("text")), " ").alias("words"))
    assert {tuple(r) for r in batches.mapInArrow(R._counted, "term string, id long, dl int, tf long").collect()} == want


def test_postings_of_a_repeated_id_are_one(spark, tmp_path):
    from chronolith.operators import ranking as R

    index = R.build_index(spark.createDataFrame([(1, "leave it"), (1, "leave me"), (1, "leave"), (None, "leave")], "id long, text string"), f"{tmp_path}/index")
    key = lambda x: (x[0], x[1] or 0, x[2])
    assert sorted((tuple(r) for r in R.postings(index).collect()), key=key) == [("it", 1, 2, 1), ("leav", None, 1, 1), ("leav", 1, 1, 1), ("leav", 1, 2, 2), ("me", 1, 2, 1)]
    assert R.build_index(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/none").stats.first()["avgdl"] is None


def test_no_text_moves_to_a_few_candidates(spark):
    from chronolith.operators import ranking as R

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(i, f"leave {i}") for i in range(50)], "id long, text string")
        found = R.reranked(spark.createDataFrame([(1, 7, 1), (1, 9, 2)], "query_id int, id long, rank int"), spark.createDataFrame([(1, "leave 9")], "query_id int, query string"), texts)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" not in plan and "BroadcastHashJoin" in plan
        assert [(r["id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(9, 1), (7, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_references_are_looked_for_where_they_may_begin(monkeypatch):
    from chronolith.operators import graph as G

    def plain(text):
        """A walk over all tokens."""
        scan, out = G._Scanner(text), []
        while scan.has():
            begin = scan.at
            kind, targets = G._reference(scan, "10.1", "a-1", 5)
            if targets is None:
                scan.at = begin + 1
            else:
                out.append((kind, scan.tokens[begin].start(), scan.tokens[scan.at - 1].end(), list(dict.fromkeys(targets))))
        return out

    draw = random.Random(2)
    bits = "paragraph Paragraphs ( ) (a) (1) ( b ) § §§ §1.2 1.2 5 12 5a U.S.C. USC CFR cfr part parts part351 351 subpart B of this section chapter and or , through . §§§1.4 6304 app. x_ (part this(section".split()
    for _ in range(3000):
        text = "".join(draw.choice(bits) + draw.choice(["", " ", "\n"]) for _ in range(draw.randrange(1, 25)))
        assert [(r["kind"], r["start"], r["end"], r["targets"]) for r in G.references(text, "10.1", "a-1")] == plain(text)

    read, token = [0], G._TOKEN

    class Counted:
        def finditer(self, *of):
            for m in token.finditer(*of):
                read[0] += 1
                yield m

    monkeypatch.setattr(G, "_TOKEN", Counted())
    assert len(G.references(invented(20_000) + " See § 101.1(a)(1).", "10.1", "a")) == 1
    assert read[0] < 50


def test_arrow_functions_over_tables_take_batches_of_bounded_bytes(spark, tmp_path):
    from chronolith import registry

    key, held = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset(key)
    try:
        spark.createDataFrame([(i, "x" * 100_000) for i in range(200)], "id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

        @F.pandas_udf("long")
        def together(x: pd.Series) -> pd.Series:
            return pd.Series([len(x)] * len(x))

        rows = registry.table(spark, str(tmp_path), "documents").select(together("text").alias("n")).collect()
        assert len(rows) == 200 and max(r["n"] for r in rows) <= 50
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def test_alignment_of_long_sources(spark):
    from chronolith.operators import verification as V

    source = ". ".join(f"S{i} {' '.join(invented(4, seed=i).split())}" for i in range(3000)) + "."
    claim = f"{source.split('. ')[1234]} {source.split('. ')[1235]}"
    rows = spark.createDataFrame([(0, claim, source), (1, "a b", "C d. E"), (2, "wine bread", "Bread here. Wine there. Both"), (3, "wine", None), (4, None, "Wine")], "id int, claim string, source string")
    start = time.time()
    got = {r["id"]: r["a"] for r in rows.select("id", V.align(F.col("claim"), F.col("source")).alias("a")).collect()}
    assert time.time() - start < 30
    assert (got[0]["share"], got[0]["length"], got[0]["start"]) == (1.0, 2, 1235)
    assert got[1] is None and got[3] is None and got[4] is None
    assert tuple(got[2]) == (1.0, 2, 1, "Bread here. Wine there.")
