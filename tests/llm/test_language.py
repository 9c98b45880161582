from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import language as L


def brute(texts):
    from collections import Counter

    c = Counter()
    for t in texts:
        s = " " + " ".join("".join(ch if ch.isalpha() else " " for ch in (t or "").lower()).split()) + " "
        for n in (1, 2, 3):
            c.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]).strip())
    code = lambda g: int(np.array([ord(ch) for ch in g], dtype=object).dot([1 << 21 * (len(g) - 1 - i) for i in range(len(g))]))
    return {code(g): n for g, n in c.items()}


def test_counts_agree_with_brute_force(messy, messy_rows):
    got = {}
    for r in L.gram_counts(messy.filter("lang is not null")).collect():
        got.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    for lang in ("en", "fr", "de"):
        assert got[lang] == brute([r[1] for r in messy_rows if r[2] == lang])


def test_profiles_tell_languages_apart(spark):
    one, two = "the and of thing other weather " * 30, "der und die sache ander wetter " * 30
    learned = L.profiles(spark.createDataFrame([(one, "en"), (two, "de"), (None, "en"), ("x", None)], "text string, lang string"))
    model = L.Profiles(learned)
    assert model.predict("the weather of the other thing")[0] == "en"
    assert model.predict("das wetter und die andere sache")[0] == "de"
    for text in (None, "", "123 !?"):
        assert model.predict(text) == ("und", 0.0)
    assert all(0 <= model.predict(t)[1] <= 1 for t in ("the", "中文", "q"))


def test_out_of_place_distance_by_hand():
    model = L.Profiles({"a": [1, 2, 3], "b": [3, 2, 1]})
    own = np.array([1, 3])
    at = np.searchsorted(model.codes, own)
    assert [int(np.abs(model.ranks[i][at] - np.arange(2)).sum()) for i in range(2)] == [1, 3]


def test_edges(messy, nothing, messy_rows):
    got = L.identified(messy, {}).collect()
    assert len(got) == len(messy_rows) and {r["lang_pred"] for r in got} == {"und"}
    assert L.identified(nothing, {"en": [1]}).collect() == [] and L.profiles(nothing) == {}


def test_folds_agree(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert all(r["f"] == L.fold_of(r["doc_id"], 3) for r in rows.select("doc_id", L.fold(F.col("doc_id"), 3).alias("f")).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op2_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
