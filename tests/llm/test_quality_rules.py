from __future__ import annotations

import re
from collections import Counter

from chronolith.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)


def test_counts_agree_with_brute_force(messy, messy_rows):
    got = Q.document_rules(messy).collect()
    assert Counter(tuple(r[c] for c in Q.STATS) for r in got) == Counter(brute(r[1]) for r in messy_rows)


def test_repeats_and_lines(spark):
    texts = ["a a a a", "a b c x a b c", "a b c a b c a b c", "x\n y\nx\n\n \nx", "a b", "\na b c d\r\na b c d\r", "|#$ %&*<> |"]
    got = {r["text"]: tuple(r[c] for c in Q.STATS) for r in Q.document_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: brute(t) for t in texts}


def test_texts_whose_cut_hashes_collide_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(Q, "_PLACES", 2)  # no text is short enough for packing
    texts = ["a b c x a b c " * 20, "one two three four"]
    got = {r["text"]: r["n_repeat_words"] for r in Q.document_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: brute(t)[4] for t in texts}


def test_verdicts_follow_the_hosts(spark):
    # host, base rule fails, another rule fails: how many rows
    counts = {("bad", True, False): 190, ("bad", False, False): 10, ("poor", False, True): 60, ("poor", False, False): 240, ("good", False, True): 2, ("good", True, False): 1, ("good", False, False): 2000, ("small", True, False): 2, ("small", False, False): 1, (None, True, True): 20, (None, False, False): 20}
    df = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "source string, base_failed boolean, suspect boolean")
    rates = {r["host"]: r for r in Q.host_rates(df).collect()}
    assert [h for h, r in rates.items() if r["host_failed"]] == ["bad"]
    assert {h for h, r in rates.items() if r["host_distrusted"]} >= {"bad", "poor", None} and not rates["good"]["host_distrusted"]
    assert 0 < rates["small"]["rate"] < 2 / 3 and rates["good"]["failed"] == 3  # three rows say little
    kept = {(r["source"], r["base_failed"], r["suspect"]): r["kept"] for r in Q.judged(df).distinct().collect()}
    assert not kept[("bad", False, False)]  # a fallen host takes all its documents along
    assert not kept[("poor", False, True)] and kept[("poor", False, False)]  # a distrusted one its suspects
    assert kept[("good", False, True)] and kept[("good", False, False)]  # a clean one nothing but failures
    assert kept[("small", False, False)] and kept[(None, False, False)] and not any(k for (_, failed, _), k in kept.items() if failed)


def test_a_planted_bad_host_loses_its_clean_documents(spark):
    text = " ".join(f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "amet") for b in "abcdefghijklmnopqr")
    rows = [(i, text if i % 10 == 0 else "too short", "spam.example") for i in range(300)] + [(i, text + (" ###" * 30 if i % 50 == 0 else ""), "fine.example") for i in range(300, 2300)]
    got = {r["doc_id"]: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(300)) and not got[0]["base_failed"]
    assert all(got[i]["kept"] for i in range(300, 2300)) and got[300]["suspect"]


def test_clashing_columns_give_way_and_empty_tables_pass(spark, messy, nothing):
    out = Q.quality_rules(messy)
    assert dict(out.dtypes)["n_words"] == "bigint" and sum(c.lower() == "kept" for c in out.columns) == 1
    assert Q.quality_rules(nothing).collect() == []
    odd = spark.createDataFrame([("a b", "s", 1, 2, 3)], "text string, source string, __w int, ___host int, Suspect int")
    got = Q.quality_rules(odd).first().asDict()
    assert got["__w"] == 1 and got["___host"] == 2 and got["n_words"] == 2 and "Suspect" not in got
