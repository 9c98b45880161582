from __future__ import annotations

from datetime import date
from difflib import SequenceMatcher

from chronolith.operators import graph as G
from chronolith.operators import questions as Q
from chronolith.operators import text as X
from chronolith.operators import verification as V
from chronolith.sources import html, markup


def test_sentences_do_not_break_after_abbreviations():
    text = "See 5 U.S.C. Chapter 3. It applies (e.g. to all). Done"
    assert [text[a:b] for a, b in X.sentence_bounds(text)] == ["See 5 U.S.C. Chapter 3.", "It applies (e.g. to all).", "Done"]
    assert X.sentence_bounds("  ") == []


def test_packing_overlaps_and_ends():
    text = " ".join(f"Word{i} is here now." for i in range(30))
    spans = X.packed(text, most=20, overlap=1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))
    assert all(len(text[a:b].split()) <= 20 for a, b in spans)


def test_word_operations_agree_with_the_ratio():
    a, b = "the quick brown fox", "the slow brown fox jumps"
    ops = X.token_ops(a, b)
    assert [o for o, _, _ in ops] == ["equal", "replace", "equal", "insert"]
    same = sum(len(x.split()) for o, x, _ in ops if o == "equal")
    assert 2 * same / 9 == SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def test_ranges_and_elided_prefixes():
    assert G.between("c", "e") == ["d"]
    assert G.between("i", "iv") == ["ii", "iii"]
    assert G.between("9", "12") == ["10", "11"]
    assert G.designators("(a)(1) through (4)") == ["a-1", "a-2", "a-3", "a-4"]
    assert [G.roman(n) for n in (4, 9, 14, 40, 1999)] == ["iv", "ix", "xiv", "xl", "mcmxcix"]
    assert all(G.roman_value(G.roman(n)) == n for n in range(1, 300)) and all(G.alpha_value(G.alpha(n)) == n for n in range(1, 800))


def test_references_by_kind():
    found = G.references("Paragraphs (2) through (4) and § 630.310(a); 5 U.S.C. 6304, this section.", "630.201", "b-6")
    assert [(r["kind"], r["targets"]) for r in found] == [("paragraph", ["630.201#b-2", "630.201#b-3", "630.201#b-4"]), ("section", ["630.310#a"]), ("usc", []), ("scope", ["630.201"])]
    assert G.references(None) == []
    kinds = lambda t, *a: [(r["kind"], r["phrase"], r["targets"]) for r in G.references(t, *a)]
    assert kinds("paragraph (d) of § 630.309 and § 630.310(a)", "630.1") == [("paragraph", "paragraph (d) of § 630.309", ["630.309#d"]), ("section", "§ 630.310(a)", ["630.310#a"])]
    assert kinds("under § 6.7 of this chapter") == [("section", "§ 6.7", ["6.7"]), ("scope", "this chapter", [])]
    assert kinds("5 U.S.C. Chapter 43, 5 CFR part 351, 5 CFR 351.403(a)(1) and 29 CFR 541.100") == [("usc", "5 U.S.C. Chapter 43", []), ("cfr", "5 CFR part 351", []), ("cfr", "5 CFR 351.403(a)(1)", ["351.403#a-1"]), ("cfr", "29 CFR 541.100", [])]
    assert kinds("subpart B of part 351; parts 351, 630 and 752; this section", "9.9") == [("scope", "subpart B of part 351", []), ("scope", "parts 351, 630 and 752", []), ("scope", "this section", ["9.9"])]
    assert kinds("paragraphs (a), (c), and (d) of this section", "1.1") == [("paragraph", "paragraphs (a), (c), and (d) of this section", ["1.1#a", "1.1#c", "1.1#d"])]
    assert kinds("5 apples, § of, paragraph b, section 5") == []


def test_expansion_keeps_to_budget_and_ends_on_cycles(spark):
    rows = spark.createDataFrame([(f"1.1#{c}",) for c in "abcdef"], "chunk_id string")
    links = spark.createDataFrame([("1.1#a", "1.1#b", 0), ("1.1#a", "1.1#c", 1), ("1.1#b", "1.1#a", 0), ("1.1#c", "1.1#d", 0), ("1.1#d", "1.1#e", 0)], "source string, target string, pos int")
    seeds = spark.createDataFrame([(1, "1.1#a", 1)], "query_id int, chunk_id string, rank int")
    walk = lambda budget, depth: [r["chunk_id"][-1] for r in G.expand(seeds, links, rows, budget, depth).orderBy("rank").collect()]
    assert walk(4, 1) == ["a", "b", "c"]
    assert walk(4, 3) == ["a", "b", "c", "d", "e"]
    assert walk(2, 3) == ["a", "b", "c"]


def test_ancestors_never_satisfy(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("1.1#a-1", ["1.1#a"]), ("1.1#a", ["1.1#a-1"]), ("1.1", ["1.1#z"]), ("1.1", ["1.10#z"])], "t string, p array<string>")
    assert [r[0] for r in rows.select(G.satisfied(F.col("t"), F.col("p"))).collect()] == [False, True, True, False]


def test_dates_reserve_their_characters():
    today = date(2024, 6, 1)
    assert Q.dates_in("between 2019 and 2023", today) == ["2019-12-31", "2023-12-31"]
    assert Q.dates_in("before the 2020 amendment, as of June 2021 and on March 5, 2022", today) == ["2019-12-31", "2021-06-30", "2022-03-05"]
    assert Q.dates_in("currently, since 2030", today) == ["2024-06-01"]
    assert Q.dates_in("on 2021-02-30", today) == []
    assert Q.dates_in(None, today) == []


def test_framing_comes_off_in_layers():
    for text, want in (("So, what is the annual leave ceiling?", "annual leave ceiling"), ("Could you please tell me about credit hours", "credit hours"), ("Am I eligible for a raise?", "raise"), ("Any rules about wearing a uniform on duty?", "wearing a uniform on duty"), ("how many sections apply to it", "sections"), ("what", "what"), ("", ""), (None, ""), ("whatever holds", "whatever holds"), ("an agency may act", "agency may act")):
        assert Q.strip_frame(text) == want, text


def test_questions_by_kind():
    asked = {
        "temporal_compare": ["What changed in the rules between 2019 and 2023?", "How has the probationary period changed since 2017?", "What is the difference between the limits?", "Rules before and after the amendment", "Compare the rules in 2018 and 2024.", "What did the rule used to say?"],
        "absence": ["Is there any rule about equipment?", "Are there any provisions covering stipends?", "Is there anything about schedules?", "Does any regulation address commuting?", "Any rules about a uniform?"],
        "applicability": ["Does this apply to me?", "Does the period apply to a wage grade employee?", "Am I entitled to an increase?", "Do I qualify for tenure?", "Is a term employee eligible for an increase?", "Which employees are covered by the act?"],
        "aggregate": ["List all the parts that govern leave.", "How many sections cover probation?", "Which sections mention increases?", "What are all of the exceptions?", "Enumerate the factors."],
        "temporal_point": ["What was the limit as of June 2021?", "At the time of the amendment, what was the rate?", "Back in 2018, how much leave could be carried over?"],
        "lookup": ["What did the rule say in 2019?", "annual leave", "", None],
    }
    for kind, texts in asked.items():
        assert [Q.classify(t)[0] for t in texts] == [kind] * len(texts), kind
    assert Q.classify("annual leave") == ("lookup", 0.35) and Q.classify("What was the limit as of June 2021?") == ("temporal_point", 0.9)
    assert Q.elliptical("what about it") and not Q.elliptical("annual leave ceiling rules")


def test_conditions_and_what_they_refer_to():
    got = lambda t: [(q["kind"], q["clause"], q["refers_to"]) for q in V.find_qualifiers(t, "630.1", "a", True)]
    assert got("Except as provided in paragraph (b) of this section, an employee may not exceed 480 hours.") == [("except", "Except as provided in paragraph (b) of this section", ["630.1#b"]), ("bound", "may not exceed 480 hours", [])]
    assert got("It will not cause the total to exceed 25 percent, at a time other than the end.") == [("bound", "will not cause the total to exceed 25 percent, at a time other than the end", [])]
    assert [k for k, *_ in got("Staff other than temporary staff shall not act, provided the head agrees; records provided by staff.")] == ["other_than", "prohibition", "proviso"]
    assert got("Each of these:") == [("chapeau", "Each of these:", [])]
    assert V.find_qualifiers("Each of these:") == [] == V.find_qualifiers(None)


def test_clauses_end_outside_of_brackets():
    found = V.find_qualifiers("Covered, except staff (as defined; see b) on leave; other text unless told.")
    assert [(q["kind"], q["clause"]) for q in found] == [("except", "except staff (as defined; see b) on leave"), ("unless", "unless told")]


def test_boilerplate_goes_and_headings_open_units():
    page = "<html><head><title> A  B </title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>One</h1><p>First.<br>Line</p><table><tr><th>a</th><td>b</td></tr></table><h2>One</h2><p>Second</p></article><script>x='</p>'</script></body></html>"
    found = html.units(page)
    assert [(u["anchor"], u["kind"], u["text"]) for u in found] == [("one", "prose", "First.\nLine"), ("one.2", "table", "a | b"), ("one.3", "prose", "Second")]
    assert html.units(None) == [] and html.units("<p>x") == [{"anchor": "top", "heading": "", "kind": "prose", "text": "x"}]


def test_designator_streams_are_placed_as_a_whole():
    assert markup.place("a 1 i ii 2 b".split()) == ["a", "a-1", "a-1-i", "a-1-ii", "a-2", "b"]
    assert markup.place("a b c d e f g h i j".split())[-2:] == ["i", "j"]
    assert markup.place([]) == []


def test_apparatus_goes_and_tails_stay():
    import xml.etree.ElementTree as ET

    node = ET.fromstring("<P>before<FTNT>note</FTNT> after</P>")
    assert markup.text_of(markup.strip_apparatus(node)) == "before after"
    assert markup.text_of(markup.strip_apparatus(node)) == "before after"


def test_renumberings_are_those_of_the_plain_greedy(spark):
    import random

    draw = random.Random(4)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnop")
    before, after = {"a": "same words here", "b": "same words here", "e": " ", "n": "keep this"}, {"c": "same words here", "d": "same words here", "f": "", "n": "keep this"}
    for i in range(40):
        tokens = [word() for _ in range(draw.choice([1, 4, 9, 10, 11, 20, 60, 200]))]
        before[f"g{i}"] = " ".join(tokens)
        for j in range(2):
            changed = [draw.choice([w, w + " " + "long" * 9, "x"]) if draw.random() < 0.1 else w for w in tokens]
            after[f"h{draw.randrange(10**6)}"] = " ".join(changed)
            before[f"k{i}.{j}"] = " ".join(w for w in changed if draw.random() > 0.03)
    taken, want = {}, set()
    for old in sorted(set(before) - set(after)):
        for new in sorted(set(after) - set(before)):
            if new not in taken and SequenceMatcher(None, before[old].split(), after[new].split(), autojunk=False).ratio() >= 0.9:
                taken[new] = old
                break
    want = {(old, new, "renumbered") for new, old in taken.items()} | {(s, None, "removed") for s in set(before) - set(after) - set(taken.values())} | {(s, None, "added") for s in set(after) - set(before) - set(taken)} | {("n", None, "unchanged")}
    frame = lambda d: spark.createDataFrame([(k, v, v) for k, v in d.items()], "section string, text string, raw string")
    got = [tuple(r) for r in X.snapshot_diff(frame(before), frame(after)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("a", "c", "renumbered"), ("b", "d", "renumbered"), ("e", "f", "renumbered")} <= want and len(taken) > 20


def test_snapshots_hold_documents_of_any_length(spark, tmp_path):
    from chronolith.plans.text import d4

    rows = [(i, f"w{i} " * 600, 2400) for i in range(18)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = {(r["section"], r["kind"]) for r in d4(spark, str(tmp_path)).collect()}
    assert {("0", "unchanged"), ("2", "added"), ("3", "removed"), ("4", "renumbered"), ("7", "apparatus"), ("13", "renumbered")} <= kinds
