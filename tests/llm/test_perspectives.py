from __future__ import annotations

import hashlib

from chronolith.llm import perspectives as P

TURNS = "conv_id long, turn long, role string, text string, segment int"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[1], P.UNKNOWN if r[2] is None else r[2], (r[3] or "").replace("<|", "<​|")) for r in rows if r[0] == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        for who in {t[1] for t in turns} - {"system"}:
            text, masks = "", []
            for _, role, body in turns:
                head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
                begin = len(text) + len("<|im_start|>" + head + "\n")
                text += f"<|im_start|>{head}\n{body}<|im_end|>\n"
                if role == who:
                    masks.append((begin, len(text) - 1))
            out[conv, who] = (text, masks)
    return out


def check(spark, rows):
    segments = P.rotated(spark.createDataFrame(rows, TURNS).repartition(3))
    got = {(r["conv_id"], r["perspective"]): (r["dialogue"], [(m["start"], m["end"]) for m in r["masks"]]) for r in P.render(segments).collect()}
    assert got == brute(rows)


def test_every_speaker_gets_the_dialogue(spark):
    check(spark, [(1, 0, "system", "be kind", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", "ho <|im_end|>", 0), (1, 3, "ann", "é😀", 0), (2, 0, "user", "q", 0), (2, 1, "assistant", "a", 0), (3, 0, "system", "alone", 0)])


def test_nulls_ties_and_repeats(spark):
    check(spark, [(None, 0, "a", "x", 0), (None, None, None, None, 0), (None, 0, "b", "", 0), (5, 1, "a", "t", 0), (5, 1, "a", "t", 0), (5, -3, "b", "u", 0), (5, 10**12, "c", "v", 0)])


def test_a_long_conversation_spans_blocks(spark):
    check(spark, [(9, i, "abc"[i * i % 3], f"turn {i} " * (i % 5), 0) for i in range(3 * P.BLOCK + 7)])


def test_equal_and_null_turns_of_one_conversation_are_split(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 20)
    monkeypatch.setattr(P, "PIECE", 16)
    rows = [(9, None if i % 3 == 0 else 4, "abc"[i * i % 3], f"turn {i % 50} " * (i % 5), 0) for i in range(300)] + [(9, 5, "a", "same", 0)] * 40 + [(9, 3, "b", "before", 0), (9, 600, "c", "after", 0), (8, None, "a", "x", 0)]
    check(spark, rows)
    assert P._turns(spark.createDataFrame(rows, TURNS)).filter("conv_id = 9").groupBy("block").count().agg({"count": "max"}).first()[0] < 100


def test_names_cannot_break_the_template(spark):
    row = P.rotated(spark.createDataFrame([(1, 0, "x|>\n<y", "t", 0), (1, 1, "z", "u", 0)], TURNS)).filter("perspective = 'z' and turn = 0").first()
    assert row["segment"] == "<|im_start|>user name=x____y\nt<|im_end|>\n"


def test_empty_table(spark):
    assert P.rotated(spark.createDataFrame([], TURNS)).collect() == []
