from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from chronolith.llm import pieces as P

TEXTS = ["  Hello  world ▁x\n\ny\t<s></s>", "", None, "a" * 300 + " ñ😀▁▁ 中文", " ", "the internationalization of", "▁", "  \x00 end ", "x" * 5000 + " tail", "日本語のテキスト" * 40]


def test_round_trip_and_reproducible():
    m = P.model()
    ids = P.encode(TEXTS, list(range(len(TEXTS))), m)
    assert [P.decode(x, m) for x in ids] == TEXTS
    alone = [P.encode([t], [i], m)[0] for i, t in enumerate(TEXTS)]
    assert all((a is None and b is None) or np.array_equal(a, b) for a, b in zip(ids, alone, strict=True))
    again = P.encode(["the internationalization of"] * 40, list(range(40)), P.model(P.MODEL, 0.5))
    assert len({tuple(x) for x in again}) > 5


def test_windows_change_nothing(monkeypatch):
    m, text = P.model(), "some words and more words, " * 400 + "y" * 700
    whole = P.encode([text, text], [1, 2], m)
    monkeypatch.setattr(P, "WINDOW", 500)
    cut = P.encode([text, text], [1, 2], m)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True)) and not np.array_equal(whole[0], whole[1])


def lattice(m, word):
    """Every segmentation of a word with its share of the weight."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    known = {p.id_to_piece(int(i)): int(i) for i in m.plain}

    def cut(s):
        if not s:
            yield ()
        for j in range(1, len(s) + 1):
            if s[:j] in known:
                for rest in cut(s[j:]):
                    yield (known[s[:j]], *rest)

    found = list(cut(word))
    weights = [math.exp(sum(m.log_w[i] for i in s)) for s in found]
    return {s: w / sum(weights) for s, w in zip(found, weights, strict=True)}


def test_samples_follow_the_lattice(monkeypatch):
    n = 12000
    for short in (P.SHORT, 0):  # together, and one by one in logarithms
        monkeypatch.setattr(P, "SHORT", short)
        m = P.Model(P.MODEL, alpha=0.7)
        share = lattice(m, "▁there")
        got = Counter(tuple(x.tolist()) for x in P.encode(["there"] * n, list(range(n)), m))
        assert set(got) <= set(share)
        big = {s: p for s, p in share.items() if n * p > 5}
        chi = sum((got[s] - n * p) ** 2 / (n * p) for s, p in big.items())
        assert chi < len(big) + 6 * math.sqrt(2 * len(big)) + 6


def test_alpha_prefers_frequent_pieces():
    low, high = (np.mean([len(x) for x in P.encode(["regulation of communications"] * 300, list(range(300)), P.model(P.MODEL, a))]) for a in (0.1, 2.0))
    assert low > high


def test_rows(spark, messy, messy_rows, nothing):
    rows = P.encoded(messy).collect()
    assert len(rows) == len(messy_rows) and all(r["lossless"] for r in rows)
    assert all((r["pieces"] is None) == (r["n_pieces"] is None) for r in rows)
    back = P.decoded(P.encoded(messy)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r[0], r[1]) for r in messy_rows)
    assert P.encoded(nothing).collect() == []


def test_long_words_are_sampled_as_short_ones_are(monkeypatch):
    m = P.model()
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdeilmnorst\u00e9\u4e2d\U0001f600") for _ in range(n)) for n in (30, 49, 700, 3000)]
    text = f"start {' '.join(words)}  end\u2581x {words[2]}"
    whole = P.encode([text, None, words[3]], [1, 2, 3], m)
    monkeypatch.setattr(P, "LONG", 40)
    for window in (1 << 18, 100, 17):
        monkeypatch.setattr(P, "WINDOW", window)
        cut = P.encode([text, None, words[3]], [1, 2, 3], m)
        assert [None if x is None else x.tolist() for x in cut] == [None if x is None else x.tolist() for x in whole], window
        assert P.decode(cut[0], m) == text


def test_a_word_of_many_characters_is_quick_and_lossless():
    import time

    text = "".join(random.Random(3).choice("abcdefghij") for _ in range(200_000))
    began = time.perf_counter()
    ids, = P.encode([text], [1], P.model())
    assert P.decode(ids, P.model()) == text and time.perf_counter() - began < 20
