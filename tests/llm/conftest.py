from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, KEPT int"
VOCABULARY = [f"{a}{b}" for a in "ba ce di fo gu ka le mi no ru".split() for b in "lan sor tin vek mar dul".split()]


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(text: str, share: float, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) + "x" if draw.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows; two columns clash with results."""
    long = prose(30_000, 1)
    base = [prose(120, s) for s in range(2, 30)]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "src1", "src2", ""][i % 4], len(t), "x", 1) for i, t in enumerate(base)]
    rows += [(100, None, "en", "src1", None, None, None), (101, "", "fr", "src2", 0, "", 0), (102, " \t\n ", None, None, 3, "x", 1), (103, long, "en", "src1", len(long), "x", 1), (104, "One", "en", "src1", 3, "x", 1), (105, "one", "en", "src1", 3, "x", 1)]
    rows += [(None, base[0], "en", "src1", 5, "x", 1), (None, None, None, None, None, None, None), rows[3], rows[3], (106, "é ß 中文 😀 ▁   x", "de", "src2", 9, "x", 1)]
    rows += [(200 + i, edited(base[5], 0.02, i), "en", "src1", 1, "x", 1) for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
