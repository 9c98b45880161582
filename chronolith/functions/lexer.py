"""Words of a text with their places, and classes of words as a small grammar's alphabet."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

_WORD = re.compile(r"\d{4}-\d{2}-\d{2}|[^\W_]+(?:[.'’-][^\W_]+)*|[^\w\s]|_")


@dataclass(frozen=True)
class Word:
    low: str
    start: int
    end: int


def words_of(text: str) -> list[Word]:
    """Words and single signs, lower-cased."""
    return [Word(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def group(text: str) -> frozenset[str]:
    """A class of words from its members, separated by blanks."""
    return frozenset(text.split())


def follows(words: list[Word], at: int, *slots: Collection[str] | str) -> int | None:
    """The place behind a sequence of classes that starts at `at`; a class may be one word, and an
    optional one is a list."""
    for slot in slots:
        wanted = (slot,) if isinstance(slot, str) else slot
        if at < len(words) and words[at].low in wanted:
            at += 1
        elif not isinstance(slot, list):
            return None
    return at


def anywhere(words: list[Word], *slots: Collection[str] | str) -> bool:
    return any(follows(words, i, *slots) is not None for i in range(len(words)))
