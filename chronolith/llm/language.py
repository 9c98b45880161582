"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (1 to 3 code points) of a language, by rank. A
document is compared with each profile by the out-of-place distance: for each of its own most
frequent n-grams, the difference of ranks, or the profile's size where the profile lacks it. The
nearest profile names the language.

Texts are lower-cased; whatever is no letter counts as one blank, and runs of blanks as one. N-grams
of blanks alone don't count. Counting covers all texts of the learning rows: each task adds up its
own texts and Spark adds up the tasks, so only n-grams move, never texts.

Defined results: `und` with score 0 for a null text, a text without a letter, or where nothing was
learned; ties go to the n-gram, or language, that sorts first; a null id is never held out; an empty
table gives no rows; other columns pass unread. Every n-gram of a text counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: N-grams in a profile, of a language as of a document.
PROFILE = 300
#: The longest n-grams; three code points fit into one long.
LONGEST = 3
_FLUSH = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, itself if it is a lower-case or caseless letter, else 32."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.int64)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, blanks for what is no letter, one blank at each end and between words."""
    if not text:
        return np.empty(0, dtype=np.int64)
    raw = text.lower().encode("utf-32-le", "surrogatepass")
    x = _letters()[np.frombuffer(raw, dtype=np.uint32)]
    x = np.concatenate(([32], x, [32]))
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    return x if len(x) > 1 else np.empty(0, dtype=np.int64)


def grams(x: np.ndarray) -> np.ndarray:
    """All n-grams of an array from letters(), each as one long of 21 bits a code point."""
    if not len(x):
        return x
    out = [x[x != 32]]
    code = x
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << 21) | x[n - 1 :]
        out.append(code)
    return np.concatenate(out)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """The learned profiles, ready for many lookups."""

    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang)
        self.codes = np.array(sorted({c for codes in by_lang.values() for c in codes}), dtype=np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, np.array(by_lang[lang], dtype=np.int64))] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = letters(text)
        if not len(x) or not self.langs:
            return "und", 0.0
        own = top(*counted(grams(x)))
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[:, at]
        places = np.abs(ranks - np.arange(len(own)))
        distance = np.where(ranks < 0, PROFILE, np.minimum(places, PROFILE)).sum(axis=1)
        near = PROFILE * len(own) - distance  # 0: nothing in common
        best = int(np.argmax(near))
        total = float(near.sum())
        return self.langs[best], float(near[best]) / total if total else 1.0 / len(self.langs)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram and n over all rows of text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in sorted(held.items()):
                codes, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(letters(text))
            for lang, xs in texts.items():
                # texts end and begin with a blank; n-grams over the seam would have two in a row
                whole = np.concatenate(xs)
                codes, n = counted(grams(whole)) if len(whole) else (whole, whole)
                seam = ((codes >> 21) & 0x1FFFFF == 32) & (codes & 0x1FFFFF == 32) | (codes >> 21 & ((1 << 42) - 1) == (32 << 21 | 32))
                held.setdefault(lang, []).append((codes[~seam], n[~seam]))
                if len(held[lang]) >= 8:
                    held[lang] = [merged(held[lang])]
            if sum(len(c) for parts in held.values() for c, _ in parts) > _FLUSH:
                yield from flushed()
        yield from flushed()

    parts = rows.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language of rows; what comes to the driver is `size` numbers a language."""
    counts = gram_counts(rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    out: dict[str, list[int]] = {}
    for row in counts.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def identified(docs: DataFrame, learned: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred and score of docs' doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(learned)
        for batch in batches:
            found = pd.DataFrame([model.predict(x) for x in batch.column("text").to_pylist()], columns=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found["lang_pred"], pa.string()), pa.array(found["score"], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(-1))


def fold_of(value: object, folds: int) -> int:
    return -1 if value is None else zlib.crc32(str(value).encode()) % folds


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = profiles(docs.filter(fold(F.col("doc_id"), 3) != 1).select("text", "lang"))
    return identified(docs, learned).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
