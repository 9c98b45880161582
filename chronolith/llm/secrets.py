"""Secret scan: three fixed patterns, and a randomness test battery for what they miss.

Candidates of the battery are maximal runs of key characters. For each, the encoding is inferred
(hex, base32, base36, base62 or base64 with its alphabet), and three statistics are taken: chi-squared
against uniform use of the alphabet, the number of runs of character classes, and the lag-1 serial
correlation of alphabet positions. Each is held against two hypotheses, a draw from the encoding and
ordinary text, and gives the logarithm of the ratio of its two p-values; so a sequence or repetition,
which no draw gives, counts against the candidate in the same sum. How unlikely ordinary letters and
digits keep to the inferred alphabet is added.

The sum's own distribution over ordinary identifiers (words in any case, joined by separators or
none, with numbers) is known by length (NULL), which turns it into a p-value. A Benjamini-Hochberg
procedure over the candidates of the whole table, each weighted by its length, controls the share
of false discoveries: longer candidates, which the tests tell better, get more of the error rate.
The table's p-values are counted in fine bins, so the driver sees a bounded number of counts.

Defined results: a null text counts as empty; an empty text has no spans; equal rows of a table get
equal results; other columns pass unread. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# The patterns and least lengths of the base kinds, as the contract lists them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer is dropped
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery have a digit and a letter, and this many characters; "=" ends a run, and up to two belong to it as padding where no key follows.
LEAST_RANDOM = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
FALSE_DISCOVERIES = 0.01

ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}

# Shares of letters in ordinary text, in percent.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.10, 0.07), strict=True))

#: Ordinary text repeats a character with this chance at least, changes class between neighbours with
#: this one, and its neighbours' positions in an alphabet correlate so much.
REPEAT, CHANGE, CORRELATION = 0.065, 0.25, 0.35

#: By length up to: the sum's median, 90 % and 99 % quantile over ordinary identifiers, and what it
#: grows by while the tail falls to a tenth (tests/llm/test_secrets.py draws them again).
NULL = ((23, -11.5, -1.4, 5.4, 3.8), (31, -17.9, -4.0, 3.9, 6.2), (47, -30.9, -11.4, 1.4, 6.7), (None, -38.0, -21.0, -8.0, 10.0))

#: Bins for a factor of 10 of the weighted p-values, and the bin beyond which none are told apart.
BINS, LAST = 64, 64 * 40


def infer_encoding(token: str) -> str:
    """The smallest alphabet that has all characters of the token, padding aside."""
    used = set(token.rstrip("="))
    return next((name for name, letters in ALPHABETS.items() if used <= set(letters)), "base64")


def _log_tail(z: float) -> float:
    """The logarithm of P(normal > z)."""
    p = 0.5 * math.erfc(z / math.sqrt(2))
    return math.log(p) if p > 0 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def _log_two_sided(z: float) -> float:
    return math.log(max(math.erfc(abs(z) / math.sqrt(2)), 1e-12))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def chi_squared_ratio(token: str, letters: str) -> float:
    """By the pairs of equal characters, from which Pearson's statistic against uniform use follows."""
    n, k = len(token), len(letters)
    pairs, same = n * (n - 1) / 2, sum(v * (v - 1) for v in Counter(token).values()) / 2
    mean = pairs / k
    q = max(REPEAT, 1.4 / k)
    spread = math.sqrt(pairs * q * (1 - q) + n * (n - 1) * (n - 2) * q * q / 4)
    return _log_two_sided((same - mean) / math.sqrt(mean * (1 - 1 / k))) - _log_tail((pairs * q - same) / spread)


def runs_ratio(token: str, letters: str) -> float:
    """By the changes of class between neighbours."""
    classes, n = [_class(c) for c in token], len(token) - 1
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    of = Counter(map(_class, letters))
    p = 1 - sum((v / len(letters)) ** 2 for v in of.values())
    return _log_two_sided((changes - n * p) / math.sqrt(n * p * (1 - p))) - _log_tail((changes - n * CHANGE) / math.sqrt(n * CHANGE * (1 - CHANGE)))


def serial_ratio(token: str, letters: str) -> float:
    """By the lag-1 correlation of alphabet positions; a constant token counts as fully correlated."""
    at = {c: i for i, c in enumerate(letters)}
    x = [at.get(c, 0) for c in token]
    a, b, n = x[:-1], x[1:], len(x) - 1
    ma, mb = sum(a) / n, sum(b) / n
    va, vb = sum((v - ma) ** 2 for v in a), sum((v - mb) ** 2 for v in b)
    r = sum((v - ma) * (w - mb) for v, w in zip(a, b, strict=True)) / math.sqrt(va * vb) if va and vb else 1.0
    return _log_two_sided((r + 1 / n) * math.sqrt(n)) - _log_tail((r - CORRELATION) * math.sqrt(n))


def alphabet_surprise(token: str, letters: str) -> float:
    """How unlikely ordinary letters and digits keep to the alphabet."""
    known = set(letters.lower())
    inside = sum(v for c, v in LETTERS.items() if c in known) / sum(LETTERS.values())
    digits = sum(c.isdigit() for c in letters) / 10
    return -sum(c.isalpha() for c in token) * math.log(inside) - sum(c.isdigit() for c in token) * math.log(digits)


def evidence(token: str) -> float:
    """The sum of the battery: above 0 a draw from the encoding explains the token better than text does."""
    body = token.rstrip("=")
    letters = ALPHABETS[infer_encoding(body)]
    return chi_squared_ratio(body, letters) + runs_ratio(body, letters) + serial_ratio(body, letters) + alphabet_surprise(body, letters)


def battery(token: str) -> float:
    """The p-value of "this is an ordinary identifier", as a power of 10 (0 or less)."""
    n, t = len(token.rstrip("=")), evidence(token)
    _, half, tenth, hundredth, decade = next(row for row in NULL if row[0] is None or n <= row[0])
    if t <= half:
        return 0.0
    if t <= tenth:
        return math.log10(0.5) + (t - half) / (tenth - half) * math.log10(0.2)
    if t <= hundredth:
        return -1 - (t - tenth) / (hundredth - tenth)
    return -2 - (t - hundredth) / decade


@dataclass(frozen=True)
class Rule:
    """What a table's candidates decide: their mean length, and the first bin that is a discovery."""

    mean: float
    least: float

    def bin(self, length: int, log_p: float) -> int:
        return min(math.floor(-(log_p - math.log10(length / self.mean)) * BINS), LAST)

    def finds(self, length: int, log_p: float) -> bool:
        return self.bin(length, log_p) >= self.least


def rule_of(mean: float, counts: Iterable[tuple[int, int]], rate: float = FALSE_DISCOVERIES) -> Rule:
    """The rule for a table with so many candidates (bin, count): of the bins whose largest p-value is
    at most rate * discoveries / candidates, the lowest."""
    counts = sorted(counts, reverse=True)
    m, found, least = sum(c for _, c in counts), 0, math.inf
    for b, c in counts:
        found += c
        if 10 ** (-b / BINS) <= rate * found / m:
            least = b
    return Rule(mean, least)


def discoveries(lengths: list[int], log_p: list[float], rate: float = FALSE_DISCOVERIES) -> list[bool]:
    """Which of a table's candidates are found."""
    if not lengths:
        return []
    open_rule = Rule(sum(lengths) / len(lengths), 0)
    rule = rule_of(open_rule.mean, Counter(map(open_rule.bin, lengths, log_p)).items(), rate)
    return [rule.finds(n, p) for n, p in zip(lengths, log_p, strict=True)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the three base kinds, in this order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of what the battery looks at, outside of the spans that are taken."""
    starts, ends = [], []  # of what is taken, joined where it overlaps
    for s, _, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    found = []
    for m in CANDIDATE.finditer(text):
        i = bisect_left(starts, m.end())
        if i == 0 or ends[i - 1] <= m.start():
            found.append((m.start(), m.end(), battery(m[0])))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def looked_at(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans and candidates."""
    text = text or ""
    base = base_spans(text)
    return base, candidates(text, base)


def decided(base: list[tuple[int, int, int]], seen: list[tuple[int, int, float]], rule: Rule) -> list[tuple[int, int, int]]:
    """All spans, in order."""
    return sorted([*base, *((s, 3, e) for s, e, p in seen if rule.finds(e - s, p))])


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of a text that is a table by itself."""
    base, seen = looked_at(text)
    found = discoveries([e - s for s, e, _ in seen], [p for *_, p in seen])
    return base, sorted([*base, *((s, 3, e) for (s, e, _), yes in zip(seen, found, strict=True) if yes)])


def redacted(text: str | None, spans: list[tuple[int, int, int]], mask: str = "[secret]") -> str | None:
    """The text with every span replaced, overlapping spans as one."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for start, _, stop in sorted(spans):
        if start > end:
            out += [text[at:start], mask]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


_SPAN = "struct<s:int,k:int,e:int>"
_SEEN = "struct<s:int,e:int,p:double>"


def table_rule(seen: DataFrame, rate: float = FALSE_DISCOVERIES) -> Rule:
    """The rule of a table's candidates (n, p), of which the driver gets counts by bin."""
    mean = seen.agg(F.avg("n").alias("m")).first()["m"]
    if mean is None:
        return Rule(1.0, math.inf)
    weighted = F.least(F.floor(-(F.col("p") - F.log10(F.col("n") / F.lit(mean))) * BINS), F.lit(LAST)).cast("int")
    return rule_of(mean, [tuple(r) for r in seen.groupBy(weighted.alias("b")).count().collect()], rate)


def scanned(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans, of docs' doc_id and text.

    Texts are read once; what was found in them is written and decided on when the whole table is known.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("p", pa.float64())]))]
        for batch in batches:
            found = [looked_at(x) for x in batch.column("text").to_pylist()]
            base = pa.array([[{"s": s, "k": k, "e": e} for s, k, e in b] for b, _ in found], kinds[0])
            seen = pa.array([[{"s": s, "e": e, "p": p} for s, e, p in c] for _, c in found], kinds[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), base, seen], ["doc_id", "base", "seen"])

    rows = written(docs.select("doc_id", "text").mapInArrow(look, f"doc_id {key}, base array<{_SPAN}>, seen array<{_SEEN}>"), "secret-candidates")
    rule = table_rule(rows.select(F.explode("seen").alias("c")).select((F.col("c.e") - F.col("c.s")).alias("n"), "c.p"), rate)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[(x["s"], x["k"], x["e"]) for x in b] for b in batch.column("base").to_pylist()]
            every = [decided(b, [(x["s"], x["e"], x["p"]) for x in c], rule) for b, c in zip(base, batch.column("seen").to_pylist(), strict=True)]
            counts = [[sum(k == kind for _, k, _ in x) for x in every] for kind in range(4)]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array([joined(x) for x in every])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return rows.mapInArrow(decide, f"doc_id {key}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """docs, same rows and columns, with every secret of text_col masked.

    Texts are read twice: for the candidates of the whole table, then to mask what was decided.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(e - s, p) for x in batch.column(0).to_pylist() for s, e, p in looked_at(x)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in seen], pa.int64()), pa.array([p for _, p in seen], pa.float64())], ["n", "p"])

    rule = table_rule(written(docs.select(f"`{text_col}`").mapInArrow(look, "n long, p double"), "secret-candidates"), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [redacted(x, decided(*looked_at(x), rule), mask) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
