"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features in turn: each step fits a
shallow tree on the bins of one feature to the current residuals and adds its leaves, scaled by a
small rate, to that feature's lookup table. Then the pairs whose best cross-cut explains most of what
is left get tables of their own, filled in the same way. A score is the logistic of a sum of table
entries, looked up for a whole batch at once.

The model is fitted on the driver to a bounded sample: of the labels those with the smallest hashes of
their ids, and of the documents they join the rows with the smallest hashes of id, text and label, at
most `sample` of either. Features and scores cover whole texts of all rows.

Defined results: a null text counts as empty; all texts get a score; rows without a label, with a
null one or in the held-out fold teach nothing; with labels of one kind only, or none, every score is
that label's smoothed share; repeated labels and documents of an id each count; an empty table gives
no rows; other columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import fold

#: Labelled rows that are fitted at most.
SAMPLE = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "symbols", "exclaims", "bars", "upper", "digits", "punctuation", "non_ascii", "distinct_words", "repeated_lines", "lines", "capitalised", "longest_word", "marked_words",
)

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LOWER = bytes(range(97, 123))
_SYMBOLS, _ENDS = b"#*$%&<>@{}[]\\^~_=+/", b".,;:?"


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def features(text: str | None) -> list[float]:
    """The numbers named in FEATURES, of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    n, m = max(len(raw), 1), max(len(ws), 1)
    upper, lower = _count(raw, _UPPER), _count(raw, _LOWER)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = _count(raw, _SYMBOLS)
    return [
        np.log1p(len(raw)), np.log1p(len(ws)), sum(map(len, ws)) / m, symbols / m, raw.count(b"!") / m, raw.count(b"|") / m, upper / max(upper + lower, 1), _count(raw, _DIGITS) / n, _count(raw, _ENDS) / m,
        (len(raw) - len(raw.translate(None, bytes(range(128, 256))))) / n, len(set(ws)) / m if ws else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, len(lines) / m, sum(w[:1].isupper() for w in ws) / m,
        np.log1p(max(map(len, ws), default=0)), sum(not w[-1:].isalnum() and w[-1:] < b"\x80" for w in ws) / m,
    ]


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """A tree of this depth over ordered bins with gradients g and hessians h, as a value for each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
    at = int(np.argmax(gain))
    if not gain[at] > g.sum() ** 2 / (h.sum() + ridge) + 1e-12:
        return out
    return np.concatenate([_leaves(g[: at + 1], h[: at + 1], depth - 1, least, ridge), _leaves(g[at + 1 :], h[at + 1 :], depth - 1, least, ridge)])


def _cross(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes into four quadrants: its gain, and a value for each cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = slice(None, -1), slice(-1, None)
    quads = [(X[a, a], X[a, b] - X[a, a], X[b, a] - X[a, a], X[b, b] - X[a, b] - X[b, a] + X[a, a]) for X in (G, H)]
    ok = np.all([q >= least for q in quads[1]], axis=0)
    gain = np.where(ok, sum(x**2 / (y + ridge) for x, y in zip(*quads, strict=True)), -np.inf)
    if not gain.size or not np.isfinite(gain.max()):
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]), out


class Additive:
    """Bin edges and lookup tables."""

    def __init__(self, edges: list[np.ndarray], intercept: float, singles: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.edges, self.intercept, self.singles, self.pairs = edges, intercept, singles, pairs

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for k, t in enumerate(self.singles):
            out += t[b[k]]
        for (i, j), t in self.pairs.items():
            out += t[b[i], b[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 100, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1, least: float = 2.0, pair_least: float = 0.05, ridge: float = 1.0) -> Additive:
    """The model of labels y (0 or 1) by the columns of x."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
    model = Additive(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], {})
    if not 0 < y.sum() < n:
        return model
    b, margin = model.bins(x), np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.singles):
            g, h = slopes()
            step = rate * _leaves(np.bincount(b[j], g, len(t)), np.bincount(b[j], h, len(t)), 2, least, ridge)
            t += step
            margin += step[b[j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.singles[i]), len(model.singles[j]))
        cell = b[i] * shape[1] + b[j]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    gains = {(i, j): _cross(*sums(i, j)[:2], pair_least, ridge)[0] for i, j in combinations(range(k), 2)}
    chosen = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:pairs] if gains[p] > 0]
    model.pairs = {(i, j): np.zeros((len(model.singles[i]), len(model.singles[j]))) for i, j in chosen}
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            g, h, cell = sums(i, j)
            step = rate * _cross(g, h, pair_least, ridge)[1]
            t += step
            margin += step.reshape(-1)[cell]
    return model


def feature_rows(docs: DataFrame, *others: str) -> DataFrame:
    """`others` and the array `x` of features, of docs' text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], x], [*others, "x"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], "x array<double>"])
    return docs.select(*others, "text").mapInArrow(run, schema)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """The model of the labels (doc_id, quality) outside of the held-out fold."""
    rows = labels.select("doc_id", "quality").filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id"), 5) != 0)
    rows = rows.select(F.col("doc_id").alias("id"), (F.col("quality") > 0).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    # at most `sample` rows of two numbers; copies of an id could make more of them
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("id")).select("id", "y", F.xxhash64("id", "text", "y").alias("h"), "text")
    # features come first, where the texts are: only numbers meet in the task that takes the least hashes
    found = feature_rows(texts, "h", "id", "y").orderBy("h", "id", "y", "x").limit(sample).collect()
    x = np.array([r["x"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["y"] for r in found], dtype=float))


def scored(docs: DataFrame, model: Additive, cut: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of docs' doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
