"""Calibration, abstention and risk-coverage analysis.

Curves are made from counts by confidence, never from sorted items: the number of distinct
confidences (rounded by callers) bounds what a window sees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered, summed_before
from .statistics import wilson


def reliability(items: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence, accuracy and its interval of items (confidence, correct); empty bins stay."""
    spine = items.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    rows = items.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    rows = spine.join(rows, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lo, hi = wilson(F.coalesce(F.col("accuracy") * F.col("n"), F.lit(0.0)), F.col("n"))
    return rows.select("bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    return table.agg(F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n"), 9).alias("ece"))


def brier(items: DataFrame) -> DataFrame:
    return items.agg(F.round(F.avg((F.col("confidence") - F.col("correct").cast("double")) ** 2), 9).alias("brier"))


def risk_coverage(items: DataFrame) -> DataFrame:
    """confidence, coverage and risk: one point for each distinct confidence, from the highest down."""
    counts = items.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    down = F.col("confidence").desc()
    rows = summed_before(summed_before(counts, "__n", F.col("n"), down), "__wrong", F.col("wrong"), down)
    n, wrong = F.col("__n") + F.col("n"), F.col("__wrong") + F.col("wrong")
    whole = rows.agg(F.sum("n").alias("__every"))
    return rows.crossJoin(F.broadcast(whole)).select("confidence", F.round(n / F.col("__every"), 9).alias("coverage"), F.round(wrong / n, 9).alias("risk"))  # one row


def aurc(points: DataFrame) -> DataFrame:
    """Area under risk over coverage by trapezoids; the curve is flat before its first point."""
    rows = numbered(points.select("coverage", "risk"), "i", "coverage")
    before = rows.select((F.col("i") + 1).alias("i"), F.col("coverage").alias("c"), F.col("risk").alias("r"))
    rows = rows.join(before, "i", "left")
    area = (F.col("coverage") - F.coalesce("c", F.lit(0.0))) * (F.col("risk") + F.coalesce("r", "risk")) / 2
    return rows.select(area.alias("area")).agg(F.round(F.sum("area"), 9).alias("aurc"))


def operating_point(points: DataFrame, most_risk: float) -> DataFrame:
    """The point of largest coverage within the risk budget, ties to the lower risk; a row of nulls if there is none."""
    best = F.max_by(F.struct("confidence", "coverage", "risk"), F.struct(F.col("coverage"), -F.col("risk")))
    return points.filter(F.col("risk") <= most_risk).agg(best.alias("p")).select("p.confidence", "p.coverage", "p.risk")


def point_at(points: DataFrame, threshold: float) -> DataFrame:
    """Where a threshold chosen elsewhere lands: the lowest confidence not below it."""
    return points.filter(F.col("confidence") >= threshold).agg(F.min_by(F.struct("confidence", "coverage", "risk"), "confidence").alias("p")).select("p.confidence", "p.coverage", "p.risk")


def _pool(blocks: list[list[float]], block: list[float]) -> None:
    """Adds a block (least score, n, hits) behind the others and pools while the rate does not rise."""
    blocks.append(block)
    while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
        _, n, h = blocks.pop()
        blocks[-1][1] += n
        blocks[-1][2] += h


def fit_isotonic(items: DataFrame, clip: bool = True) -> list[tuple[float, float]]:
    """(score, value) steps of a monotone fit by pooling adjacent violators.

    Items are counted by score, and every range of scores pools its own violators first; pooling what
    is left of all ranges gives the same steps. The driver gets those, which are the model.
    """
    counts = items.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("double")).alias("hits"))

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[list[float]] = []
        for frame in frames:
            for row in frame[["confidence", "n", "hits"]].itertuples(index=False):
                _pool(own, list(row))
        yield pd.DataFrame(own, columns=["confidence", "n", "hits"])

    rows = counts.repartitionByRange("confidence").sortWithinPartitions("confidence").mapInPandas(pooled, "confidence double, n double, hits double")
    blocks: list[list[float]] = []
    for r in sorted(rows.collect()):
        _pool(blocks, list(r))
    total = sum(b[1] for b in blocks)
    edge = 1 / (2 * total) if clip and total else 0.0
    return [(score, min(max(h / n, edge), 1 - edge)) for score, n, h in blocks]


def apply_isotonic(confidence: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """The value of the last step whose score is not above the confidence, the first below all."""
    if not steps:
        return confidence
    spine = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(v)).alias("v")) for s, v in steps])
    below = F.filter(spine, lambda x: x["s"] <= confidence)
    return F.when(F.size(below) > 0, F.element_at(below, -1)["v"]).otherwise(F.lit(float(steps[0][1])))


def fit_logistic(items: DataFrame, features: list[str], label: str, ridge: float = 1.0, rounds: int = 25) -> dict:
    """Ridge logistic regression by reweighted least squares on standardised features.

    Each round is one aggregate: the driver gets a matrix of features by features and solves it.
    Constant features get scale 1; the intercept is not penalised.
    """
    k = len(features)
    y = F.col(label).cast("double")
    stats = items.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{m}{i}") for i, c in enumerate(features) for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"]:
        return {"features": features, "mean": [0.0] * k, "scale": [1.0] * k, "weights": [0.0] * (k + 1)}
    mean, scale = [stats[f"m{i}"] for i in range(k)], [stats[f"s{i}"] if stats[f"s{i}"] > 1e-12 else 1.0 for i in range(k)]
    x = [F.lit(1.0), *[(F.col(c) - mean[i]) / scale[i] for i, c in enumerate(features)]]
    w = np.zeros(k + 1)
    for _ in range(rounds):
        margin = sum((a * float(b) for a, b in zip(x, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-margin))
        h = F.greatest(p * (1 - p), F.lit(1e-9))
        row = items.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (y - p).alias("g"), h.alias("h"))
        sums = row.agg(*[F.sum(F.col("g") * F.col(f"x{i}")).alias(f"g{i}") for i in range(k + 1)], *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        penalty = np.diag([0.0, *[ridge] * k])
        hess = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + penalty
        step = np.linalg.solve(hess, np.array([sums[f"g{i}"] for i in range(k + 1)]) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return {"features": features, "mean": mean, "scale": scale, "weights": w.tolist()}


def apply_logistic(model: dict) -> Column:
    terms = [F.lit(float(model["weights"][0]))]
    terms += [(F.col(c) - m) / s * float(w) for c, m, s, w in zip(model["features"], model["mean"], model["scale"], model["weights"][1:], strict=True)]
    return 1 / (1 + F.exp(-sum(terms[1:], terms[0])))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def fit_temperature(items: DataFrame, logits: str, label: str, lo: float = 0.05, hi: float = 10.0, rounds: int = 60, probes: int = 8) -> float:
    """The temperature of least log loss.

    Each pass over the items weighs several temperatures at once and keeps the interval about the
    best, so that few passes do what many of a ternary search would.
    """
    width = hi - lo
    while rounds > 0 and width > 1e-6:
        at = [lo + (hi - lo) * i / (probes + 1) for i in range(1, probes + 1)]
        losses = items.agg(*[F.avg(-F.log(F.greatest(F.get(softmax(F.col(logits), t), F.col(label)), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(at)]).first()
        best = min(range(probes), key=lambda i: losses[f"t{i}"])
        lo, hi = (at[best - 1] if best else lo), (at[best + 1] if best + 1 < probes else hi)
        width, rounds = hi - lo, rounds - 3
    return (lo + hi) / 2


def entropy(scores: Column) -> Column:
    """Normalised entropy of the shares of an array of scores; 0 for fewer than two."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(F.filter(scores, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x / total * F.log(x / total))
    return F.when((F.size(scores) < 2) | (total <= 0), 0.0).otherwise(h / F.log(F.size(scores)))
