from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronolith.operators import calibration as C
from chronolith.operators import statistics as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson_at_the_edges(spark):
    lo, hi = S.wilson(F.lit(0), F.lit(0))
    assert (one(spark, lo), one(spark, hi)) == (0.0, 1.0)
    lo, hi = S.wilson(F.lit(0), F.lit(10))
    assert one(spark, lo) == 0.0 and abs(one(spark, hi) - 0.27754) < 1e-4
    lo, hi = S.wilson(F.lit(10), F.lit(10))
    assert abs(one(spark, lo) - 0.72246) < 1e-4 and one(spark, hi) == 1.0


def test_mcnemar_is_exact(spark):
    for wins, losses in ((0, 0), (1, 0), (5, 5), (220, 0), (12, 3), (3, 12)):
        n, k = wins + losses, min(wins, losses)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert abs(one(spark, S.mcnemar(F.lit(wins), F.lit(losses))) - want) < 1e-9


def test_three_quantile_rules(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    assert S.nearest_rank(rows, "v", [0.5, 0.9]).first().asDict() == {"n": 5, "p50": 3.0, "p90": 10.0}
    assert S.index_quantile(rows, "v", [0.5, 0.99]).first().asDict() == {"n": 5, "q50": 3.0, "q99": 10.0}


def test_poisson_resampling_covers_the_seeded_interval(spark):
    rows = [(f"c{i}", 10 + i % 7, float((10 + i % 7) * (i % 3 > 0))) for i in range(60)]
    lo, hi = S.seeded_bootstrap([r[2] for r in rows], [r[1] for r in rows])
    got = S.resampled_ratio(spark.createDataFrame(rows, "cluster string, n int, ok double"), "ok", 1000).first()
    assert abs(got["lo"] - lo) < 0.04 and abs(got["hi"] - hi) < 0.04


def test_seeded_bootstrap_of_one_cluster_is_wilson():
    lo, hi = S.seeded_bootstrap([10.0], [10])
    assert abs(lo - 0.72246) < 1e-4 and hi == 1.0


def test_satisfaction(spark):
    rows = spark.createDataFrame([([["a", "b"], ["c"]], ["a"]), ([["a"]], ["a", "x"]), ([[]], [])], "s array<array<string>>, g array<string>")
    assert [r[0] for r in rows.select(S.satisfied(F.col("s"), F.col("g"))).collect()] == [False, True, True]


def test_isotonic_pools_violators(spark):
    rows = spark.createDataFrame([(0.1, False), (0.2, True), (0.3, False), (0.4, True), (0.4, True)], "confidence double, correct boolean")
    steps = C.fit_isotonic(rows)
    assert steps == [(0.1, 0.1), (0.2, 0.5), (0.4, 0.9)]
    assert one(spark, C.apply_isotonic(F.lit(0.35), steps)) == 0.5


def test_aurc_and_operating_point(spark):
    items = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True)], "confidence double, correct boolean")
    points = C.risk_coverage(items)
    assert [(r["coverage"], round(r["risk"], 6)) for r in points.orderBy("coverage").collect()] == [(0.25, 0.0), (0.5, 0.0), (0.75, 0.333333), (1.0, 0.25)]
    want = 0.25 * (0 + 1 / 3) / 2 + 0.25 * (1 / 3 + 0.25) / 2
    assert abs(C.aurc(points).first()["aurc"] - want) < 1e-8
    assert C.operating_point(points, 0.1).first()["coverage"] == 0.5
    assert C.operating_point(points, -1.0).first()["coverage"] is None


def test_logistic_separates_and_survives_constant_columns(spark):
    rows = spark.createDataFrame([(float(i), 1.0, int(i > 20)) for i in range(40)], "x double, c double, y int")
    model = C.fit_logistic(rows, ["x", "c"], "y")
    p = {r["x"]: r["p"] for r in rows.select("x", C.apply_logistic(model).alias("p")).collect()}
    assert p[0.0] < 0.05 and p[39.0] > 0.95 and abs(model["weights"][2]) < 1e-9


def test_temperature_recovers_a_known_one(spark):
    import random

    draw = random.Random(1)
    rows = []
    for _ in range(3000):
        z = [draw.gauss(0, 1) for _ in range(3)]
        w = [math.exp(v) for v in z]
        rows.append(([2 * v for v in z], draw.choices(range(3), w)[0]))
    t = C.fit_temperature(spark.createDataFrame(rows, "x array<double>, y int"), "x", "y")
    assert 1.7 < t < 2.4
