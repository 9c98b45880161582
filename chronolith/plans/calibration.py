"""Calibration, abstention and verdicts (K and X7 to X12 keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from .base import query, table

_I = """i AS (SELECT doc_id AS item, source AS section, round(((doc_id * 37) % 101)::DOUBLE / 101 * 0.6::DOUBLE + CASE WHEN l.quality = 1 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END * ((doc_id % 4) > 0)::INTEGER, 2) AS confidence, l.quality = 1 AS correct FROM documents JOIN labels l USING (doc_id))"""


def items(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    base = (F.col("doc_id") * 37 % 101).cast("double") / 101 * 0.6 + F.when(F.col("quality") == 1, 0.4).otherwise(0.0) * F.when(F.col("doc_id") % 4 > 0, 1).otherwise(0)
    return rows.select(F.col("doc_id").alias("item"), F.col("source").alias("section"), F.round(base, 2).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query("k1_examples", f"WITH {_I} SELECT section, count(*) AS examples, count(*) FILTER (correct) AS sufficient, round(avg(confidence), 9) AS mean_confidence FROM i WHERE section <> 'src0' GROUP BY section")
def k1(spark, sf):
    rows = items(spark, sf).filter("section <> 'src0'")
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("correct")).alias("sufficient"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


_Z = "1.959963985::DOUBLE"
_REL = f"""b AS (SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, avg(confidence) AS mc, avg(correct::INTEGER) AS acc FROM i GROUP BY 1),
rel AS (SELECT s.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(mc, 9) AS mean_confidence, round(acc, 9) AS accuracy,
 CASE WHEN n IS NULL THEN 0 ELSE round(greatest(0, (acc + {_Z}*{_Z}/(2*n) - {_Z}*sqrt(greatest(acc*(1-acc), 0)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n)), 6) END AS lo,
 CASE WHEN n IS NULL THEN 1 ELSE round(least(1, (acc + {_Z}*{_Z}/(2*n) + {_Z}*sqrt(greatest(acc*(1-acc), 0)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n)), 6) END AS hi
 FROM range(0, 10) AS s(bin) LEFT JOIN b ON s.bin = b.bin)"""


@query("k4_reliability", f"WITH {_I}, {_REL} SELECT bin, n, mean_confidence, accuracy, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM rel")
def k4(spark, sf):
    return C.reliability(items(spark, sf))


@query("k4_ece", f"WITH {_I}, {_REL} SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 9) AS ece FROM rel")
def k4_ece(spark, sf):
    return C.calibration_error(C.reliability(items(spark, sf)))


@query("k4_brier", f"WITH {_I} SELECT round(avg(power(confidence - correct::INTEGER, 2)), 9) AS brier FROM i")
def k4_brier(spark, sf):
    return C.brier(items(spark, sf))


_RC = "c AS (SELECT confidence, count(*) AS n, count(*) FILTER (NOT correct) AS w FROM i GROUP BY confidence), rc AS (SELECT confidence, round(sum(n) OVER d / sum(n) OVER (), 9) AS coverage, round(sum(w) OVER d / sum(n) OVER d, 9) AS risk FROM c WINDOW d AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))"


@query("k5_risk_coverage", f"WITH {_I}, {_RC} SELECT * FROM rc")
def k5(spark, sf):
    return C.risk_coverage(items(spark, sf))


@query("k6_aurc", f"WITH {_I}, {_RC}, a AS (SELECT (coverage - coalesce(lag(coverage) OVER o, 0)) * (risk + coalesce(lag(risk) OVER o, risk)) / 2 AS area FROM rc WINDOW o AS (ORDER BY coverage)) SELECT round(sum(area), 9) AS aurc FROM a")
def k6(spark, sf):
    return C.aurc(C.risk_coverage(items(spark, sf)))


@query("k7_operating_point", f"WITH {_I}, {_RC} SELECT confidence, coverage, risk FROM rc WHERE risk <= 0.02 ORDER BY coverage DESC, risk LIMIT 1")
def k7(spark, sf):
    return C.operating_point(C.risk_coverage(items(spark, sf)), 0.02)


@query("k8_threshold_transfer", f"WITH {_I}, {_RC} SELECT confidence, coverage, risk FROM rc WHERE confidence >= 0.555 ORDER BY confidence LIMIT 1")
def k8(spark, sf):
    return C.point_at(C.risk_coverage(items(spark, sf)), 0.555)


@query("k3_isotonic")
def k3(spark, sf):
    rows = items(spark, sf)
    return rows.select("item", "confidence", F.round(C.apply_isotonic(F.col("confidence"), C.fit_isotonic(rows)), 9).alias("calibrated"))


def _featured(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    return rows.select("doc_id", (F.col("quality") == 1).cast("int").alias("y"), F.log1p(n).alias("size"), (F.regexp_count("text", F.lit(r"[A-Z]")) / n).alias("upper"), (F.regexp_count("text", F.lit(r"[|#*$%&!]")) / n).alias("marks"), F.lit(1.0).alias("constant"))


@query("k2_logistic")
def k2(spark, sf):
    rows = _featured(spark, sf)
    model = C.fit_logistic(rows, ["size", "upper", "marks", "constant"], "y")
    return rows.select("doc_id", "y", F.round(C.apply_logistic(model), 6).alias("p"))


@query("k9_policies")
def k9(spark, sf):
    rows = _featured(spark, sf).withColumn("correct", F.col("y") == 1)
    learned = C.apply_logistic(C.fit_logistic(rows, ["size", "upper", "marks"], "y"))
    base = rows.withColumn("confidence", F.round(learned, 3))
    steps = C.fit_isotonic(base)
    arms = {"always": rows.withColumn("confidence", F.lit(1.0)), "size": rows.withColumn("confidence", F.round("size", 2)), "learned": base, "isotonic": base.withColumn("confidence", F.round(C.apply_isotonic(F.col("confidence"), steps), 6))}
    out = None
    for name, arm in arms.items():
        row = C.aurc(C.risk_coverage(arm.select("confidence", "correct"))).withColumn("arm", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_LOGITS = "l AS (SELECT vec_id AS id, label % 3 AS gold, [embedding[1]::DOUBLE * 8, embedding[2]::DOUBLE * 8, embedding[3]::DOUBLE * 8] AS x FROM embeddings)"


def _logits(spark, sf):
    x = F.array(*[F.get("embedding", i).cast("double") * 8 for i in range(3)])
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("gold"), x.alias("x"))


@query(
    "x7_verdicts",
    f"WITH {_LOGITS}, s AS (SELECT id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l), p AS (SELECT id, e[1] / list_sum(e) AS entail, e[3] / list_sum(e) AS contra FROM s) SELECT id, CASE WHEN contra >= 0.5 THEN 'contradicted' WHEN entail >= 0.7 THEN 'supported' ELSE 'unsupported' END AS verdict FROM p",
)
def x7(spark, sf):
    from ..operators.verification import verdict

    p = _logits(spark, sf).withColumn("p", C.softmax(F.col("x")))
    return p.select("id", verdict(F.get("p", 0), F.get("p", 2)).alias("verdict"))


@query("x8_softmax", f"WITH {_LOGITS}, s AS (SELECT id, list_transform(x, lambda v: exp((v - list_max(x)) / 2::DOUBLE)) AS e FROM l) SELECT id, round(e[1] / list_sum(e), 9) AS p0, round(e[2] / list_sum(e), 9) AS p1, round(e[3] / list_sum(e), 9) AS p2 FROM s")
def x8(spark, sf):
    p = _logits(spark, sf).withColumn("p", C.softmax(F.col("x"), 2.0))
    return p.select("id", *[F.round(F.get("p", i), 9).alias(f"p{i}") for i in range(3)])


@query("x8_temperature")
def x8_fit(spark, sf):
    return spark.createDataFrame([(round(C.fit_temperature(_logits(spark, sf), "x", "gold"), 5),)], "temperature double")


_HEAD = "h AS (SELECT conv_id, list(length(text)::DOUBLE ORDER BY turn) AS s FROM conversations GROUP BY conv_id)"


@query(
    "x11_signals",
    f"WITH {_HEAD}, o AS (SELECT conv_id, list_reverse_sort(s) AS s FROM h) SELECT conv_id, s[1] AS top, coalesce(s[1] - s[2], s[1]) AS margin, round(list_sum(s) / len(s), 6) AS mean, len(s)::INTEGER AS n FROM o",
)
def x11(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.length("text").cast("double")), asc=False).alias("s"))
    first = F.get("s", 0)
    return c.select("conv_id", first.alias("top"), F.coalesce(first - F.get("s", 1), first).alias("margin"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 6).alias("mean"), F.size("s").alias("n"))


@query("x12_entropy", f"WITH {_HEAD} SELECT conv_id, CASE WHEN len(s) < 2 THEN 0 ELSE round(-list_sum(list_transform(s, lambda x: x / list_sum(s) * ln(x / list_sum(s)))) / ln(len(s)), 9) END AS entropy FROM h")
def x12(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("double")).alias("s"))
    return c.select("conv_id", F.round(C.entropy(F.col("s")), 9).alias("entropy"))


@query("e22_entailment_confusion", f"WITH {_LOGITS}, p AS (SELECT gold, list_position(x, list_max(x)) - 1 AS predicted FROM l) SELECT gold, predicted::INTEGER AS predicted, count(*) AS n FROM p GROUP BY ALL")
def e22_confusion(spark, sf):
    p = _logits(spark, sf).select("gold", (F.array_position("x", F.array_max("x")) - 1).cast("int").alias("predicted"))
    return p.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("e23_signal_agreement", f"WITH {_I} SELECT count(*) FILTER ((confidence >= 0.5) = correct) AS agree, count(*) AS n, round(avg(((confidence >= 0.5) = correct)::INTEGER), 9) AS accuracy FROM i")
def e23(spark, sf):
    same = (F.col("confidence") >= 0.5) == F.col("correct")
    return items(spark, sf).agg(F.count_if(same).alias("agree"), F.count(F.lit(1)).alias("n"), F.round(F.avg(same.cast("int")), 9).alias("accuracy"))
