"""Where evidence was lost: stage ladders, budgets, replays of traces, and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(run: DataFrame, floors: DataFrame) -> DataFrame:
    """bucket and verdict of run (bucket, n, sufficiency) against floors (bucket, floor_n, floor)."""
    f = floors.withColumnRenamed("bucket", "__b")
    rows = run.join(f, F.col("bucket") == F.col("__b"), "full_outer")
    verdict = F.when(F.col("bucket").isNull(), "missing").when(F.col("__b").isNull(), "new").when(F.col("n") < F.col("floor_n"), "incomparable").when(F.col("sufficiency") < F.col("floor"), "violation").otherwise("pass")
    return rows.select(F.coalesce("__b", "bucket").alias("bucket"), verdict.alias("verdict"))


def first_loss(stages: dict[str, Column]) -> Column:
    """The name of the first stage, in order, whose survival flag is false; `survived` where none is."""
    out = None
    for name, survives in stages.items():
        out = F.when(~survives, name) if out is None else out.when(~survives, name)
    return out.otherwise("survived")


def budget(losses: DataFrame) -> DataFrame:
    """stage, failures and their share of all failures, of losses (item, stage)."""
    failed = losses.filter("stage <> 'survived'").groupBy("stage").agg(F.count(F.lit(1)).alias("failures"))
    total = losses.agg(F.count_if(F.col("stage") != "survived").alias("total"))
    return failed.crossJoin(F.broadcast(total)).select("stage", "failures", F.round(F.col("failures") / F.col("total"), 6).alias("share"))


def stage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each query and stage of two traces (query_id, stage, rank, id): entered, left, changed, reordered."""
    def lists(df: DataFrame, name: str) -> DataFrame:
        ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
        return df.groupBy("query_id", "stage").agg(ids.alias(name))

    rows = lists(before, "a").join(lists(after, "b"), ["query_id", "stage"], "full_outer")
    none = F.array().cast("array<bigint>")
    rows = rows.select("query_id", "stage", F.coalesce(F.col("a").cast("array<bigint>"), none).alias("a"), F.coalesce(F.col("b").cast("array<bigint>"), none).alias("b"))
    entered, left = F.size(F.array_except("b", "a")), F.size(F.array_except("a", "b"))
    return rows.select("query_id", "stage", entered.alias("entered"), left.alias("left_out"), (F.col("a") != F.col("b")).alias("changed"), ((F.col("a") != F.col("b")) & (entered == 0) & (left == 0)).alias("reordered"))


def first_divergence(diffs: DataFrame, order: list[str]) -> DataFrame:
    """query_id and the first stage that changed, null where none did."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    return diffs.groupBy("query_id").agg(F.min_by("stage", F.when(F.col("changed"), place)).alias("s"), F.count_if(F.col("changed")).alias("changed_stages")).select("query_id", F.when(F.col("changed_stages") > 0, F.col("s")).alias("first_stage"), "changed_stages")
