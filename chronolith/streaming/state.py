"""Streams: versions, metrics and admission as continuous queries.

The reference has no event-time engine; these are its stateful behaviours in Structured Streaming's
terms. Sinks write by batch id, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import scd2


def metric_windows(events: DataFrame, at: str, label: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts, sums and peaks by label and tumbling window; what is later than `late` is left out."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), label)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"), F.max(value).alias("peak"))
        .select(F.col("w.start").alias("start"), label, "n", "total", "peak")
    )


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """client, id and allowed of a stream of requests (client, id, at seconds).

    A client's state is two numbers and has no timeout, as a clock's timeout would keep a run over
    what is available from ending.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        allowed = []
        for at in rows["at"]:
            tokens = min(burst, tokens + (at - last) * rate) if last is not None else tokens
            last = float(at)
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((float(tokens), last))
        yield pd.DataFrame({"client": key[0], "id": rows["id"], "allowed": allowed})

    return requests.groupBy("client").applyInPandasWithState(step, "client string, id long, allowed boolean", "tokens double, last double", "update", GroupStateTimeout.NoTimeout)


def versions_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps versions of sections as files, of batches of snapshots
    (section, date, text) with any number of dates.

    A batch is taken together with the open versions as of the last date seen, and goes through the same
    steps as a batch build: changed text closes and opens, a section that is missing from a later date
    closes there. Closed versions are appended, one folder a batch; only the open ones are written anew.
    All is written under the batch's number, so a repeated batch reads the same state and writes the same
    rows. Dates that are not after the last one seen are left out; of equal section and date the greatest
    text counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "section string, text string, valid_from date"
        held = spark.read.schema(schema).parquet(f"{path}/open/{number - 1}") if number > 0 else spark.createDataFrame([], schema)
        last = spark.read.schema("seen date").parquet(f"{path}/dates/{number - 1}").first()["seen"] if number > 0 else None
        new = batch.groupBy("section", "date").agg(F.max("text").alias("text"))
        if last is not None:
            new = new.filter(F.col("date") > F.lit(last))
        every = held.select("section", F.lit(last).cast("date").alias("date"), "text").unionByName(new.select("section", "date", "text"))
        known = held.select(F.col("section").alias("__s"), F.col("valid_from").alias("__from"))
        rows = scd2(every).join(known, (F.col("section") == F.col("__s")) & (F.col("valid_from") == F.lit(last).cast("date")), "left")
        rows = rows.select("section", "text", F.coalesce("__from", "valid_from").alias("valid_from"), "valid_to")
        rows.filter("valid_to is not null").write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        rows.filter("valid_to is null").drop("valid_to").write.mode("overwrite").parquet(f"{path}/open/{number}")
        every.agg(F.coalesce(F.max("date"), F.lit(last).cast("date")).alias("seen")).write.mode("overwrite").parquet(f"{path}/dates/{number}")

    return run


def versions_kept(spark: SparkSession, path: str, number: int) -> DataFrame:
    """section, text, valid_from and valid_to as of the batch of this number."""
    schema = "section string, text string, valid_from date, valid_to date"
    closed = spark.read.schema(schema + ", batch int").parquet(f"{path}/closed").filter(F.col("batch") <= number).drop("batch")
    opened = spark.read.schema("section string, text string, valid_from date").parquet(f"{path}/open/{number}")
    return closed.unionByName(opened.withColumn("valid_to", F.lit(None).cast("date")))


def trace_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends traces, one folder a batch."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
