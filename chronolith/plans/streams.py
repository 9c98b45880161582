"""Streams run over the driver's tables as far as they are available (additions; V7, B14, W5 in streaming form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import scratch
from ..streaming import state
from .base import query
from .temporal import _SCD2_SQL


def _run(df, mode: str):
    """The rows of a streaming query that takes what there is and ends.

    Batches are written to the shared folder by their number, so the driver holds none of them; of a
    complete result the last batch has all rows.
    """
    path, last = scratch(df.sparkSession, "stream"), []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    df.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch(df.sparkSession, "stream-log")).start().awaitTermination()
    if not last:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(*[f"{path}/batch={n}" for n in (last[-1:] if mode == "complete" else last)])


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)


@query(
    "stream_metric_windows",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(max(value), 6) AS peak FROM events GROUP BY 1, 2",
)
def metric_windows(spark, sf):
    rows = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _run(state.metric_windows(rows, "ts", "event_type", "value", "1 day", "100 days"), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("peak", 6).alias("peak"))


@query("stream_token_bucket")
def token_bucket(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return _run(state.token_bucket(rows, 1 / 20000, 3), "update")


@query("stream_versions", f"WITH {_SCD2_SQL} SELECT section::VARCHAR AS section, text, valid_from::VARCHAR AS valid_from, o.date::VARCHAR AS valid_to FROM g LEFT JOIN o ON o.ord = last + 1")
def stream_versions(spark, sf):
    path, last = scratch(spark, "versions"), []
    sink = state.versions_sink(path)

    def run(batch, number):
        days = batch.groupBy(F.col("user_id").cast("string").alias("section"), F.to_date("ts").alias("date")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("text"))
        sink(days, number)
        last.append(number)

    _events(spark, sf).writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", scratch(spark, "versions-log")).start().awaitTermination()
    kept = state.versions_kept(spark, path, max(last))
    return kept.select("section", "text", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))
