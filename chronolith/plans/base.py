"""The driver's tables in the shape of the engine's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import content_hash, intervals
from ..registry import query, table

__all__ = ["AT", "NOW", "VERSIONS_SQL", "chunks", "day", "instant", "query", "table", "versions"]

#: The valid instant and the belief instant that the queries ask about.
AT, NOW = "2024-01-16 12:00:00", "2024-01-20 00:00:00"


def instant(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versioned chunks: a chunk is a user's type of event, each event a version of it.

    Every 17th event is believed for two days only.
    """
    e = table(spark, sf_dir, "events")
    chunk = F.concat_ws("#", F.col("user_id").cast("string"), "event_type")
    e = e.select(
        F.col("event_id").alias("id"), chunk.alias("chunk_id"), F.col("user_id").cast("string").alias("section_id"), F.col("event_type").alias("part"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"),
        (1 + F.col("user_id") % 5).cast("int").alias("authority"), F.round("value", 2).cast("string").alias("text"), "ts", F.concat_ws("@", chunk, F.col("event_id").cast("string")).alias("version_id"),
    )
    v = intervals(e, ["chunk_id"], "ts", "id")
    gone = F.when(F.col("id") % 17 == 0, F.col("ts") + F.expr("interval 2 days"))
    return v.withColumns({"system_from": F.col("ts"), "system_to": gone, "content_hash": content_hash(F.col("text"))}).drop("ts")


VERSIONS_SQL = """
v AS (SELECT event_id AS id, user_id::VARCHAR || '#' || event_type AS chunk_id, user_id::VARCHAR AS section_id, event_type AS part, 's' || (user_id % 3)::VARCHAR AS source,
  (1 + user_id % 5)::INTEGER AS authority, round(value, 2)::VARCHAR AS text, user_id::VARCHAR || '#' || event_type || '@' || event_id::VARCHAR AS version_id,
  ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to,
  ts AS system_from, CASE WHEN event_id % 17 = 0 THEN ts + INTERVAL 2 DAY END AS system_to FROM events)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks of one version: section is the source, authority its number's remainder."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section_id"), "source", "lang", "text", (1 + F.coalesce(number, F.lit(0)) % 5).cast("int").alias("authority"))
