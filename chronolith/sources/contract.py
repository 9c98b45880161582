"""What every source of documents gives, and readers of hand-written benchmark files."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources weigh by authority: 1 is a statute, 5 an archive.
AUTHORITIES = range(1, 6)
DOCUMENT = "source string, doc_id string, title string, authority int, valid_from date, valid_to date, url string, references array<string>, meta map<string,string>, units array<struct<anchor:string,text:string,heading:string,kind:string,locator:string>>"


class Source(Protocol):
    """Anything that gives documents of the DOCUMENT schema."""

    name: str

    def documents(self, spark: SparkSession) -> DataFrame: ...


def violations(documents: DataFrame) -> DataFrame:
    """source, doc_id and problem: repeated anchors, unknown authority, no units, no date."""
    anchors = F.col("units.anchor")
    problems = F.array_compact(
        F.array(
            F.when(F.size(anchors) != F.size(F.array_distinct(anchors)), "repeated_anchor"),
            F.when(~F.col("authority").between(min(AUTHORITIES), max(AUTHORITIES)) | F.col("authority").isNull(), "unknown_authority"),
            F.when(F.coalesce(F.size("units"), F.lit(0)) <= 0, "no_units"),
            F.when(F.col("valid_from").isNull(), "undated"),
        )
    )
    return documents.select("source", "doc_id", F.explode(problems).alias("problem"))


def document_chunks(documents: DataFrame) -> DataFrame:
    """A row for each unit, addressed section#anchor@date."""
    rows = documents.select("source", "doc_id", "authority", "valid_from", "valid_to", F.posexplode("units").alias("pos", "u"))
    chunk = F.concat_ws("#", "doc_id", F.nullif(F.col("u.anchor"), F.lit("")))
    return rows.select("source", "doc_id", "authority", "pos", chunk.alias("chunk_id"), F.concat_ws("@", chunk, F.col("valid_from").cast("string")).alias("version_id"), "valid_from", "valid_to", "u.text", "u.heading", "u.kind", "u.locator")


def benchmark_items(spark: SparkSession, path: str) -> DataFrame:
    """id, query, as_of and evidence of a YAML file of items; a small, hand-written file."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    items = yaml.safe_load(text) or []
    return spark.createDataFrame([(str(i["id"]), i["query"], str(i["as_of"]) if i.get("as_of") else None, i["evidence"]) for i in items], "id string, query string, as_of string, evidence array<array<string>>")


def unresolved(items: DataFrame, versions: DataFrame) -> DataFrame:
    """id and reference of evidence that names no version in force at its item's date; must be empty."""
    asked = items.select("id", F.to_date("as_of").alias("at"), F.explode(F.flatten("evidence")).alias("chunk_id"))
    v = versions.select("chunk_id", "valid_from", "valid_to")
    hit = asked.join(v, "chunk_id").filter((F.col("valid_from") <= F.coalesce("at", F.current_date())) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.coalesce("at", F.current_date()))))
    return asked.join(hit.select("id", "chunk_id"), ["id", "chunk_id"], "left_anti").select("id", F.col("chunk_id").alias("reference"))
