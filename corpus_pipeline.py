"""From raw documents to training pieces, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents. Stages that hand whole
texts to Python bound the session's Arrow batches, unless it has a bound: executors never give back what
the largest batches took, in any stage.

Defined results: an empty table passes through all stages; null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import keep_batches_small, scratch, table
from chronolith.llm.mixing import mixed_documents
from chronolith.llm.near_dedup import without_near_duplicates
from chronolith.llm.pieces import encoded
from chronolith.llm.quality_rules import quality_rules
from chronolith.llm.secrets import redact_secrets


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a rule themselves nor come from a host that fails."""
    return quality_rules(docs).filter("kept").select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return without_near_duplicates(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars counted anew."""
    keep_batches_small(spark)
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of pieces for each document of the mix."""
    keep_batches_small(spark)
    return encoded(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Sampling from a lattice has no SQL; tests/llm holds the whole run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
