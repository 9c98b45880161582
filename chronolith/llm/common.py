"""Helpers that the training-data operators share.

Words are maximal runs of characters other than space and U+0009 to U+000D,
everywhere in this subpackage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import ARROW_BYTES, BATCH_BYTES, dropped, keep_batches_small, scratch, written

__all__ = ["ARROW_BYTES", "BATCH_BYTES", "BROADCAST_KEYS", "GAP", "WORD", "by_small_key", "dropped", "free_prefix", "keep_batches_small", "scratch", "table", "with_columns", "word_count", "words", "written"]

#: Java regular expressions for what separates words and what makes them.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: The largest number of keys of 8 bytes that an operator broadcasts after counting them.
BROADCAST_KEYS = 1_000_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def by_small_key(key: Column) -> Column:
    """The key as an expression whose partitioning Spark does not take for the key's own.

    A side that was aggregated by the key is then exchanged again before a join, and adaptive
    execution can split a hot partition of the other side.
    """
    return F.concat(key.cast("string"), F.lit(""))


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with these columns; an input column of such a name, in either case, gives way."""
    names = {n.lower() for n in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in new.items()])


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has, for columns of an operator's own."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p
