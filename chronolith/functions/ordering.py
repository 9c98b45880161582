"""Positions and running sums over a whole table's order, without ever bringing it into one task.

Rows are dealt by ranges of the order and numbered or summed inside each range; the driver sees one
number a range.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Of monotonically_increasing_id, the bits that count inside a partition.
_INSIDE = (1 << 33) - 1


def _dealt(rows: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """rows by ranges, with __part and, in the order, __at inside of it; written, so that both stand."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(_INSIDE)}), "ordered")


def _with_starts(dealt: DataFrame, value: Column) -> DataFrame:
    sums = sorted((r["__part"], r["s"]) for r in dealt.groupBy("__part").agg(F.sum(value).alias("s")).collect())
    kind, plain = (pa.float64(), float) if any(isinstance(s, float) for _, s in sums) else (pa.int64(), int)
    starts = accumulate([plain(s or 0) for _, s in sums], initial=plain(0))
    # as an Arrow table: rows of Python objects would start Python workers on the executors
    known = pa.table([pa.array([p for p, _ in sums], pa.int32()), pa.array(list(starts)[: len(sums)], kind)], ["__p", "__start"])
    known = dealt.sparkSession.createDataFrame(known)
    return dealt.join(F.broadcast(known), F.col("__part") == F.col("__p")).drop("__p")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their 0-based place in the order; equal rows of the order get different places."""
    out = _with_starts(_dealt(rows, order), F.lit(1))
    return out.withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def summed_before(rows: DataFrame, name: str, value: Column, *order: Column | str) -> DataFrame:
    """rows with the sum of `value` over all earlier rows of the order."""
    dealt = _dealt(rows.withColumn("__value", value), order)
    earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("__inside", F.coalesce(F.sum("__value").over(earlier), F.lit(0)))
    return _with_starts(inside, F.col("__value")).withColumn(name, F.col("__start") + F.col("__inside")).drop("__part", "__at", "__start", "__value", "__inside")
