"""Bitemporal predicates and version building.

A row has a valid interval [valid_from, valid_to) and a belief interval [system_from, system_to);
null ends are open. Belief is append-only: a correction closes system_to and adds a row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered


def in_interval(at: Column, start: Column, end: Column) -> Column:
    return (start <= at) & (end.isNull() | (end > at))


def valid_at(at: Column) -> Column:
    return in_interval(at, F.col("valid_from"), F.col("valid_to"))


def believed_at(at: Column | None = None) -> Column:
    """Believed at an instant, or now."""
    return F.col("system_to").isNull() if at is None else in_interval(at, F.col("system_from"), F.col("system_to"))


def as_of(
    rows: DataFrame,
    valid: Column,
    system: Column | None = None,
    part: str | None = None,
    exclude_parts: Iterable[str] = (),
    sources: Iterable[str] | None = None,
    max_authority: int | None = None,
    temporal: bool = True,
) -> DataFrame:
    """Rows in force at `valid` as believed at `system`, under applicability, source and authority
    predicates. All are range or membership tests on columns, so they reach the scan.

    temporal=False leaves the valid-time predicate out, for ablations.
    """
    rows = rows.filter(believed_at(system))
    if temporal:
        rows = rows.filter(valid_at(valid))
    if part is not None:
        rows = rows.filter(F.col("part") == part)
    if excluded := sorted(exclude_parts):
        rows = rows.filter(~F.col("part").isin(excluded))
    if sources is not None:
        rows = rows.filter(F.col("source").isin(sorted(sources)))
    if max_authority is not None:
        rows = rows.filter(F.col("authority") <= max_authority)
    return rows


def intervals(rows: DataFrame, by: list[str], at: str, *tie: str) -> DataFrame:
    """rows with valid_from and valid_to: each row holds until the next of its key."""
    order = Window.partitionBy(*by).orderBy(at, *tie)
    return rows.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(order)})


def scd2(snapshots: DataFrame, floor: Column | None = None) -> DataFrame:
    """Versions from snapshots (section, date, text): unchanged text stays open, changed text closes
    and opens, a section missing from the next snapshot closes there and opens anew on return.

    What the first snapshot shows is valid from `floor` on, if that is given.
    """
    dates = snapshots.select("date").distinct()
    ranked = numbered(dates, "n", "date").select("date", (F.col("n") + 1).cast("int").alias("ord"))
    rows = snapshots.join(ranked, "date")
    order = Window.partitionBy("section").orderBy("ord")
    changed = F.lag("text").over(order).isNull() | (F.lag("ord").over(order) < F.col("ord") - 1) | ~F.lag("text").over(order).eqNullSafe(F.col("text"))
    rows = rows.withColumn("new", changed.cast("int"))
    rows = rows.withColumn("version", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("section", "version").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.min("date").alias("valid_from"), F.first("text").alias("text"))
    following = ranked.select((F.col("ord") - 1).alias("last"), F.col("date").alias("valid_to"))
    out = runs.join(following, "last", "left")
    if floor is not None:
        out = out.withColumn("valid_from", F.when(F.col("first") == 1, floor).otherwise(F.col("valid_from")))
    return out.select("section", "version", "text", "valid_from", "valid_to")


def close_valid(rows: DataFrame, closings: DataFrame) -> DataFrame:
    """Ends the open, believed rows of a section (and source) at closings.closed_at, never to zero width."""
    c = closings.select(F.col("section_id").alias("__s"), F.col("source").alias("__o"), F.col("closed_at").alias("__at"))
    hit = rows.join(c, (F.col("section_id") == F.col("__s")) & (F.col("source") == F.col("__o")), "left")
    ends = F.col("valid_to").isNull() & F.col("system_to").isNull() & (F.col("valid_from") < F.col("__at"))
    return hit.withColumn("valid_to", F.when(ends, F.col("__at")).otherwise(F.col("valid_to"))).drop("__s", "__o", "__at")


def retract(rows: DataFrame, retractions: DataFrame) -> DataFrame:
    """Ends belief in version_ids of retractions (version_id, at); history stays."""
    r = retractions.select(F.col("version_id").alias("__v"), F.col("at").alias("__at"))
    hit = rows.join(r, F.col("version_id") == F.col("__v"), "left")
    return hit.withColumn("system_to", F.coalesce("system_to", "__at")).drop("__v", "__at")


def stamp(rows: DataFrame, now: Column) -> DataFrame:
    """What appending adds to rows: belief from now on, a hash of the text, doc_id by default."""
    return rows.withColumns({
        "system_from": now, "system_to": F.lit(None).cast("timestamp"), "content_hash": content_hash(F.col("text")),
        "doc_id": F.coalesce("doc_id", "section_id"), "version_id": F.concat_ws("@", "chunk_id", F.col("valid_from").cast("string")),
    })


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def hash_diff(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """For each document of incoming (doc, chunk, hash): unchanged, changed or new, against current.

    A document is unchanged only if its map of chunk to hash is the same; context or heading count
    for nothing.
    """
    def one(rows: DataFrame, mark: str) -> DataFrame:
        return rows.select(F.col("doc"), F.col("chunk"), F.col("hash").alias(mark))

    both = one(current, "was").join(one(incoming, "now"), ["doc", "chunk"], "full_outer")
    known = current.select(F.col("doc").alias("__d")).distinct()
    out = both.groupBy("doc").agg(
        F.count_if(F.col("now").isNotNull()).alias("chunks"), F.count_if(F.col("was").isNull() & F.col("now").isNotNull()).alias("added"),
        F.count_if(F.col("was").isNotNull() & F.col("now").isNull()).alias("removed"), F.count_if(F.col("was") != F.col("now")).alias("altered"),
    )
    out = out.filter("chunks > 0").join(known, F.col("doc") == F.col("__d"), "left")
    status = F.when(F.col("__d").isNull(), "new").when(F.col("added") + F.col("removed") + F.col("altered") > 0, "changed").otherwise("unchanged")
    return out.select("doc", "chunks", "added", "removed", "altered", status.alias("status"))


def excluded_parts(facets: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Parts that declare a facet of scope with other values only; undeclared facets never exclude."""
    wanted = F.lit(False)
    for facet, value in sorted(scope.items()):
        wanted = wanted | ((F.col("facet") == facet) & ~F.array_contains("allowed", value))
    return facets.filter(wanted).select("part").distinct()


def check_scope(facets: dict[str, set[str]], scope: dict[str, str]) -> dict[str, str]:
    """scope, if every facet and value of it is known."""
    for facet, value in scope.items():
        if facet not in facets:
            raise ValueError(f"unknown facet {facet!r}; known: {sorted(facets)}")
        if value not in facets[facet]:
            raise ValueError(f"unknown value {value!r} of {facet!r}; known: {sorted(facets[facet])}")
    return dict(scope)


# Violations of what must always hold; each gives no row for a sound store.


def overlapping(rows: DataFrame) -> DataFrame:
    """Believed versions of a chunk whose valid intervals overlap: compared with the furthest end so far."""
    order = Window.partitionBy("chunk_id").orderBy("valid_from", "version_id").rowsBetween(Window.unboundedPreceding, -1)
    far = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    end = F.coalesce(F.col("valid_to").cast("timestamp_ntz"), far)
    return rows.filter(believed_at()).withColumn("__before", F.max(end).over(order)).filter(F.col("__before") > F.col("valid_from")).drop("__before")


def zero_width(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("valid_to") <= F.col("valid_from")) | (F.col("system_to") < F.col("system_from")))


def several_in_force(rows: DataFrame, at: Column) -> DataFrame:
    """Chunks with more than one believed version in force at an instant."""
    return rows.filter(believed_at() & valid_at(at)).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def several_open(rows: DataFrame) -> DataFrame:
    return rows.filter(believed_at() & F.col("valid_to").isNull()).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
