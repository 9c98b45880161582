"""Boundaries of intervals, version building, and the documented traps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from chronolith.operators import temporal as T


def at(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def test_intervals_are_half_open(spark):
    rows = spark.sql("select timestamp_ntz'2017-01-01 00:00:00' valid_from, timestamp_ntz'2020-08-10 00:00:00' valid_to, 'old' name union all select timestamp_ntz'2020-08-10 00:00:00', null, 'new'")
    found = lambda t: [r["name"] for r in rows.filter(T.valid_at(at(t))).collect()]
    assert found("2020-08-09 23:59:59") == ["old"]
    assert found("2020-08-10 00:00:00") == ["new"]
    assert found("2016-12-31 00:00:00") == []


def test_a_vanished_section_comes_back_as_a_new_version(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = [("a", days[0], "x"), ("a", days[1], "x"), ("a", days[3], "x"), ("b", days[0], "p"), ("b", days[1], "q"), ("b", days[2], "q"), ("b", days[3], "q")]
    out = T.scd2(spark.createDataFrame(rows, "section string, date date, text string"), F.to_date(F.lit("2017-01-01")))
    got = sorted((r["section"], r["text"], str(r["valid_from"]), str(r["valid_to"])) for r in out.collect())
    assert got == [("a", "x", "2017-01-01", "2024-01-03"), ("a", "x", "2024-01-04", "None"), ("b", "p", "2017-01-01", "2024-01-02"), ("b", "q", "2024-01-02", "None")]


def test_closing_never_makes_zero_width(spark):
    rows = spark.createDataFrame([("s", "o", date(2024, 1, 1), None, None), ("s", "o", date(2024, 1, 5), None, None), ("s", "other", date(2024, 1, 1), None, None)], "section_id string, source string, valid_from date, valid_to date, system_to date")
    closings = spark.createDataFrame([("s", "o", date(2024, 1, 5))], "section_id string, source string, closed_at date")
    got = {(r["source"], str(r["valid_from"])): str(r["valid_to"]) for r in T.close_valid(rows, closings).collect()}
    assert got == {("o", "2024-01-01"): "2024-01-05", ("o", "2024-01-05"): "None", ("other", "2024-01-01"): "None"}


def test_retraction_keeps_history(spark):
    rows = spark.createDataFrame([("v1", None), ("v2", date(2024, 1, 1))], "version_id string, system_to date")
    gone = spark.createDataFrame([("v1", date(2024, 2, 1)), ("v2", date(2024, 3, 1))], "version_id string, at date")
    assert {r["version_id"]: str(r["system_to"]) for r in T.retract(rows, gone).collect()} == {"v1": "2024-02-01", "v2": "2024-01-01"}


def test_hash_diff_statuses(spark):
    schema = "doc string, chunk string, hash string"
    now = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("b", "2", "y"), ("c", "1", "n")], schema)
    was = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("b", "2", "z")], schema)
    assert {r["doc"]: r["status"] for r in T.hash_diff(was, now).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}


def test_unknown_scope_is_an_error():
    import pytest

    facets = {"pay": {"gs", "ses"}}
    assert T.check_scope(facets, {"pay": "gs"}) == {"pay": "gs"}
    for bad in ({"pay": "x"}, {"color": "gs"}):
        with pytest.raises(ValueError):
            T.check_scope(facets, bad)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast('2024-01-01' as date) valid_from", "cast(null as date) valid_to", "cast(null as date) system_to", "'p' part", "1 authority").write.parquet(f"file://{tmp_path}/v")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = T.as_of(spark.read.parquet(f"file://{tmp_path}/v"), F.to_date(F.lit("2024-05-01")), exclude_parts=["x"], max_authority=3)
    plan = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(authority,3)" in plan and "IsNull(system_to)" in plan


def test_versions_of_a_stream_are_those_of_the_batch_build(spark, tmp_path):
    from datetime import date

    from pyspark.sql import functions as F

    from chronolith.operators.temporal import scd2
    from chronolith.streaming.state import versions_kept, versions_sink

    day = lambda d: date(2024, 1, d)
    rows = [("a", day(1), "x"), ("b", day(1), "x"), ("a", day(2), "y"), ("b", day(2), "x"), ("a", day(3), "y"), ("a", day(4), "z"), ("b", day(5), "w"), ("a", day(5), "z"), ("c", day(5), None), ("a", day(6), "z")]
    schema = "section string, date date, text string"
    sink = versions_sink(f"{tmp_path}/v")
    for number, (lo, hi) in enumerate([(1, 2), (3, 4), (5, 5), (5, 5), (6, 6)]):
        batch = spark.createDataFrame([r for r in rows if lo <= r[1].day <= hi], schema)
        sink(batch, number)
        sink(batch, number)  # repeated after a failure
    got = {tuple(r) for r in versions_kept(spark, f"{tmp_path}/v", 4).collect()}
    want = {tuple(r) for r in scd2(spark.createDataFrame(rows, schema)).select("section", "text", "valid_from", "valid_to").collect()}
    assert got == want and len(want) == versions_kept(spark, f"{tmp_path}/v", 4).agg(F.count("*")).first()[0]
