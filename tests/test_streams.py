"""Streams keep their rows in the shared folder, whatever their number."""

from __future__ import annotations

from chronolith.plans import streams

from .conftest import SF


def test_a_stream_s_rows_come_from_files_and_not_from_the_driver(spark):
    for plan in (streams.token_bucket, streams.metric_windows):
        found = plan(spark, SF)
        assert all("/stream-" in f for f in found.inputFiles()) and found.inputFiles()
    assert not spark.catalog.listTables()


def test_rows_of_several_batches_are_kept_once(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert sorted(r["id"] for r in streams._run(stream, "append").collect()) == list(range(30))
    assert [(r["n"], r["c"]) for r in streams._run(stream.groupBy((stream["id"] % 1).alias("n")).count().withColumnRenamed("count", "c"), "complete").collect()] == [(0, 30)]


def test_a_stream_of_nothing_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert streams._run(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "append").collect() == []
