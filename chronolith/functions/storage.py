"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The session's bound on an Arrow batch.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch: each task holds a few of them, in the JVM and in its Python worker, which keeps what it once took.
BATCH_BYTES = 2 << 20


def keep_batches_small(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES from here on, unless the session sets their bytes itself.

    For rows whose Arrow functions run when the caller reads them: Spark takes the bound of that time,
    so it stays set.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it.

    Only where it is unset on a single machine, as in tests, a folder of the warehouse takes its place.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_here = sc._jsc.sc().getCheckpointDir()
        if set_here.isDefined():
            found = set_here.get()
        elif sc.master.startswith("local"):
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop_path, fs = _hadoop(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back: lineage is cut,
    column pruning still works, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes what written() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        hadoop_path, fs = _hadoop(df.sparkSession, path)
        fs.delete(hadoop_path, True)
