"""Session defaults and the shared folder used for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "daygraph", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DAYGRAPH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's checkpoint folder.

    Only where the session names none and runs on one machine, a local folder is
    made and registered, so later calls find the same one. On a cluster a folder of
    the driver's machine would lose rows, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="daygraph-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    """New, never reused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/daygraph/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes that a row of a day-graph table takes in memory per byte of its Parquet file (nodes: 26 MB of file are some 1 GB).
UNPACKED = 40.0
FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"


def count_unpacked(spark: SparkSession) -> None:
    """Let Spark judge tables by their size in memory when it chooses joins.

    Day-graph tables pack so well that millions of rows look like a few MB, and were sent whole through the
    driver. A side that proves small is still broadcast at run time (AQE).
    """
    if float(spark.conf.get(FILE_FACTOR)) < UNPACKED:
        spark.conf.set(FILE_FACTOR, str(UNPACKED))


#: Whether Spark deletes the shuffle files of a query when it ends, instead of when the driver forgets it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    The shuffle files behind the table go as soon as it is written: a lost executor
    re-reads the table, nothing asks for them again.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more (never one that a returned DataFrame reads)."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/daygraph/" not in path:
                raise ValueError(f"{path} is no table of the shared folder")
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
