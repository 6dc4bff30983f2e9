"""Session settings and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "spanloom", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted session is used as it is."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPANLOOM_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan over all cores where its files come in fewer splits than there are cores; larger inputs stay where they are.

    Only for scans with filters and projections: what is moved is at most one split for each core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir. One of our own only where none is named and the master is local (tests); elsewhere a missing setting is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "spanloom-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's staged tables within the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back; survives the loss of executors. ``drop_staged`` removes what a session has staged."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application, once their results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
