"""Where a job cuts its lineage: a Parquet table in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.phylomill.own.checkpoint.dir"
_FACTOR = "spark.sql.sources.fileCompressionFactor"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # older versions of Spark leave it to the collector
FACTOR = 32.0  # bytes of rows in memory for a byte of Parquet; long tables of few values reach more than that


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a new local folder, in local mode (tests) only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="spark-stash-")
        spark.conf.set(_OWN, where)
    return where.rstrip("/")


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    A lost executor then costs a re-read, not a re-run, and a loop's plan stays as small as one round. The folder
    goes when the session's JVM ends, or with ``discard``.

    Spark takes a file's size for that of its rows and would collect and broadcast millions of well compressed rows; so
    the session is told that rows are ``FACTOR`` times their files, unless it has a factor of its own.

    The write's shuffle files go when it ends, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if float(spark.conf.get(_FACTOR, "1.0")) == 1.0:
        spark.conf.set(_FACTOR, str(FACTOR))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing still to be run reads, such as a loop's last round."""
    for df in tables:
        fs, p = _file(df.sparkSession, df._stash)
        fs.delete(p, True)
