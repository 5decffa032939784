"""Tables that end a lineage: written in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Setting by which a query's shuffle files are deleted when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where one machine runs everything."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="spark-")
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/basewell-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """A session setting for the jobs run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder, with a folder for each value of ``by`` if given, and reads it again.

    A lost executor then costs a re-read, not a recomputation, and the shuffle files of the write go at once. The table stays for as long as its readers may need
    it: discard() deletes it after the last; what a result still reads stays, until whoever owns the folder clears it.
    """
    path = new_path(df.sparkSession)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt out over all cores, by keys if given: a small table is one task's, however much work each of its rows is."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize wrote, once nothing reads them any more."""
    for df in tables:
        if df is not None:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(df._written_to)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
