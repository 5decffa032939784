"""What the operators of this subpackage share: checkpoints, row ids, tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, as every operator here understands it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where a single machine runs the tests."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="spark-")
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    The lineage ends there: a lost executor costs a re-read, not a recomputation, and the shuffle files of the write go at once. The table stays for as long as
    its readers may need it: discard() deletes it after the last, and what a result still reads stays in the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basewell-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """A session setting for the jobs run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, most: int) -> contextlib.AbstractContextManager[None]:
    """Batches of at most so many rows for the Python workers, for rows that hold whole texts."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", most)


def with_row_id(df: DataFrame, id_col: str, tie: str) -> tuple[DataFrame, bool]:
    """Adds ``row_id``, a unique long in the order of id_col (nulls last), then of the hash of column tie, then of tie; also whether it equals id_col.

    Where id_col is unique and has no null, it is the row id itself. Otherwise the rows are range-sorted and
    numbered, and the numbers are kept in a written table so that every later read sees the same ones.
    """
    n, known, distinct = df.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    if n == known == distinct:
        return df.withColumn("row_id", F.col(id_col).cast("long")), True
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(tie), F.col(tie)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("row_id", F.monotonically_increasing_id())), False


def added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of df with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind, True)])
