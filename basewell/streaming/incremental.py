"""Structured Streaming forms of running summaries. Each takes a streaming frame and returns one, so that sink, trigger and checkpoint stay the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basewell.sources.scratch import new_path


def running_means(stream: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Counts, sums and means by key; update or complete mode."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("sum", F.sum), ("mean", F.avg))])


def distinct_sequences(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads by distinct sequence; the state holds a digest and a count for each, not the sequence."""
    return stream.groupBy(F.sha2(F.col(seq).cast("binary"), 256).alias("digest"), F.length(seq).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def by_event_window(stream: DataFrame, time: str, window: str, late: str, by: list[str], values: list[Column]) -> DataFrame:
    """Aggregates by tumbling window of event time; rows later than the watermark are dropped, so state is bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *by).agg(*values)


def merge_into(path: str, keys: list[str], fold: dict[str, Callable[[Column, Column], Column]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds each micro-batch into the metric table of the batch before.

    Each batch writes a table of its own, named by its number, from the one before it; a batch that is run again
    after a failure overwrites its own table only, so its rows are folded in once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = batch
        if number > 0:
            old = spark.read.parquet(f"{path}/{number - 1}")
            renamed = batch.withColumnsRenamed({c: f"new_{c}" for c in fold})
            joined = old.join(renamed, keys, "full_outer")
            out = joined.select(*keys, *[F.when(F.col(c).isNull(), F.col(f"new_{c}")).when(F.col(f"new_{c}").isNull(), F.col(c)).otherwise(f(F.col(c), F.col(f"new_{c}"))).alias(c) for c, f in fold.items()])
        out.write.mode("overwrite").parquet(f"{path}/{number}")

    return run


def upsert(path: str, keys: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for update mode: the rows of a batch replace those of the same keys in the metric table.

    A batch writes the table of its number from the one before, so running it again changes nothing.
    """
    return merge_into(path, keys, {v: lambda _, new: new for v in values})


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The metric table after the last batch that merge_into or upsert has written whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = [int(s.getPath().getName()) for s in files.listStatus(hadoop) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(done)}")


def write_runs(df: DataFrame, path: str, run: Column) -> None:
    """Adds the rows to a folder of runs, each run in a folder of its own, as an instrument leaves them."""
    df.withColumn("run", run).repartition("run").write.mode("append").partitionBy("run").parquet(path)


def run_source(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = 1) -> DataFrame:
    """The folders of runs as a stream, files_per_batch files a batch (None: all there are); folders that come later are found by the next trigger."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path}/run=*")


def fold_available(stream: DataFrame, mode: str, fold: Callable[[DataFrame, int], None], state: str) -> int:
    """Folds all micro-batches that are there; with the same state a later call takes up only what is new. Returns how many batches this call ran."""
    ran = []

    def counted(batch: DataFrame, number: int) -> None:
        fold(batch, number)
        ran.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(counted).start().awaitTermination()
    return len(ran)


def append_available(stream: DataFrame, path: str, state: str) -> None:
    """Appends what has become final to a table, each row once also after a failure; with the same state a later call goes on where this one ended.

    For aggregates with a watermark: a group comes out when the watermark has passed its end, and its state goes.
    """
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """The table as a stream of its files."""
    schema: StructType = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def all_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what there is into a table in the shared folder, and reads it.

    In complete mode the table of the last micro-batch counts.
    """
    spark = stream.sparkSession
    path, state = new_path(spark), new_path(spark)
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last["at"] = number

    writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last['at']}") if last else spark.createDataFrame([], stream.schema)
