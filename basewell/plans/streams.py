"""Streams over the files of the given tables, run until all is read (X series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.plans.catalog import query
from basewell.plans.views import table
from basewell.sources.scratch import new_path
from basewell.streaming import incremental


RUNS = 4


def _runs(spark: SparkSession, sf_dir: str, numbers: list[int], path: str) -> DataFrame:
    """Adds those runs of the events, which are dealt to RUNS runs by their time, to a folder; returns the events."""
    events = table(spark, sf_dir, "events")
    run = F.pmod(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(RUNS))
    incremental.write_runs(events.where(run.isin(numbers)), path, run)
    return events


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS value_sum, round(avg(value), 6) AS value_mean FROM events GROUP BY event_type")
def x01_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode over a folder of runs, a run a batch: each batch's changed means replace those of the batch before."""
    path, out, state = (new_path(spark) for _ in range(3))
    events = _runs(spark, sf_dir, list(range(RUNS)), path)
    stream = incremental.running_means(incremental.run_source(spark, path, events), ["event_type"], ["value"])
    incremental.fold_available(stream, "update", incremental.upsert(out, ["event_type"], ["n", "value_sum", "value_mean"]), state)
    return incremental.newest(spark, out).select("event_type", "n", F.round("value_sum", 6).alias("value_sum"), F.round("value_mean", 6).alias("value_mean"))


@query("SELECT sha256(coalesce(text, '')) AS digest, length(coalesce(text, ''))::INT AS length, count(*) AS n FROM documents GROUP BY ALL")
def x02_distinct_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = incremental.source(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return incremental.all_available(incremental.distinct_sequences(docs, "text"), "complete")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def x03_by_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark is as long as the data, so no row is late; the last windows come out in complete mode."""
    values = [F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")]
    events = incremental.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = incremental.by_event_window(events, "ts", "1 hour", "3650 days", ["event_type"], values)
    out = incremental.all_available(stream, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean")


@query("""WITH windows AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL)
SELECT * FROM windows WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 2 hours FROM events)""")
def x03_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: runs come one by one in the order of their time, and a window is written once, when the watermark, two hours behind the newest row, has passed its end.

    State holds open windows only. Windows that are open at the last row aren't there yet; rows without a time have none.
    """
    path, out, state = (new_path(spark) for _ in range(3))
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    ends = events.agg(F.min(at).alias("low"), F.max(at).alias("high"))  # one row
    run = F.least(F.lit(RUNS - 1), F.floor((at - F.col("low")) / F.greatest((F.col("high") - F.col("low")) / RUNS, F.lit(1))))
    dealt = events.where("ts is not null").join(F.broadcast(ends), F.lit(True)).withColumn("run", run)
    values = [F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")]
    for number in range(RUNS):
        dealt.where(F.col("run") == number).select(*events.columns).write.parquet(f"{path}/run={number}")
        windows = incremental.by_event_window(incremental.run_source(spark, path, events, None), "ts", "1 hour", "2 hours", ["event_type"], values)
        closed = windows.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean")
        incremental.append_available(closed, out, state)
    return spark.read.schema(closed.schema).parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, max(value) AS most FROM events GROUP BY event_type")
def x04_merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs are reported, then a new one appears; the same stream goes on, finds it, and folds it into the report."""
    path, out, state = (new_path(spark) for _ in range(3))
    fold = incremental.merge_into(out, ["event_type"], {"n": lambda a, b: a + b, "most": F.greatest})

    def run(batch: DataFrame, number: int) -> None:
        fold(batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")), number)

    for numbers in (list(range(RUNS - 1)), [RUNS - 1]):
        events = _runs(spark, sf_dir, numbers, path)
        incremental.fold_available(incremental.run_source(spark, path, events), "append", run, state)
    return incremental.newest(spark, out)
