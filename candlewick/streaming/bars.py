"""Bars and source health from streams of ticks and calls."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewick.session import shared_dir

TICK_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str, files: str = "*.parquet", per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", files)
            .option("maxFilesPerTrigger", per_batch).parquet(folder))


def ticks(spark: SparkSession, folder: str, files: str = "events.parquet", per_batch: int = 100) -> DataFrame:
    df = read_stream(spark, folder, TICK_SCHEMA, files, per_batch)
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ts_code"), "value")


def bars(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding OHLCV bars.  Works on a batch frame as well.

    A tick later than ``late`` behind the newest one is dropped from the stream
    (:func:`repair` brings it in).  Partial aggregation runs before the exchange,
    so a busy code sends one row per task and bar.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    df = stream.withWatermark("ts", late) if stream.isStreaming else stream
    agg = df.groupBy(span, "ts_code").agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("vol"))
    return agg.select("ts_code", F.col("window.start").cast("timestamp_ntz").alias("bar_time"), "open", "high", "low", "close", "vol")


def source_health(stream: DataFrame, width: str = "1 hour", late: str = "1 hour", min_calls: int = 10,
                  threshold: float = 0.3) -> DataFrame:
    """Calls, failure share and verdict per source and window of a call stream
    (source, ts, failed)."""
    df = stream.withWatermark("ts", late) if stream.isStreaming else stream
    agg = df.groupBy(F.window("ts", width), "source").agg(F.count(F.lit(1)).alias("n_calls"), F.avg(F.col("failed").cast("int")).alias("failure_rate"))
    bad = (F.col("n_calls") >= min_calls) & (F.col("failure_rate") > threshold)
    return agg.select("source", F.col("window.start").cast("timestamp_ntz").alias("bar_time"), "n_calls", "failure_rate", bad.alias("tripped"))


def drain(stream: DataFrame, mode: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over everything that is there and stop; returns the folder of
    the results.

    Each micro-batch replaces its own slice (``batch=<id>``), so a batch that is
    run again after a failure leaves one copy.
    """
    spark = stream.sparkSession
    out = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out))

    q = (stream.writeStream.outputMode(mode).foreachBatch(each or save)
         .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each row a stream in update mode has written."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v")).select(*keys, "v.*")


def repair(table: DataFrame, ticks_of_codes: DataFrame, late_ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars with late ticks worked in: the affected codes are built again from all
    their ticks, the others stay."""
    codes = late_ticks.select("ts_code").distinct()
    again = bars(ticks_of_codes.unionByName(late_ticks).join(codes, "ts_code", "left_semi"), width)
    return table.join(codes, "ts_code", "left_anti").unionByName(again)
