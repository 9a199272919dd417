"""Streaming sources and the run-until-caught-up sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from convoy.session import shared_dir

RAW_SCHEMA = "oem string, received_at timestamp, line string, arrival bigint"


def read_raw_stream(
    spark: SparkSession,
    path: str,
    schema: str | StructType = RAW_SCHEMA,
    fmt: str = "parquet",
    max_files_per_trigger: int = 1,
) -> DataFrame:
    """Raw rows from a folder, from its beginning, a bounded number of files per micro-batch."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )


def read_raw_kafka(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int = 1_000_000
) -> DataFrame:
    """Raw envelopes from a topic keyed by VIN, from its beginning (needs the Kafka connector)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
        .select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")
    )


def stretches(df: DataFrame, order: str, parts: int) -> list[DataFrame]:
    """A table cut into consecutive stretches of an integer column, equal in value range."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // parts + 1
    at = F.col(order)
    return [df.filter((at >= low + i * step) & (at < low + (i + 1) * step)) for i in range(parts)]


def run_available(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    mode: str = "append",
    each_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Process what the source holds now, then stop. A kept checkpoint continues where it ended. Returns the ended query."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if each_batch is not None:
        running = writer.foreachBatch(each_batch).start()
    else:
        running = writer.format("parquet").option("path", path).start()
    running.awaitTermination()
    return running


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (data folder, checkpoint folder) in the shared folder."""
    root = shared_dir(spark, name)
    return f"{root}/data", f"{root}/checkpoint"
