"""Streaming ingest of chunks: an extension, with the batch semantics of the store.

Chunks arrive as files; a chunk id that was seen within the watermark is
dropped, and every micro-batch is appended to the run log once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHUNKS = "chunk_id string, source_id string, decision_year int, arrived timestamp, text string"


def read_chunks(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_chunks(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first arrival of each chunk; state is dropped once the watermark has passed."""
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["chunk_id"])


def arrivals(stream: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Chunks per time window and year."""
    w = F.window("arrived", width)
    return stream.withWatermark("arrived", late).groupBy(w.alias("w"), "decision_year").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "decision_year", "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write each micro-batch under its epoch, so that a repeated one replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUN = "key string, at long, id long"


def read_runs(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_runs(stream: DataFrame) -> DataFrame:
    """(key, at, id): the latest run of a key whenever rows of it arrive; among runs of one time the greatest id.

    The state of a key is the latest run seen, so a late row changes nothing and
    rows may come in any order. It holds one row per key, for as long as the
    stream's checkpoint lives. The rows of a batch are reduced where they are
    read before they meet the state.
    """
    return stream.groupBy("key").agg(F.max(F.struct("at", "id")).alias("r")).select("key", "r.at", "r.id")


def newest(changes: DataFrame) -> DataFrame:
    """The table that a log of changes of ``latest_runs`` stands for."""
    return changes.groupBy("key").agg(F.max(F.struct("at", "id")).alias("r")).select("key", "r.at", "r.id")
