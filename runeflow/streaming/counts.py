"""The same operators on streams: tokenization is stateless, so a stream's plan is the batch plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runeflow.functions import scan


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of document files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def class_counts(docs: DataFrame) -> DataFrame:
    return scan.tokens(docs).groupBy("cls").agg(F.count("*").alias("n"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """IO20: lines from a socket, for development."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text"))


def run_to_end(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Processes what is there and returns the result table."""
    name = f"stream_{uuid.uuid4().hex}"
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name)


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of events by type and time window, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
