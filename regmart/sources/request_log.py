"""The request log: one row per request, appended as Parquet, read as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schemas import SCHEMAS

REQUEST_LOG = SCHEMAS["request_log"]


def append_requests(events: DataFrame, path: str) -> None:
    """Append request events, with their columns in the log's order and types."""
    events.to(T.StructType.fromDDL(REQUEST_LOG)).write.mode("append").parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_LOG).parquet(path)


def stream_requests(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files of the log as they arrive, at most `max_files` per batch."""
    reader = spark.readStream.schema(REQUEST_LOG)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
