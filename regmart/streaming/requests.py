"""Request statistics kept up to date from the growing request log."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.requests import request_stats
from ..session import shared_dir
from ..sources.request_log import stream_requests


def without_repeats(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream of requests with equal ones once. A request is remembered until the watermark has passed it; copies after that are too late to count."""
    return log.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(log.columns)


def start_request_stats(
    spark: SparkSession,
    log_path: str,
    out_path: str,
    bucket: str = "1 minute",
    watermark: str = "10 minutes",
    exact: bool = False,
    checkpoint: str | None = None,
    available_now: bool = False,
    max_files: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append the statistics of each closed bucket to Parquet at `out_path`.

    A bucket is written once the watermark has passed its end. The query's progress is kept at `checkpoint`, by default
    in a folder of the cluster's shared checkpoint folder that is named after `out_path`. With `available_now` it stops after the files that are there.
    With `once`, a request that was appended again by a retry, equal in all columns, counts once.
    """
    log = stream_requests(spark, log_path, max_files)
    if once:
        log = without_repeats(log, watermark)
    stats = request_stats(log, bucket, exact=exact, watermark=None if once else watermark)
    writer = (
        stats.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/request_stats-{zlib.crc32(out_path.encode()):08x}")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
