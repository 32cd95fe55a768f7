"""Statistics of a request log, the same function for a table and for a stream."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def request_stats(
    log: DataFrame,
    bucket: str = "1 minute",
    exact: bool = False,
    accuracy: int = 10_000,
    watermark: str | None = None,
    percentiles: dict[str, float] = PERCENTILES,
) -> DataFrame:
    """Per query name and time bucket: requests, failures, latency and response sizes.

    Percentiles come from a sketch of bounded size (`accuracy`), or are interpolated exactly when `exact`. Exact ones
    need each bucket's distinct latencies in one task: whole milliseconds, so their number is bounded by the
    longest latency, not by the number of requests; a table is counted per latency first. A stream needs a `watermark`, unless it has one;
    events later than it are dropped.
    """
    if log.isStreaming:
        marked = any(f.name == "event_time" and "spark.watermarkDelayMs" in f.metadata for f in log.schema.fields)
        if watermark is not None:
            log = log.withWatermark("event_time", watermark)
        elif not marked:
            raise ValueError("a stream needs a watermark")
    timed = log.withColumn("_bucket", F.window("event_time", bucket))
    ms = F.col("response_time_ms")
    failed = F.col("exception").isNotNull()
    points = F.array(*[F.lit(p) for p in percentiles.values()])

    if exact and not log.isStreaming:
        per_latency = timed.groupBy("query_name", "_bucket", "response_time_ms").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(failed).alias("failed"),
            F.sum("response_length").alias("length"),
        )
        n = F.col("n")
        stats = per_latency.groupBy("query_name", "_bucket").agg(
            F.sum(n).alias("requests"),
            F.sum("failed").alias("failures"),
            (F.sum(ms * n) / F.sum(F.when(ms.isNotNull(), n))).alias("mean_ms"),
            F.percentile(ms, points, n).alias("_p"),
            F.sum("length").alias("total_length"),
        )
    else:
        chosen = F.percentile(ms, points) if exact else F.percentile_approx(ms, points, accuracy)
        stats = timed.groupBy("query_name", "_bucket").agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(failed).alias("failures"),
            F.avg(ms).alias("mean_ms"),
            chosen.alias("_p"),
            F.sum("response_length").alias("total_length"),
        )
    return stats.select(
        "query_name",
        F.col("_bucket.start").alias("bucket_start"),
        "requests",
        "failures",
        (F.col("failures") / F.col("requests")).alias("failure_rate"),
        "mean_ms",
        *[F.col("_p")[i].alias(name) for i, name in enumerate(percentiles)],
        "total_length",
    )


# Values kept per level of a latency sketch. Of 99 in 100 sketches the rank of a percentile is off by less than the error beside it.
SKETCH_SIZE = 400
SKETCH_ERROR = 0.01


def request_sketches(log: DataFrame, bucket: str = "1 minute", size: int = SKETCH_SIZE) -> DataFrame:
    """Per query name and time bucket: requests, failures, latency and response sums, and a sketch of the latencies.

    Rows can be kept and merged to longer buckets by `merged_stats`, without the events. A sketch (KLL) holds a bounded number of latencies."""
    ms = F.col("response_time_ms")
    timed = log.withColumn("_bucket", F.window("event_time", bucket))
    return timed.groupBy("query_name", F.col("_bucket.start").alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("exception").isNotNull()).alias("failures"),
        F.count(ms).alias("timed"),
        F.sum(ms).alias("total_ms"),
        F.sum("response_length").alias("total_length"),
        F.kll_sketch_agg_bigint(ms.cast("bigint"), size).alias("latencies"),
    )


def merged_stats(sketches: DataFrame, bucket: str, percentiles: dict[str, float] = PERCENTILES, size: int = SKETCH_SIZE) -> DataFrame:
    """The statistics of `request_stats` for longer buckets, from the rows of `request_sketches`; percentiles are latencies that occurred.

    Sketches are merged before and after the shuffle. Sums are exact."""
    longer = sketches.withColumn("_bucket", F.window("bucket_start", bucket))
    merged = longer.groupBy("query_name", F.col("_bucket.start").alias("bucket_start")).agg(
        *[F.sum(c).alias(c) for c in ("requests", "failures", "timed", "total_ms", "total_length")],
        F.kll_merge_agg_bigint("latencies", size).alias("latencies"),
    )
    at = lambda p: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("latencies", F.lit(p)))
    return merged.select(
        "query_name", "bucket_start", "requests", "failures", (F.col("failures") / F.col("requests")).alias("failure_rate"),
        F.when(F.col("timed") > 0, F.col("total_ms") / F.col("timed")).alias("mean_ms"),
        *[at(p).alias(name) for name, p in percentiles.items()], "total_length",
    )
