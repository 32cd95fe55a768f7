"""Events as a request log: the event type is the query, the value its seconds."""

import uuid

from pyspark.sql import functions as F

from regmart.plans import merged_stats, request_sketches, request_stats
from regmart.plans.requests import PERCENTILES, SKETCH_ERROR
from regmart.session import shared_dir
from regmart.sources import append_requests
from regmart.streaming import start_request_stats

from .tables import read


def request_log(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("query_name"),
        F.lit("sql").alias("request_type"),
        F.round(F.col("value") * 1000).cast("bigint").alias("response_time_ms"),
        F.col("user_id").alias("response_length"),
        F.when(F.col("value") < 5, "timeout").alias("exception"),
    )


def _request_stats(spark, sf_dir):
    stats = request_stats(request_log(spark, sf_dir), "1 day", exact=True)
    return stats.withColumns({c: F.round(c, 6) for c in ("failure_rate", "mean_ms", "p50_ms", "p95_ms", "p99_ms")})


def _request_percentiles(spark, sf_dir):
    """Weekly statistics merged from sketches of minutes, with whether each percentile's rank among the week's latencies is within the stated error."""
    log = request_log(spark, sf_dir)
    stats = merged_stats(request_sketches(log), "7 days")
    weekly = log.select("query_name", F.window("event_time", "7 days")["start"].alias("bucket_start"), "response_time_ms")
    ms = F.col("response_time_ms")
    ranks = weekly.join(stats, ["query_name", "bucket_start"]).groupBy("query_name", "bucket_start", "requests", "failures", "mean_ms", "total_length").agg(
        *[
            ((F.avg((ms < F.col(name)).cast("int")) - SKETCH_ERROR <= p) & (F.avg((ms <= F.col(name)).cast("int")) + SKETCH_ERROR >= p)).alias(name)
            for name, p in PERCENTILES.items()
        ]
    )
    return ranks.withColumn("mean_ms", F.round("mean_ms", 6))


def _request_stream(spark, sf_dir):
    """Daily statistics of a stream of the log, which was appended twice. A last request a month later closes all days before it."""
    log = request_log(spark, sf_dir)
    folder = f"{shared_dir(spark)}/request_stream-{uuid.uuid4().hex}"
    for _ in range(2):
        append_requests(log, f"{folder}/log")
    end = log.agg((F.max("event_time") + F.expr("INTERVAL 31 DAYS")).alias("event_time"))
    append_requests(end.select("event_time", *[F.lit(None).alias(c) for c in log.columns if c != "event_time"]), f"{folder}/log")
    start_request_stats(
        spark, f"{folder}/log", f"{folder}/stats", "1 day", checkpoint=f"{folder}/progress", available_now=True, once=True
    ).awaitTermination()
    stats = spark.read.parquet(f"{folder}/stats")
    return stats.select("query_name", "bucket_start", "requests", "failures", F.round("mean_ms", 6).alias("mean_ms"), "total_length")


QUERIES = {"request_stats": _request_stats, "request_percentiles": _request_percentiles, "request_stream": _request_stream}

ORACLE = {
    "request_stats": """
        WITH log AS (SELECT *, CAST(round(value * 1000) AS BIGINT) AS ms FROM events)
        SELECT event_type AS query_name, date_trunc('day', ts) AS bucket_start, count(*) AS requests,
               count(*) FILTER (value < 5) AS failures,
               round(count(*) FILTER (value < 5) / count(*), 6) AS failure_rate, round(avg(ms), 6) AS mean_ms,
               round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms,
               round(quantile_cont(ms, 0.99), 6) AS p99_ms, CAST(sum(user_id) AS BIGINT) AS total_length
        FROM log GROUP BY ALL
    """,
    "request_percentiles": """
        SELECT event_type AS query_name, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS requests,
               count(*) FILTER (value < 5) AS failures, round(avg(CAST(round(value * 1000) AS BIGINT)), 6) AS mean_ms,
               CAST(sum(user_id) AS BIGINT) AS total_length, true AS p50_ms, true AS p95_ms, true AS p99_ms
        FROM events GROUP BY ALL
    """,
    "request_stream": """
        SELECT event_type AS query_name, date_trunc('day', ts) AS bucket_start, count(*) AS requests,
               count(*) FILTER (value < 5) AS failures, round(avg(ms), 6) AS mean_ms, CAST(sum(user_id) AS BIGINT) AS total_length
        FROM (SELECT DISTINCT ts, event_type, CAST(round(value * 1000) AS BIGINT) AS ms, user_id, value < 5 AS failed,
                     CASE WHEN value < 5 THEN 1 ELSE 10 END AS value FROM events)
        GROUP BY ALL
    """,
}
