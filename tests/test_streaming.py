"""The request log: appended, read back, summarised as a table and as a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regmart.plans import request_stats
from regmart.session import shared_dir
from regmart.sources import append_requests, read_requests, stream_requests
from regmart.streaming import start_request_stats

START = dt.datetime(2024, 1, 1)


def events(spark, first_minute, minutes, late_minute=None):
    """A request every second, three names, every tenth one failed."""
    n = F.col("id")
    rows = spark.range(first_minute * 60, (first_minute + minutes) * 60).select(
        (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)).alias("event_time"),
        F.concat(F.lit("q"), (n % 3).cast("string")).alias("query_name"),
        F.lit("sql").alias("request_type"),
        (n * 37 % 1000).alias("response_time_ms"),
        F.when(n % 10 > 0, 1).cast("bigint").alias("response_length"),
        F.when(n % 10 == 0, "failed").alias("exception"),
    )
    if late_minute is not None:
        late = rows.limit(1).withColumn("event_time", F.lit(START + dt.timedelta(minutes=late_minute)))
        rows = rows.union(late)
    return rows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("exact", [False, True])
def test_stream_equals_batch_on_closed_buckets(spark, tmp_path, exact):
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"
    append_requests(events(spark, 0, 10).select(*reversed(events(spark, 0, 10).columns)), log)
    batch = request_stats(read_requests(spark, log), exact=exact)
    assert batch.count() == 30
    query = start_request_stats(spark, log, out, watermark="2 minutes", exact=exact, checkpoint=f"{tmp_path}/cp", available_now=True)
    query.awaitTermination(120)
    streamed = spark.read.parquet(out)
    closed = batch.filter(F.col("bucket_start") < F.lit(START + dt.timedelta(minutes=7)))
    assert rows(streamed) == rows(closed.select(*streamed.columns))
    assert streamed.count() == 21


def test_stream_resumes_and_drops_late_events(spark, tmp_path):
    log, out, cp = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cp"

    def advance():
        start_request_stats(spark, log, out, watermark="1 minute", checkpoint=cp, available_now=True).awaitTermination(120)
        return spark.read.parquet(out)

    append_requests(events(spark, 0, 5), log)
    assert advance().count() == 9  # minutes 0 to 2 are closed
    append_requests(events(spark, 5, 5, late_minute=0), log)
    counts = {r[0]: r[1] for r in advance().groupBy("bucket_start").agg(F.sum("requests")).collect()}
    assert counts == {START + dt.timedelta(minutes=m): 60 for m in range(8)}


def test_stream_needs_watermark(spark, tmp_path):
    append_requests(events(spark, 0, 1), f"{tmp_path}/log")
    with pytest.raises(ValueError):
        request_stats(stream_requests(spark, f"{tmp_path}/log"))


def test_default_checkpoint_is_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        with pytest.raises(ValueError):
            shared_dir(spark)
    else:
        assert shared_dir(spark) == named.rstrip("/")
