"""Lookups by the rarest key and merged percentiles against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from regmart.operators import keys, optional_key_lookup, repeated
from regmart.plans import merged_stats, request_sketches
from regmart.plans.requests import SKETCH_ERROR

SF_DIR = "/root/testdata/sf0.001"
COLS = ["a", "b", "c"]


def plain(rows, requests):
    found = []
    for q in requests:
        if None not in q:
            found += [(*q, *r) for r in rows if all(k == "" or k == v for k, v in zip(q, r[:3]))]
    return sorted(found, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_lookup_by_the_rarest_key(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(keys, "ROWS_PER_TASK", 10)  # frequent values are spread
    value = lambda k, *more: rng.choice([*"xyz"[:k], *more])
    rows = [(value(2, None, ""), value(3, None), f"v{rng.randrange(20)}", i) for i in range(120)]
    rows += [("hot", value(3), "v1", i) for i in range(80)]
    requests = [(value(2, "", "", None), value(3, "", ""), rng.choice(["", "v1", "v5", "none"])) for _ in range(15)]
    requests += [("", "", "")] * (seed % 3) + [("hot", "", "")] * 2
    table = spark.createDataFrame(rows, "a string, b string, c string, n int").repartition(4)
    asked = spark.createDataFrame(requests, "a string, b string, c string")
    expected = plain(rows, requests)
    assert sorted((tuple(r) for r in optional_key_lookup(table, asked, COLS).collect()), key=str) == expected
    once = plain(rows, list(dict.fromkeys(requests)))
    assert sorted((tuple(r) for r in optional_key_lookup(table, requests, COLS).collect()), key=str) == once


def test_lookup_of_nothing(spark):
    table = spark.createDataFrame([("x", "y", "z", 1)], "a string, b string, c string, n int")
    none = spark.createDataFrame([], "a string, b string, c string")
    for asked in (none, [], [(None, "y", "z")]):
        found = optional_key_lookup(table, asked, COLS)
        assert found.collect() == [] and found.columns == ["request_a", "request_b", "request_c", *table.columns]
    assert optional_key_lookup(table.limit(0), [("x", "", "")], COLS).collect() == []


def test_lateral_lookups_are_joins_by_key(spark):
    text = QUERIES["include_list_lateral"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and text.count("Join [") > 4


@pytest.mark.parametrize("seed", range(3))
def test_merged_percentiles(spark, seed):
    """Minutes of uneven length, one with a third of all requests, merged to hours."""
    rng = random.Random(seed)
    rows = [(rng.randrange(7200) if i % 3 else 5, rng.choice("ab"), int(rng.expovariate(0.001)) if rng.random() > 0.02 else None, rng.random() < 0.1) for i in range(30_000)]
    log = spark.createDataFrame(rows, "s long, query_name string, response_time_ms long, failed boolean").select(
        F.timestamp_seconds("s").alias("event_time"), "query_name", "response_time_ms", F.lit(2).cast("bigint").alias("response_length"),
        F.when(F.col("failed"), "error").alias("exception"),
    )
    got = {(r.query_name, r.bucket_start.hour): r for r in merged_stats(request_sketches(log), "1 hour").collect()}
    for name in "ab":
        for hour in (0, 1):
            mine = [(ms, f) for s, n, ms, f in rows if n == name and s // 3600 == hour]
            times = sorted(ms for ms, _ in mine if ms is not None)
            r = got.pop((name, hour))
            assert (r.requests, r.failures, r.total_length) == (len(mine), sum(f for _, f in mine), 2 * len(mine))
            assert abs(r.mean_ms - sum(times) / len(times)) < 1e-6
            for p, v in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
                below, upto = sum(t < v for t in times) / len(times), sum(t <= v for t in times) / len(times)
                assert below - SKETCH_ERROR <= p <= upto + SKETCH_ERROR
    assert not got
    untimed = log.filter("response_time_ms is null").limit(1)
    assert [(r.requests, r.p50_ms, r.mean_ms) for r in merged_stats(request_sketches(untimed), "1 hour").collect()] == [(1, None, None)]


def most_rows_of_a_task(df):
    """Rows that come out of the fullest task."""
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_equal_requests_are_repeated_over_tasks(spark, monkeypatch):
    """Few rows in few tasks, and many requests alike: what comes out is spread."""
    monkeypatch.setattr(keys, "ROWS_PER_TASK", 1000)
    table = spark.createDataFrame([("x", "y", str(i), i) for i in range(20)], "a string, b string, c string, n int").coalesce(1)
    asked = spark.range(1500).select(F.lit("x").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))
    for requests, n in ((asked, 30_000), (asked.withColumn("a", F.lit("")), 30_000)):
        found = optional_key_lookup(table, requests, COLS)
        assert {r["n"]: r["count"] for r in found.groupBy("n").count().collect()} == {i: n // 20 for i in range(20)}
        assert most_rows_of_a_task(found) < n // 10


def test_repeated_rows(spark):
    """Whatever the counts and however many rows are told, each row comes as often as it should."""
    rows = [("a", 1), ("a", 1), ("b", 9), ("b", 10), ("c", 11), (None, 2500)]
    df = spark.createDataFrame(rows, "k string, t bigint").coalesce(1)
    expected = {"a": 2, "b": 19, "c": 11, None: 2500}
    for told in (1, 2532, 50_000):
        found = repeated(df, "t", told, rows_per_task=1000)
        assert found.columns == ["k"] and {r["k"]: r["count"] for r in found.groupBy("k").count().collect()} == expected
    assert most_rows_of_a_task(repeated(df, "t", 2532, rows_per_task=1000)) < 1200


def test_lateral_lookups_repeat_last(spark):
    """Requests are folded before the joins, whose keys are few."""
    text = QUERIES["include_list_lateral"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("explode(sequence(1") < text.index("Join") and "count(1)" in text
