"""Joins with frequent keys: same rows as the plain join, and frequent keys really spread."""

import pytest
from pyspark.sql import functions as F

from regmart.operators import hot_join, hot_keys

PLAIN = {"inner": "inner", "many_outer": "left", "many_semi": "left_semi"}


def rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(v is None, v or 0) for v in r])


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows has key 1, another third no key; key 2 has copies; some keys are on one side only."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 1).when(n % 3 == 1, F.lit(None)).otherwise(n % 40).cast("bigint")
    many = spark.range(0, 3000, 1, 6).select(key.alias("k"), (n % 7).alias("x")).withColumn("x", F.when(F.col("k") == 2, 0).otherwise(F.col("x")))
    one = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (35, 30), (77, 40), (None, 50), (None, 51)], "k bigint, y int")
    return many, one


@pytest.mark.parametrize("rows_per_task", [1, 30, 10_000])
@pytest.mark.parametrize("how", ["inner", "many_outer", "one_outer", "many_semi"])
def test_same_rows_as_plain_join(sides, how, rows_per_task):
    many, one = sides
    cols = ["k", "x"] if how == "many_semi" else ["k", "x", "y"]
    plain = one.join(many, "k", "left") if how == "one_outer" else many.join(one, "k", PLAIN[how])
    assert rows(hot_join(many, one, ["k"], how, rows_per_task=rows_per_task, max_salts=5), cols) == rows(plain, cols)


def test_keys_called_frequent_by_mistake_change_nothing(spark, sides):
    many, one = sides
    wrong = spark.createDataFrame([(77,), (35,), (5,), (None,)], "k bigint").select(F.xxhash64("k"))
    wrong = {r[0]: 3 for r in wrong.collect()}
    for how in ("inner", "one_outer", "many_outer"):
        plain = one.join(many, "k", "left") if how == "one_outer" else many.join(one, "k", PLAIN[how])
        assert rows(hot_join(many, one, ["k"], how, hot=wrong), ["k", "x", "y"]) == rows(plain, ["k", "x", "y"])


def test_empty_sides(sides):
    many, one = sides
    none = many.filter("x > 100")
    assert hot_join(none, one, ["k"], "one_outer", rows_per_task=1).count() == one.count()
    assert hot_join(many, one.filter("y > 100"), ["k"], "many_outer", rows_per_task=1).count() == many.count()
    assert hot_join(many, one.filter("y > 100"), ["k"], "inner", rows_per_task=1).count() == 0


def test_two_column_keys(spark):
    many = spark.range(0, 900, 1, 4).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), "id")
    one = spark.createDataFrame([(0, 0, "p"), (0, 0, "q"), (1, 2, "r"), (5, 5, "s")], "a bigint, b bigint, y string")
    found = hot_join(many, one, ["a", "b"], "one_outer", rows_per_task=1, max_salts=4)
    plain = one.join(many, ["a", "b"], "left")
    assert sorted(map(tuple, found.select("a", "b", "y", "id").collect()), key=str) == sorted(
        map(tuple, plain.select("a", "b", "y", "id").collect()), key=str
    )


def test_known_matches(sides):
    many, one = sides
    known = one.join(many.select("k").distinct().withColumn("has", F.lit(True)), "k", "left")
    plain = one.join(many, "k", "left")
    found = hot_join(many, known, ["k"], "one_outer", matched="has", rows_per_task=20)
    assert rows(found, ["k", "x", "y"]) == rows(plain, ["k", "x", "y"])


def test_hot_keys_are_found_and_bounded(sides):
    many, _ = sides
    found = hot_keys(many, ["k"], rows_per_task=500)
    exact = many.groupBy(F.xxhash64("k").alias("h")).count().filter("count >= 500").collect()
    assert found == {r["h"]: r["count"] // 500 + 1 for r in exact} and len(found) == 2
    assert len(hot_keys(many, ["k"], rows_per_task=1, max_keys=3)) == 3
    assert max(hot_keys(many, ["k"], rows_per_task=1, max_salts=9).values()) == 9
    assert hot_keys(many.filter("x > 100"), ["k"]) == {}


def test_all_frequent_keys_are_found(spark):
    many = spark.range(0, 6000, 1, 4).select((F.col("id") % 1500).alias("k"))
    assert len(hot_keys(many, ["k"], rows_per_task=4)) == 1500


def test_a_frequent_key_is_spread_over_tasks(spark):
    many = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"), "id")
    one = spark.createDataFrame([(1, "a")], "k int, y string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = hot_join(many, one, ["k"], "one_outer", rows_per_task=100)
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(r["count"] for r in tasks) == 4000
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 2500


def test_wrong_calls(sides):
    many, one = sides
    with pytest.raises(ValueError, match="how"):
        hot_join(many, one, ["k"], "left")
    with pytest.raises(ValueError, match="both sides"):
        hot_join(many, one.withColumnRenamed("y", "x"), ["k"])
    with pytest.raises(ValueError, match="bigint"):
        hot_join(many, one.withColumn("k", F.col("k").cast("int")), ["k"])
