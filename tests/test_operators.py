"""Operators and column functions on a few rows each, one trap per test."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from regmart.functions import (
    array_agg_nulls,
    concat_distinct,
    contains_any,
    day_gap_label,
    days_listed,
    flag_if,
    outcome_flag,
    to_flag,
    year_week,
)
from regmart.operators import (
    By,
    Dim,
    KeyProfile,
    Period,
    active_only,
    changed_values,
    checked_broadcast,
    desc,
    distinct_on,
    enrich,
    filter_key_tuples,
    filter_keys,
    key_filter,
    key_profile,
    latest_version,
    optional_key_lookup,
    period_snapshots,
    require_unique,
    role_pairs,
    row_count,
    top_rank,
    with_neighbours,
)

from regmart.operators.bitmaps import thinned
from regmart.operators.ordering import sort_columns
from regmart.operators.ranges import with_range

D = dt.date
TS = dt.datetime


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: [(v is None, str(v)) for v in r])


def values(spark, data, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, ddl).select(*cols).collect()]


# distinct_on


def test_distinct_on_nulls_form_one_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3), ("a", None)], "k string, v int")
    assert rows(distinct_on(df, ["k"], ["v"])) == [("a", 3), (None, 1)]


def test_distinct_on_null_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 2)], "k string, v int")
    assert rows(distinct_on(df, ["k"], [desc("v")])) == [("a", None)]
    assert rows(distinct_on(df, ["k"], [desc("v", nulls_first=False)])) == [("a", 2)]
    assert rows(distinct_on(df, ["k"], [By("v", nulls_first=True)])) == [("a", None)]


def test_distinct_on_needs_an_order(spark):
    with pytest.raises(ValueError):
        distinct_on(spark.range(3), ["id"], [])


def test_distinct_on_row_count(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"), "id")
    assert distinct_on(df, ["a", "b"], ["id"]).count() == df.select("a", "b").distinct().count()


# latest_version, top_rank


def test_latest_version_in_window(spark):
    data = [("a", 1, D(2021, 4, 1)), ("a", 2, D(2021, 4, 18)), ("a", 3, D(2021, 4, 19)), (None, 5, D(2021, 4, 2)),
            (None, 5, D(2021, 4, 3)), ("b", None, D(2021, 4, 2))]
    df = spark.createDataFrame(data, "k string, v int, d date")
    found = latest_version(df, "k", "v", D(2021, 4, 1), D(2021, 4, 18), "d")
    assert rows(found) == [("a", 2, D(2021, 4, 18)), (None, 5, D(2021, 4, 2)), (None, 5, D(2021, 4, 3))]
    with pytest.raises(ValueError):
        latest_version(df, "k", "v", lower=D(2021, 4, 1))


def test_top_rank_keeps_ties_and_nulls_first(spark):
    df = spark.createDataFrame(
        [("a", 2, 1), ("a", 2, 2), ("a", 1, 3), ("b", None, 4), ("b", 9, 5), (None, 1, 6), (None, 1, 7)], "k string, v int, id int"
    )
    assert rows(top_rank(df, ["k"], [desc("v")]), "id") == [(1,), (2,), (4,), (6,), (7,)]


def test_top_rank_contains_distinct_on(spark):
    df = spark.range(400).select((F.col("id") % 11).alias("k"), (F.col("id") % 5).alias("v"), "id")
    ties = set(rows(top_rank(df, ["k"], [desc("v")])))
    assert set(rows(distinct_on(df, ["k"], [desc("v")], ["id"]))) <= ties


# keys and flags


def test_filter_keys_matches_exactly(spark):
    df = spark.createDataFrame([("10 ",), ("10",), ("",), (None,)], "code string")
    assert rows(filter_keys(df, "code", ["10 ", "", "10 ", None])) == [("",), ("10 ",)]
    assert rows(filter_keys(df, "code", [])) == []


def test_filter_keys_never_multiplies(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(9)], "k bigint")
    keys = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k bigint")
    assert filter_keys(df, "k", keys).count() == 6
    assert filter_keys(df, "k", [1, 1, 2]).count() == 6
    with pytest.raises(ValueError):
        filter_keys(df, "k", keys.withColumn("x", F.lit(1)))


def test_long_key_lists(spark, monkeypatch):
    df = spark.range(0, 60, 1, 4).select((F.col("id") % 4).alias("k"), "id")
    keys = spark.createDataFrame([(0,), (0,), (3,), (None,), (9,)], "k int")
    expected = [(k, i) for i in range(60) for k in [i % 4] if k in (0, 3)]
    assert rows(filter_keys(df, "k", keys)) == sorted(expected, key=lambda r: [(False, str(v)) for v in r])
    monkeypatch.setattr("regmart.operators.keys.fits_broadcast", lambda df, max_bytes=0: False)
    assert rows(filter_keys(df, "k", keys)) == sorted(expected, key=lambda r: [(False, str(v)) for v in r])
    with pytest.raises(ValueError, match="string"):
        filter_keys(df, "k", keys.select(F.col("k").cast("string")))


def test_filter_key_tuples(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None)], "inn string, kpp string")
    assert rows(filter_key_tuples(df, ["inn", "kpp"], [("1", "b"), ("2", None)])) == [("1", "b")]


def test_active_only_drops_null_flags(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, deleted_flag boolean")
    assert rows(active_only(df), "id") == [(2,)]


def test_optional_keys(spark):
    lists = spark.createDataFrame(
        [("A", "1", "2"), ("B", "1", "3"), ("C", "", "2"), ("D", None, "2")], "name string, inn string, kpp string"
    )
    requests = [("1", ""), ("", "2"), ("1", "3"), ("", ""), ("9", ""), (None, "2")]
    expected = [("", "", n) for n in "ABCD"] + [("", "2", n) for n in "ACD"] + [("1", "", n) for n in "AB"] + [("1", "3", "B")]
    found = optional_key_lookup(lists, requests, ["inn", "kpp"])
    assert rows(found, "request_inn", "request_kpp", "name") == expected
    as_table = spark.createDataFrame(requests, "a string, b string")
    assert rows(optional_key_lookup(lists, as_table, ["inn", "kpp"]), "request_inn", "request_kpp", "name") == expected


# joins


def test_enrich_left_inner_and_checks(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("x", "X"), ("x", "X2"), ("z", "Z")], "bkh string, name string")
    assert rows(enrich(facts, [Dim(dim, "k", "bkh", {"name": "name"})]), "id", "name") == [
        (1, "X"), (1, "X2"), (2, None), (3, None)]
    assert rows(enrich(facts, [Dim(dim, "k", "bkh", {}, "inner")]), "id") == [(1,), (1,)]
    assert rows(enrich(facts, [Dim(dim, "k", "bkh", {}, "left_semi")]), "id") == [(1,)]
    with pytest.raises(ValueError, match="not unique"):
        enrich(facts, [Dim(dim, "k", "bkh", {})], check_unique=True)
    require_unique(dim, "name")


def test_broadcast_only_when_small(spark):
    small, large = spark.range(10), spark.range(11)  # a digit and 16 bytes each
    assert "ResolvedHint" in checked_broadcast(small, 170)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in checked_broadcast(large, 170)._jdf.queryExecution().analyzed().toString()


def test_role_pairs(spark):
    df = spark.createDataFrame([(1, "2", "s"), (1, "1", "c"), (1, "1", "d"), (2, "2", "s"), (None, "1", "c"), (None, "2", "s")],
                               "contract int, role string, party string")
    assert rows(role_pairs(df, "contract", "role", "2", "1"), "contract", "party", "party_2") == [(1, "s", "c"), (1, "s", "d")]


# periods, changes, neighbours


def test_periods_bounds(spark):
    data = [(1, TS(2022, 5, 31, 23, 59, 59)), (1, TS(2022, 6, 1)), (1, TS(2022, 6, 30, 23, 59, 59)),
            (1, TS(2022, 6, 30, 23, 59, 59, 500000)), (2, None), (None, TS(2022, 6, 2))]
    df = spark.createDataFrame(data, "id int, t timestamp")
    periods = [Period("before", end=TS(2022, 6, 1)), Period("within", TS(2022, 6, 1), TS(2022, 6, 30, 23, 59, 59), closed=True)]
    found = period_snapshots(df, "id", "t", periods)
    assert rows(found, "period", "id", "t") == [
        ("before", 1, TS(2022, 5, 31, 23, 59, 59)), ("within", 1, TS(2022, 6, 30, 23, 59, 59)), ("within", None, TS(2022, 6, 2))]
    with pytest.raises(ValueError):
        period_snapshots(df, "id", "t", [Period("x"), Period("x")])


def test_periods_count_is_sum_per_period(spark):
    df = spark.range(300).select((F.col("id") % 13).alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("t"), "id")
    periods = [Period("a", end=TS(1970, 4, 1)), Period("b", TS(1970, 3, 1), TS(1970, 8, 1))]
    apart = [period_snapshots(df, "k", "t", [p]).count() for p in periods]
    assert period_snapshots(df, "k", "t", periods).count() == sum(apart)


def test_changed_values_ignores_null(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 5), (2, 6), (3, None), (None, 1), (None, 2)], "k int, price int")
    assert rows(changed_values(df, "k", "price")) == [(2,), (None,)]


def _timed(spark, n=600):
    return spark.range(n).select(
        F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("k"),
        F.when(F.col("id") % 17 > 0, (F.col("id") * 7919 % 101).cast("int")).alias("t"),
        F.when(F.col("id") % 4 > 0, F.col("id")).alias("v"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("s"),
        "id",
    )


@pytest.mark.parametrize("ranges", [1, 2, 7, 300])
@pytest.mark.parametrize("order", [["t", "id"], [desc("t"), "id"], [desc("s"), By("t", nulls_first=True), desc("id")]])
def test_neighbours_by_ranges_equal_plain_ones(spark, ranges, order):
    df = _timed(spark)
    plain = with_neighbours(df, ["k"], order, ["t", "v"])
    some = key_profile(df, ["k"], rows_per_task=100, max_keys=3)
    assert len(some.hot) == 3 and some.rows == 600
    ranged = with_neighbours(df, ["k"], order, ["t", "v"], some, ranges)
    assert rows(ranged, *plain.columns) == rows(plain)


def test_neighbours_of_a_key_with_all_rows(spark):
    """Ranges are even, also where all rows have one key; more ranges than rows and no rows are no trouble."""
    df = spark.range(20_000).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 10_007).alias("t"), "id").repartition(5)
    profile = KeyProfile(20_000, {1: 2})
    plain = with_neighbours(df, ["k"], ["t", "id"], ["id"], KeyProfile(20_000, {}))
    ranged = with_neighbours(df, ["k"], ["t", "id"], ["id"], profile, 8)
    assert rows(ranged, *plain.columns) == rows(plain)
    sizes = [r["count"] for r in with_range(df, ["k"], ["t", "id"], 8).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    few = df.filter("id < 3")
    assert rows(with_neighbours(few, ["k"], ["t"], ["id"], profile, 50), "id") == rows(with_neighbours(few, ["k"], ["t"], ["id"]), "id")
    assert rows(with_neighbours(df.filter("id < 0"), ["k"], ["t"], ["id"], profile, 50)) == []


def test_ties_are_spread(spark):
    """Best rows of each key, with ties and NULL keys, as a rank over whole keys gives them."""
    df = _timed(spark, 900).repartition(6)
    for keys, order in ((["k"], ["s"]), (["k", "s"], [desc("t"), "v"]), (["k"], [desc("s"), By("t", nulls_first=True)])):
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        plain = df.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")
        assert rows(top_rank(df, keys, order), "id") == rows(plain, "id")
    equal = spark.range(5000).select(F.lit(1).alias("k"), F.lit(2).alias("v"), "id").repartition(7)
    # As with millions of ties: rows are neither put together again nor sent to the few winners.
    few = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {c: spark.conf.get(c) for c in few}
    try:
        for c, v in few.items():
            spark.conf.set(c, v)
        spread = top_rank(equal, ["k"], [desc("v")])
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 5000 and len(sizes) > 3


def test_row_count(spark):
    assert rows(row_count(spark.range(7))) == [(7,)]
    assert rows(row_count(spark.range(0))) == [(0,)]


# column functions


def test_array_agg_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (1, "a"), (1, None), (2, None)], "k int, v string")
    got = {r.k: r.a for r in df.groupBy("k").agg(array_agg_nulls("v").alias("a")).collect()}
    assert got == {1: [None, None, "a", "b"], 2: [None]}
    assert df.filter("k > 5").agg(array_agg_nulls("v").alias("a")).collect()[0].a is None


def test_concat_distinct(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (3, "")], "k int, v string")
    got = {r.k: r.s for r in df.groupBy("k").agg(concat_distinct("v", ";").alias("s")).collect()}
    assert got == {1: "a;b", 2: None, 3: ""}


def test_year_week(spark):
    days = [D(2020, 12, 31), D(2021, 1, 1), D(2021, 1, 7), D(2021, 1, 8), D(2021, 12, 31), None]
    got = values(spark, [(d,) for d in days], "d date", year_week("d"))
    assert [r[0] for r in got] == ["2020-53", "2021-01", "2021-01", "2021-02", "2021-53", None]


def test_flags(spark):
    texts = ["1", "0", "t", "yes", "off", " ON ", "TRUE", None]
    got = values(spark, [(t,) for t in texts], "f string", to_flag("f"))
    assert [r[0] for r in got] == [True, False, True, True, False, True, True, None]
    assert values(spark, [("maybe",)], "f string", to_flag("f", strict=False)) == [(None,)]
    with pytest.raises(PySparkException):
        values(spark, [("maybe",)], "f string", to_flag("f"))


def test_contains_any_ignores_case(spark):
    got = values(spark, [("Двухкомнатная квартира",), ("дом",), (None,)], "t string", contains_any("t", ["КВАРТИР"]),
                 flag_if(contains_any("t", ["КВАРТИР", "гараж"])))
    assert got == [(True, 1), (False, 0), (None, 0)]


def test_days(spark):
    data = [("open", D(2022, 1, 1), TS(2022, 1, 5, 23)), ("shut", D(2022, 1, 1), TS(2022, 1, 5, 23)), (None, D(2022, 1, 1), None)]
    got = values(spark, data, "s string, c date, t timestamp", days_listed("s", "c", "t", F.lit(D(2022, 2, 1)), "open"),
                 day_gap_label("c", "t", "new"))
    assert got == [(31, "4"), (4, "4"), (None, "new")]


def test_outcomes(spark):
    got = values(spark, [("ok",), ("fine",), ("bad",), ("?",), (None,)], "r string", outcome_flag("r", ["ok", "fine"], ["bad"]))
    assert [r[0] for r in got] == [True, True, False, None, None]


def test_thinned_keeps_all_matches_and_few_others(spark):
    n = F.col("id")
    df = spark.range(0, 400_000, 1, 8).select((n % 200_000).alias("a"), F.concat(F.lit("k"), n % 7).alias("b"), n)
    df = df.withColumn("b", F.when(n % 11 > 0, F.col("b")))
    keys = df.filter("a % 40 = 3 AND b IS NOT NULL").select("a", "b").distinct()
    found = thinned(df, ["a", "b"], keys, rows=64)
    matches = df.join(keys, ["a", "b"], "left_semi")
    assert found.columns == df.columns and found.exceptAll(df).isEmpty() and matches.exceptAll(found.select(*matches.columns)).isEmpty()
    assert found.count() <= 1.05 * matches.count()
    assert thinned(df, ["a", "b"], keys.limit(0)).isEmpty()
    assert thinned(df, ["a", "b"], keys, rows=1).count() >= matches.count()  # too small a bitmap lets more through, loses none


def test_long_keys_are_shuffled_after_thinning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    df = spark.range(0, 100_000, 1, 8).select("id", (F.col("id") * 2).alias("x"))
    plan = key_filter(["id"], spark.range(0, 100_000, 20), broadcast_bytes=0)(df)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    big = plan[plan.rindex("BroadcastHashJoin") :]
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert "bitmap_construct_agg" in big and "getbit" in big and "hashpartitioning(id" in plan[: -len(big)]
