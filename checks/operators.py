"""Single operators and column functions."""

import datetime as dt

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
    Dim,
    Period,
    active_only,
    changed_values,
    desc,
    distinct_on,
    enrich,
    filter_keys,
    hot_join,
    key_filter,
    key_profile,
    latest_version,
    optional_key_lookup,
    period_snapshots,
    role_pairs,
    row_count,
    top_rank,
    with_neighbours,
)

from .tables import read, text


def _distinct_on(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    rest = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    return distinct_on(rows, ["l_partkey"], [desc("l_shipdate", nulls_first=False)], rest)


def _row_count(spark, sf_dir):
    return row_count(read(spark, sf_dir, "lineitem"))


def _latest_version(spark, sf_dir):
    return latest_version(
        read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", dt.date(1996, 1, 1), dt.date(1998, 12, 31), "o_orderdate"
    )


def _filter_keys(spark, sf_dir):
    keys = read(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select("p_partkey")
    return filter_keys(read(spark, sf_dir, "lineitem"), "l_partkey", keys)


def _filter_long_keys(spark, sf_dir):
    """As if the keys were too long to be sent: by bitmap and shuffled join. Orders with a key of two columns, of which some are NULL."""
    orders = read(spark, sf_dir, "orders")
    keys = orders.filter("o_totalprice > 250000").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")))
    lines = read(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return key_filter(["l_orderkey", "o_custkey"], keys, broadcast_bytes=0)(lines.drop("o_orderkey"))


def _active_only(spark, sf_dir):
    value = F.col("value")
    flagged = read(spark, sf_dir, "events").withColumn("deleted_flag", F.when(value > 2, value > 100))
    return active_only(flagged)


def _concat_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("late", F.when(F.col("l_quantity") > 25, F.col("l_linenumber")))
    return rows.groupBy("l_orderkey").agg(
        concat_distinct("l_returnflag").alias("flags"), concat_distinct("late", ";").alias("late_lines")
    )


def _array_agg_nulls(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_size") > 10, F.col("p_type")))
    arrays = rows.groupBy("p_brand").agg(array_agg_nulls("kind").alias("kinds"))
    shown = F.array_join(F.transform("kinds", lambda k: F.coalesce(k, F.lit("<null>"))), ",")
    return arrays.select("p_brand", shown.alias("kinds"), F.size("kinds").alias("n"))


def _year_week(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    weeks = read(spark, sf_dir, "lineitem").select(year_week(F.date_add(day, 1)).alias("week"))
    return weeks.groupBy("week").agg(F.count(F.lit(1)).alias("n"))


def _contains_any(spark, sf_dir):
    found = contains_any("p_name", ["Ring", "BOLT", "widget"])
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", found.alias("found"), flag_if(found).alias("flag"))


def _changed_values(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("odd_tax", F.when(F.col("l_quantity") > 10, F.col("l_tax")))
    return changed_values(rows, "l_orderkey", "odd_tax")


def _top_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("rebate", F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    best = top_rank(rows, ["l_suppkey", "l_returnflag"], [desc("rebate"), desc("l_quantity", nulls_first=False)])
    return best.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "rebate", "l_quantity")


def _enrich(spark, sf_dir):
    small = read(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    rows = enrich(
        read(spark, sf_dir, "lineitem"),
        [
            Dim(small, "l_suppkey", "s_suppkey", {"supplier": "s_name", "nationkey": "s_nationkey"}),
            Dim(read(spark, sf_dir, "nation"), "nationkey", "n_nationkey", {"nation": "n_name", "regionkey": "n_regionkey"}),
            Dim(read(spark, sf_dir, "part"), "l_partkey", "p_partkey", {"brand": "p_brand"}, "inner"),
        ],
    )
    return rows.groupBy("nation", "brand").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most"))


def _period_union(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    periods = [
        Period("early", end=dt.datetime(1997, 1, 1)),
        Period("middle", dt.datetime(1996, 6, 1), dt.datetime(1999, 6, 1)),
        Period("late", start=dt.datetime(1999, 6, 1)),
    ]
    return period_snapshots(rows, "o_custkey", "o_orderdate", periods, ["o_orderkey"])


def _role_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", "l_linenumber")
    return role_pairs(rows, "l_orderkey", "l_returnflag", "A", "R")


def _neighbours(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    frequent = key_profile(rows, ["user_id"], rows_per_task=60)
    return with_neighbours(rows, ["user_id"], ["ts", "event_id"], ["ts", "value"], frequent, ranges=16)


def _optional_keys(spark, sf_dir):
    """Requests as a table: the highest and lowest key combinations of the orders, one key left open in turn."""
    orders = read(spark, sf_dir, "orders").select(
        text("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    names = ["customer", "status", "priority"]
    ends = orders.agg(F.max(F.struct(*names)).alias("hi"), F.min(F.struct(*names)).alias("lo"))
    requests = ends.select(F.col("hi.customer"), F.lit("").alias("status"), F.lit("").alias("priority")).union(
        ends.select(F.lit(""), F.col("lo.status"), F.col("lo.priority"))
    )
    return optional_key_lookup(orders, requests, names)


def _hot_join(spark, sf_dir):
    """Left join to the frequent side, with every frequent key spread."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey")
    return hot_join(lines, parts, ["p_partkey"], "one_outer", rows_per_task=20, max_salts=4)


def _scalar_functions(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    as_of = F.lit(dt.date(2002, 1, 1))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("(none)")).alias("status"),
        F.upper(F.lower("o_orderpriority")).alias("upper_priority"),
        text("o_custkey").substr(1, 255).alias("customer_txt"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority_no"),
        F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd").alias("order_day"),
        F.date_add(day, 1).alias("next_day"),
        F.year("o_orderdate").alias("order_year"),
        year_week(day).alias("week"),
        days_listed("o_orderstatus", day, F.date_add(day, 30), as_of, "O").alias("days"),
        day_gap_label(F.when(F.col("o_orderstatus") != "F", day), as_of, "new").alias("gap"),
        to_flag(F.when(F.col("o_orderstatus") == "O", "yes").when(F.col("o_orderstatus") == "F", "off")).alias("flag"),
        to_flag("o_orderpriority", strict=False).alias("no_flag"),
        outcome_flag("o_orderstatus", ["F", "O"], ["P"]).alias("outcome"),
    )


def _predicates(spark, sf_dir):
    """Equality, OR, ordered comparison, BETWEEN, IN list, LIKE, IS NULL, negated flag, both CASE forms, constants."""
    rows = read(spark, sf_dir, "lineitem").withColumn("rebate", F.when(F.col("l_discount") > 0.03, F.col("l_discount")))
    flag = F.col("l_returnflag")
    kept = rows.filter(
        (flag.isin("A", "R") | (F.col("l_linenumber") == 3))
        & F.col("l_quantity").between(5, 40)
        & (F.col("l_shipdate") > F.lit(dt.date(1996, 1, 1)))
        & ~(F.col("l_tax") >= 0.07)
        & (F.col("rebate").isNotNull() | F.col("l_linestatus").like("%F%"))
    )
    return kept.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rebate", F.lit(True).alias("status"),
        F.when(flag == "A", "first").when(flag == "R", "second").alias("simple"),
        F.when(F.col("l_quantity") < 10, "few").when(F.col("l_quantity") < 30, "some").otherwise("many").alias("searched"),
    )


def _grouped_counts(spark, sf_dir):
    """The aggregates the jobs use, per group, with a filter on a distinct count and a global one beside it."""
    rows = read(spark, sf_dir, "lineitem")
    return (
        rows.groupBy("l_suppkey", "l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("l_extendedprice").alias("highest"),
            F.min("l_linenumber").alias("lowest_line"),
            F.sum(flag_if(F.col("l_linestatus") == "F")).alias("finished"),
            F.count_distinct("l_partkey").alias("parts"),
        )
        .filter("parts > 1")
    )


def _union_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("party"), F.lit("order").alias("kind"))
    events = read(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("user_id").alias("party"))
    return orders.unionByName(events).groupBy("party", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "distinct_on": _distinct_on,
    "row_count": _row_count,
    "latest_version": _latest_version,
    "filter_keys": _filter_keys,
    "filter_long_keys": _filter_long_keys,
    "active_only": _active_only,
    "concat_distinct": _concat_distinct,
    "array_agg_nulls": _array_agg_nulls,
    "year_week": _year_week,
    "contains_any": _contains_any,
    "changed_values": _changed_values,
    "top_rank": _top_rank,
    "enrich": _enrich,
    "overlapping_periods": _period_union,
    "role_pairs": _role_pairs,
    "neighbours": _neighbours,
    "optional_key_lookup": _optional_keys,
    "left_join_frequent_keys": _hot_join,
    "scalar_functions": _scalar_functions,
    "predicates": _predicates,
    "grouped_aggregates": _grouped_counts,
    "union_all": _union_rows,
}

ORACLE = {
    "distinct_on": """
        SELECT * FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_suppkey,
                l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1
    """,
    "row_count": "SELECT count(*) AS row_count FROM lineitem",
    "latest_version": """
        WITH windowed AS (
          SELECT * FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1998-12-31')
        SELECT * FROM windowed w
        WHERE o_orderdate = (SELECT max(o_orderdate) FROM windowed x WHERE x.o_custkey = w.o_custkey)
    """,
    "filter_long_keys": """
        SELECT l.*, o_custkey FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
        WHERE o_totalprice > 250000 AND o_orderkey % 5 > 0""",
    "filter_keys": "SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')",
    "active_only": """
        SELECT *, false AS deleted_flag FROM events WHERE value > 2 AND value <= 100
    """,
    "concat_distinct": """
        SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
               string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ';' ORDER BY CAST(l_linenumber AS VARCHAR))
                 FILTER (l_quantity > 25) AS late_lines
        FROM lineitem GROUP BY l_orderkey
    """,
    "array_agg_nulls": """
        SELECT p_brand, string_agg(coalesce(kind, '<null>'), ',' ORDER BY kind NULLS FIRST) AS kinds,
               CAST(count(*) AS INTEGER) AS n
        FROM (SELECT p_brand, CASE WHEN p_size > 10 THEN p_type END AS kind FROM part) GROUP BY p_brand
    """,
    "year_week": """
        SELECT printf('%04d-%02d', year(d), (dayofyear(d) - 1) // 7 + 1) AS week, count(*) AS n
        FROM (SELECT CAST(l_shipdate AS DATE) + 1 AS d FROM lineitem) GROUP BY 1
    """,
    "contains_any": """
        SELECT p_partkey, p_name, regexp_matches(p_name, 'ring|bolt|widget', 'i') AS found,
               CAST(regexp_matches(p_name, 'ring|bolt|widget', 'i') AS INTEGER) AS flag
        FROM part
    """,
    "changed_values": """
        SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey HAVING count(DISTINCT l_tax) > 1
    """,
    "top_rank": """
        WITH rebated AS (SELECT *, CASE WHEN l_discount > 0.02 THEN l_discount END AS rebate FROM lineitem)
        SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey, rebate, l_quantity FROM rebated
        QUALIFY rank() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY rebate DESC NULLS FIRST,
                l_quantity DESC NULLS LAST) = 1
    """,
    "enrich": """
        SELECT n_name AS nation, p_brand AS brand, count(*) AS n, max(l_quantity) AS most
        FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
        LEFT JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey
        GROUP BY n_name, p_brand
    """,
    "overlapping_periods": """
        WITH tagged AS (
          SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, 'early' AS period
          FROM orders WHERE o_orderdate < DATE '1997-01-01'
          UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, 'middle'
          FROM orders WHERE o_orderdate >= DATE '1996-06-01' AND o_orderdate < DATE '1999-06-01'
          UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, 'late'
          FROM orders WHERE o_orderdate >= DATE '1999-06-01')
        SELECT * FROM tagged
        QUALIFY row_number() OVER (PARTITION BY period, o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1
    """,
    "role_pairs": """
        SELECT a.l_orderkey, a.l_returnflag, a.l_suppkey, a.l_linenumber, b.l_returnflag AS l_returnflag_2,
               b.l_suppkey AS l_suppkey_2, b.l_linenumber AS l_linenumber_2
        FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey
        WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'
    """,
    "neighbours": """
        SELECT event_id, user_id, ts, value, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value,
               lead(ts) OVER w AS next_ts, lead(value) OVER w AS next_value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
    "optional_key_lookup": """
        WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, o_orderpriority AS priority
                   FROM orders),
        ends AS (SELECT max({'a': customer, 'b': status, 'c': priority}) AS hi,
                        min({'a': customer, 'b': status, 'c': priority}) AS lo FROM o)
        SELECT hi.a AS request_customer, '' AS request_status, '' AS request_priority, o.* FROM o, ends
        WHERE customer = hi.a
        UNION ALL
        SELECT '', lo.b, lo.c, o.* FROM o, ends WHERE status = lo.b AND priority = lo.c
    """,
    "left_join_frequent_keys": """
        SELECT p_partkey, p_brand, l_orderkey, l_linenumber, l_suppkey FROM part
        LEFT JOIN lineitem ON l_partkey = p_partkey
    """,
    "scalar_functions": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '(none)' ELSE o_orderstatus END AS status,
               o_orderpriority AS upper_priority, CAST(o_custkey AS VARCHAR) AS customer_txt,
               CAST(o_orderpriority[1] AS BIGINT) AS priority_no, CAST(o_orderdate AS DATE) AS order_day,
               CAST(o_orderdate AS DATE) + 1 AS next_day, CAST(year(o_orderdate) AS INTEGER) AS order_year,
               printf('%04d-%02d', year(o_orderdate), (dayofyear(o_orderdate) - 1) // 7 + 1) AS week,
               CAST(CASE WHEN o_orderstatus = 'O' THEN DATE '2002-01-01' - CAST(o_orderdate AS DATE) ELSE 30 END
                    AS INTEGER) AS days,
               CASE WHEN o_orderstatus = 'F' THEN 'new'
                    ELSE CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS VARCHAR) END AS gap,
               CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS flag, CAST(NULL AS BOOLEAN) AS no_flag,
               o_orderstatus <> 'P' AS outcome
        FROM orders
    """,
    "predicates": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0.03 THEN l_discount END AS rebate,
               true AS status, CASE l_returnflag WHEN 'A' THEN 'first' WHEN 'R' THEN 'second' END AS simple,
               CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS searched
        FROM lineitem
        WHERE (l_returnflag IN ('A', 'R') OR l_linenumber = 3) AND l_quantity BETWEEN 5 AND 40
          AND l_shipdate > DATE '1996-01-01' AND NOT l_tax >= 0.07::DOUBLE
          AND (l_discount > 0.03 OR l_linestatus LIKE '%F%')
    """,
    "grouped_aggregates": """
        SELECT l_suppkey, l_returnflag, count(*) AS n, max(l_extendedprice) AS highest, min(l_linenumber) AS lowest_line,
               CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS finished, count(DISTINCT l_partkey) AS parts
        FROM lineitem GROUP BY l_suppkey, l_returnflag HAVING count(DISTINCT l_partkey) > 1
    """,
    "union_all": """
        SELECT party, kind, count(*) AS n
        FROM (SELECT o_custkey AS party, 'order' AS kind FROM orders
              UNION ALL SELECT user_id, 'event' FROM events) GROUP BY party, kind
    """,
}
