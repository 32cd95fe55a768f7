"""Orders as deals, customers as realty, line items as documents and shares."""

import datetime as dt

from pyspark.sql import functions as F

from regmart.plans import count_deal_listing, deal_listing, deal_rollup, property_register

from .tables import read, text

AS_OF = dt.date(2024, 2, 15)


def _property_register(spark, sf_dir):
    realty = read(spark, sf_dir, "lineitem").select(
        text("l_partkey").alias("cadastral_num"),
        F.col("l_returnflag").alias("realty_type_bkh"),
        text("l_suppkey").alias("region_code"),
    )
    return property_register(realty, AS_OF)


def _deals(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("bkh"),
        text("o_custkey").alias("realty_bkh"),
        F.col("o_orderdate").cast("date").alias("registration_date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("cancel_date"),
        F.col("o_orderstatus").alias("region_code"),
        text("o_custkey").alias("deal_num"),
        F.col("o_totalprice").alias("deal_price_amt"),
        text("o_totalprice").alias("deal_price_txt"),
        F.col("o_orderpriority").alias("subject_description"),
        F.concat_ws(" ", "o_orderstatus", F.lower("o_orderpriority")).alias("deal_condition_txt"),
    )


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_suppkey", "l_linenumber").alias("bkh"),
        text("l_orderkey").alias("reference_bkh"),
        F.col("l_returnflag").alias("cadastral_doc_type_bkh"),
        F.concat_ws("", "l_linestatus", "l_linenumber").alias("cadastral_doc_addition_txt"),
        text("l_suppkey").alias("cadastral_doc_num"),
        F.col("l_linenumber"),
    )


def _shares(spark, sf_dir):
    return (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", "l_linenumber", "l_partkey").alias("bkh"),
            text("l_orderkey").alias("reference_bkh"),
            F.when(F.col("p_size") > 10, F.col("p_name")).alias("ods_description"),
            F.col("p_brand").alias("transfer_deadline_txt"),
        )
    )


def _deal_rollup(spark, sf_dir):
    realty = read(spark, sf_dir, "customer").select(
        text("c_custkey").alias("bkh"),
        F.when(F.col("c_acctbal") >= 0, F.concat_ws(":", "c_nationkey", "c_mktsegment")).alias("cadastral_num"),
    )
    rows = deal_rollup(
        _deals(spark, sf_dir),
        _docs(spark, sf_dir),
        realty,
        _shares(spark, sf_dir),
        since=dt.date(1996, 1, 1),
        doc_type="R",
        living_words=["urgent"],
        escrow_words=["High", "LOW"],
    )
    descriptions = F.transform("agg_ods_description", lambda d: F.coalesce(d, F.lit("<null>")))
    return rows.withColumn("agg_ods_description", F.array_join(descriptions, "|"))


def _listing_inputs(spark, sf_dir):
    realty = read(spark, sf_dir, "customer").select(
        text("c_custkey").alias("bkh"),
        F.col("c_name").alias("cadastral_num"),
        F.col("c_mktsegment").alias("room_number_txt"),
        F.col("c_name").alias("room_name"),
        text("c_nationkey").alias("floor_number_txt"),
        F.col("c_mktsegment").alias("plan_number_txt"),
        F.col("c_acctbal").alias("room_area_amt"),
    )
    docs = _docs(spark, sf_dir).withColumn("cadastral_doc_type_bkh", F.concat(F.lit("T"), text("l_linenumber")))
    types = (
        read(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("T"), text("l_linenumber")).alias("bkh"), text("l_linenumber").alias("cadastral_doc_type_code")
        )
        .distinct()
    )
    addresses = (
        read(spark, sf_dir, "customer")
        .select(text("c_custkey").alias("realty_bkh"), text("c_nationkey").alias("realty_region_bkh"))
        .union(
            read(spark, sf_dir, "events").select(text("user_id"), F.hour("ts").cast("string"))
        )
    )
    regions = (
        read(spark, sf_dir, "nation")
        .select(text("n_nationkey").alias("bkh"))
        .union(read(spark, sf_dir, "region").select(text("r_regionkey")))
    )
    return realty, _deals(spark, sf_dir), docs, types, _shares(spark, sf_dir), addresses, regions, 1, 1998


def _deal_listing(spark, sf_dir):
    return deal_listing(*_listing_inputs(spark, sf_dir), AS_OF)


def _count_deal_listing(spark, sf_dir):
    return count_deal_listing(*_listing_inputs(spark, sf_dir))


QUERIES = {
    "property_register": _property_register,
    "deal_rollup": _deal_rollup,
    "deal_listing": _deal_listing,
    "count_deal_listing": _count_deal_listing,
}

ORACLE = {
    "property_register": """
        WITH ranked AS (
          SELECT CAST(l_partkey AS VARCHAR) AS cadastral_num, l_returnflag AS realty_type_bkh,
                 CAST(l_suppkey AS VARCHAR) AS region_code,
                 row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, CAST(l_suppkey AS VARCHAR)) AS rn
          FROM lineitem)
        SELECT cadastral_num, realty_type_bkh, region_code, DATE '2024-02-15' AS create_dt FROM ranked WHERE rn = 1
    """,
    "deal_rollup": """
        WITH joined AS (
          SELECT CASE WHEN c.c_acctbal >= 0 THEN concat(c.c_nationkey, ':', c.c_mktsegment) END AS cadastral_num,
                 CAST(o.o_orderdate AS DATE) AS registration_date,
                 CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) END AS cancel_date,
                 o.o_orderstatus AS region_code, CAST(o.o_custkey AS VARCHAR) AS deal_num,
                 concat(d.l_linestatus, d.l_linenumber) AS doc_txt, o.o_totalprice AS price,
                 o.o_orderpriority AS subject, CAST(o.o_orderkey AS VARCHAR) AS deal_bkh,
                 concat(d.l_suppkey, '-', d.l_linenumber) AS doc_bkh,
                 concat(s.l_linenumber, '-', s.l_partkey) AS share_bkh,
                 coalesce(CASE WHEN p.p_size > 10 THEN p.p_name END, o.o_orderpriority) AS ods,
                 CASE WHEN p.p_size > 10 THEN 0 ELSE 1 END AS ods_is_null,
                 CASE WHEN o.o_orderpriority LIKE '%URGENT%' THEN 1 ELSE 0 END AS living,
                 CASE WHEN o.o_orderpriority LIKE '%HIGH%' OR o.o_orderpriority LIKE '%LOW%' THEN 1 ELSE 0 END AS escrow,
                 printf('%04d-%02d', year(o.o_orderdate + INTERVAL 1 DAY),
                        (dayofyear(o.o_orderdate + INTERVAL 1 DAY) - 1) // 7 + 1) AS wk
          FROM orders o
          JOIN lineitem d ON d.l_orderkey = o.o_orderkey AND d.l_returnflag = 'R'
          LEFT JOIN customer c ON c.c_custkey = o.o_custkey
          LEFT JOIN lineitem s ON s.l_orderkey = o.o_orderkey
          LEFT JOIN part p ON p.p_partkey = s.l_partkey
          WHERE CAST(o.o_orderdate AS DATE) > DATE '1996-01-01'),
        per_week AS (
          SELECT * FROM joined
          QUALIFY row_number() OVER (PARTITION BY ods, region_code, wk ORDER BY cadastral_num NULLS LAST, deal_num,
                  doc_txt, deal_bkh, doc_bkh, share_bkh, ods_is_null) = 1),
        per_deal AS (
          SELECT cadastral_num, region_code, registration_date, cancel_date, deal_num, subject, living, escrow, doc_txt,
                 max(price) AS price, string_agg(ods, '|' ORDER BY ods) AS descriptions, count(*) AS cnt,
                 sum(ods_is_null) AS nulls
          FROM per_week GROUP BY ALL),
        per_document AS (
          SELECT * FROM per_deal
          QUALIFY row_number() OVER (PARTITION BY doc_txt, cadastral_num, registration_date ORDER BY region_code,
                  cancel_date NULLS LAST, deal_num, subject, living, escrow) = 1)
        SELECT descriptions AS agg_ods_description, doc_txt AS cadastral_doc_addition_txt, cadastral_num, cancel_date,
               CAST(cnt AS BIGINT) AS cnt_ods_description, deal_num, price AS deal_price_amt, escrow, living,
               region_code, registration_date, subject AS subject_description, CAST(nulls AS BIGINT) AS sum_ods_is_null
        FROM per_document
        QUALIFY row_number() OVER (PARTITION BY deal_num ORDER BY cadastral_num NULLS LAST, registration_date, doc_txt,
                region_code, cancel_date NULLS LAST, subject, living, escrow) = 1
    """,
    "deal_listing": """
        WITH addresses AS (
          SELECT c_custkey AS realty, c_nationkey AS region FROM customer
          UNION ALL SELECT user_id, hour(ts) FROM events),
        regions AS (SELECT n_nationkey AS bkh FROM nation UNION ALL SELECT r_regionkey FROM region)
        SELECT CAST(c.c_custkey AS VARCHAR) AS realty_bkh, CAST(o.o_orderkey AS VARCHAR) AS deal_bkh,
               concat(s.l_linenumber, '-', s.l_partkey) AS ods_bkh, o.o_orderstatus AS region_code,
               c.c_name AS cadastral_num, CAST(d.l_suppkey AS VARCHAR) AS cadastral_doc_num,
               CAST(o.o_orderdate AS DATE) AS registration_date,
               CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) END AS cancel_date,
               CAST(o.o_custkey AS VARCHAR) AS deal_num,
               o.o_orderstatus || ' ' || lower(o.o_orderpriority) AS deal_condition_txt,
               o.o_orderpriority AS subject_description,
               CASE WHEN p.p_size > 10 THEN p.p_name END AS ods_description,
               CAST(o.o_totalprice AS VARCHAR) AS deal_price_txt, o.o_totalprice AS deal_price_amt,
               c.c_mktsegment AS room_number_txt, c.c_name AS room_name, CAST(c.c_nationkey AS VARCHAR) AS floor_number_txt,
               c.c_mktsegment AS plan_number_txt, c.c_acctbal AS room_area_amt, p.p_brand AS transfer_deadline_txt,
               DATE '2024-02-15' AS create_dt
        FROM orders o
        JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN lineitem d ON d.l_orderkey = o.o_orderkey AND d.l_linenumber = 1
        LEFT JOIN lineitem s ON s.l_orderkey = o.o_orderkey
        LEFT JOIN part p ON p.p_partkey = s.l_partkey
        LEFT JOIN addresses a ON a.realty = c.c_custkey
        LEFT JOIN regions r ON r.bkh = a.region
        WHERE year(o.o_orderdate) >= 1998
    """,
}
ORACLE["count_deal_listing"] = f"SELECT count(*) AS row_count FROM ({ORACLE['deal_listing']})"
