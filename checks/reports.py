"""Orders as accounting reports, customers as the companies in scope."""

import datetime as dt

from pyspark.sql import functions as F

from regmart.plans import latest_report_lines, report_extract

from .tables import read, text


def _reports(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("accounting_report_id"),
        text("o_custkey").alias("bk_hash"),
        F.col("o_custkey").alias("spark_id"),
        F.col("o_orderstatus").alias("balance_type"),
        F.col("o_orderstatus").alias("accounting_period_code"),
        F.col("o_orderpriority").alias("form_name"),
        F.col("o_orderstatus").alias("financial_indicator_code"),
        F.col("o_orderdate").alias("valid_from"),
        F.col("o_orderpriority").alias("section_name"),
        F.col("o_orderpriority").alias("line_code"),
        F.lower("o_orderpriority").alias("line_name"),
        F.col("o_totalprice").alias("line_value"),
        (F.col("o_orderstatus") != "F").alias("deleted_flag"),
    )


def _report_extract(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return report_extract(_reports(spark, sf_dir), keys)


def _latest_report_lines(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    nations = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("spark_id"), text("c_nationkey").alias("accounting_period_code")
    )
    actual = reports.drop("accounting_period_code").join(nations, "spark_id")
    scope = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("spark_id"))
    periods = read(spark, sf_dir, "nation").select(text("n_nationkey").alias("code"), F.col("n_name").alias("period_name"))
    return latest_report_lines(
        reports, actual, scope, periods, dt.date(1996, 4, 1), dt.date(1999, 4, 18), line_code="1-URGENT"
    )


QUERIES = {"report_extract": _report_extract, "latest_report_lines": _latest_report_lines}

ORACLE = {
    "report_extract": """
        SELECT o_custkey AS spark_id, o_orderstatus AS balance_type, o_orderstatus AS accounting_period_code,
               o_orderpriority AS form_name, o_orderstatus AS financial_indicator_code, o_orderdate AS valid_from,
               o_orderpriority AS section_name, o_orderpriority AS line_code, lower(o_orderpriority) AS line_name,
               o_totalprice AS line_value, false AS deleted_flag
        FROM orders
        WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
    "latest_report_lines": """
        WITH newest AS (
          SELECT max(o_orderkey) AS id FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
          WHERE o_orderdate BETWEEN DATE '1996-04-01' AND DATE '1999-04-18' GROUP BY o_custkey)
        SELECT CAST(o_custkey AS VARCHAR) AS bk_hash, o_custkey AS spark_id, o_orderstatus AS balance_type,
               n_name AS period_name, o_orderpriority AS form_name, o_orderstatus AS financial_indicator_code,
               true AS status, o_orderpriority AS section_name, o_orderpriority AS line_code,
               lower(o_orderpriority) AS line_name, o_totalprice AS line_value
        FROM orders JOIN newest ON id = o_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey
        WHERE o_orderpriority = '1-URGENT'
    """,
}
