"""Customers as checked companies, suppliers as list entries."""

import datetime as dt

from pyspark.sql import functions as F

from regmart.functions.table_functions import register_table_functions
from regmart.operators import repeated
from regmart.plans import counterparty_check, include_list
from regmart.plans.flags import RISK_FLAGS

from regmart.sources import SCHEMAS

from .tables import customer_places, nation_regions, read, text

# Each flag holds when the balance is below its threshold: 0 for the first flag, 400 for the second, and so on.
_STEP = 400
_RESULTS = {"BUILDING": "RED FLAG", "MACHINERY": "GREEN FLAG", "FURNITURE": "APPROVAL", "HOUSEHOLD": "UNKNOWN"}
REQUESTS = [("NATION_3", "", ""), ("", "", "EUROPE"), ("NATION_4", "Supplier#000000007", ""), ("", "", "ASIA")]


def _counterparty_check(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    result = F.col("c_mktsegment")
    outcome = F.lit(None).cast("string")
    for segment, name in _RESULTS.items():
        outcome = F.when(result == segment, name).otherwise(outcome)
    checks = customer.select(
        F.col("c_custkey").alias("spark_id"),
        text("c_custkey").alias("inn"),
        F.col("c_name").alias("ogrn"),
        text("c_nationkey").alias("kpp"),
        text("c_nationkey").alias("okfs_code"),
        F.col("c_mktsegment").alias("okfs_name"),
        F.lower("c_mktsegment").alias("okopf_name"),
        F.col("c_name").alias("full_name_rus"),
        F.lower("c_name").alias("short_name_rus"),
        F.col("c_mktsegment").alias("status_name"),
        F.lit(dt.date(2020, 1, 1)).alias("first_registration_date"),
        F.col("c_acctbal").alias("revenue"),
        F.col("c_acctbal").alias("net_profit"),
        F.col("c_acctbal").alias("net_assets"),
        *[F.when(F.col("c_acctbal") < i * _STEP, "1").otherwise("0").alias(f) for i, f in enumerate(RISK_FLAGS)],
        F.col("c_nationkey").alias("report_year"),
        outcome.alias("check_result"),
        F.col("c_acctbal").alias("lim_calc"),
    )
    keys = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(text("o_custkey"))
    return counterparty_check(checks, keys)


def _lists(spark, sf_dir):
    return (
        read(spark, sf_dir, "supplier")
        .join(nation_regions(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("r_name").alias("list_name"),
            (F.col("s_acctbal") < 0).alias("is_negative"),
            F.lower("r_name").alias("status_name"),
            F.lower("s_name").alias("full_name_rus"),
            F.col("n_name").alias("inn"),
            F.col("s_name").alias("ogrn"),
            F.col("r_name").alias("kpp"),
        )
    )


def _include_list(spark, sf_dir):
    return include_list(_lists(spark, sf_dir), REQUESTS)


def _requests_of(spark, sf_dir):
    """Requests from the customers: by name of nation, by region with the name of a supplier of the same number, and by nothing at all."""
    by_nation = customer_places(spark, sf_dir).filter("c_acctbal < 0").select(
        F.col("n_name").alias("inn"), F.lit("").alias("ogrn"), F.when(F.col("c_custkey") % 2 == 0, F.col("r_name")).otherwise("").alias("kpp")
    )
    by_name = read(spark, sf_dir, "supplier").join(nation_regions(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(""), "s_name", F.when(F.col("s_suppkey") % 2 == 0, "EUROPE").otherwise("")
    )
    nothing = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.lit(""), F.lit(""), F.lit(""))
    return by_nation.union(by_name).union(nothing)


def _include_list_table(spark, sf_dir):
    return include_list(_lists(spark, sf_dir), _requests_of(spark, sf_dir))


def _include_list_lateral(spark, sf_dir):
    """The same lookups through the SQL table function, called for each different row of a table; what equal rows find is repeated last."""
    names = [c.split()[0] for c in SCHEMAS["include_lists"].split(", ")]
    _lists(spark, sf_dir).select(*names).createOrReplaceTempView("include_lists")
    _requests_of(spark, sf_dir).createOrReplaceTempView("include_requests")
    register_table_functions(spark, ["include_list"])
    found = spark.sql(
        "SELECT r.inn AS request_inn, r.ogrn AS request_ogrn, r.kpp AS request_kpp, l.*, r.times "
        "FROM (SELECT inn, ogrn, kpp, count(*) AS times FROM include_requests GROUP BY ALL) r, LATERAL include_list(r.inn, r.ogrn, r.kpp) l"
    )
    return repeated(found, "times", found.agg(F.sum("times")).first()[0] or 0)


QUERIES = {
    "counterparty_check": _counterparty_check,
    "include_list": _include_list,
    "include_list_table": _include_list_table,
    "include_list_lateral": _include_list_lateral,
}

_FLAG_SQL = ", ".join(f"CAST(CASE WHEN c_acctbal < {i * _STEP} THEN '1' ELSE '0' END AS BOOLEAN) AS {f}"
                      for i, f in enumerate(RISK_FLAGS))
_REQUEST_SQL = ", ".join(str(r) for r in REQUESTS)

ORACLE = {
    "counterparty_check": f"""
        SELECT c_custkey AS spark_id, CAST(c_custkey AS VARCHAR) AS inn, c_name AS ogrn,
               CAST(c_nationkey AS VARCHAR) AS kpp, CAST(c_nationkey AS VARCHAR) AS okfs_code, c_mktsegment AS okfs_name,
               lower(c_mktsegment) AS okopf_name, c_name AS full_name_rus, lower(c_name) AS short_name_rus,
               c_mktsegment AS status_name, DATE '2020-01-01' AS first_registration_date, c_acctbal AS revenue,
               c_acctbal AS net_profit, c_acctbal AS net_assets, {_FLAG_SQL}, c_nationkey AS report_year,
               CASE c_mktsegment WHEN 'BUILDING' THEN false WHEN 'MACHINERY' THEN true WHEN 'FURNITURE' THEN true
                    END AS check_res,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'RED FLAG' WHEN 'MACHINERY' THEN 'GREEN FLAG'
                    WHEN 'FURNITURE' THEN 'APPROVAL' WHEN 'HOUSEHOLD' THEN 'UNKNOWN' END AS check_result,
               c_acctbal AS lim_calc
        FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    """,
    "include_list": f"""
        SELECT q.inn AS request_inn, q.ogrn AS request_ogrn, q.kpp AS request_kpp, r_name AS list_name,
               s_acctbal < 0 AS is_negative, lower(r_name) AS status_name, lower(s_name) AS full_name_rus,
               n_name AS inn, s_name AS ogrn, r_name AS kpp
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
        JOIN (VALUES {_REQUEST_SQL}) q(inn, ogrn, kpp)
          ON q.inn IN ('', n_name) AND q.ogrn IN ('', s_name) AND q.kpp IN ('', r_name)
    """,
}
_TABLE_SQL = """
        (SELECT n_name AS inn, '' AS ogrn, CASE WHEN c_custkey % 2 = 0 THEN r_name ELSE '' END AS kpp
         FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal < 0
         UNION ALL
         SELECT CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE '' END, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'EUROPE' ELSE '' END
         FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
         UNION ALL SELECT '', '', '' FROM region WHERE r_regionkey < 2)"""
ORACLE["include_list_table"] = ORACLE["include_list"].replace(f"(VALUES {_REQUEST_SQL})", _TABLE_SQL)
ORACLE["include_list_lateral"] = ORACLE["include_list_table"]
