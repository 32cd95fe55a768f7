"""Orders as contracts, line items as their participants: returned `A` supplies, `R` is customer."""

from pyspark.sql import functions as F

from regmart.plans import contract_pairs, count_contract_pairs

from .tables import nation_regions, read, text


def _inputs(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    entities = supplier.join(nation_regions(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("spark_id"),
        F.col("n_name").alias("inn"),
        text("s_suppkey").alias("ogrn"),
        F.col("r_name").alias("kpp"),
        text("n_regionkey").alias("okopf_code"),
        F.col("s_name").alias("full_name_rus"),
    )
    participants = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("spark_id"),
        text("l_orderkey").alias("contract_code"),
        text("l_suppkey").alias("contract_participant_code"),
        F.when(F.col("l_returnflag") == "A", "2")
        .when(F.col("l_returnflag") == "R", "1")
        .otherwise("3")
        .alias("state_contract_role_code"),
    )
    participant_dict = supplier.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        text("s_suppkey").alias("code"),
        F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("participant_spark_id"),
        F.col("n_name").alias("participant_inn_code"),
        text("s_suppkey").alias("participant_ogrn_code"),
        F.lower("s_name").alias("participant_name"),
    )
    contracts = read(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("code"),
        F.col("o_orderdate").cast("date").alias("contract_date"),
        F.col("o_orderstatus").alias("currency_code"),
        F.col("o_totalprice").alias("contract_sum"),
        F.col("o_orderstatus").alias("federallaw_code"),
        F.col("o_orderpriority").alias("contract_subject_txt"),
    )
    companies = nation_regions(spark, sf_dir).filter("r_name in ('ASIA', 'EUROPE')").select("n_name", "r_name")
    return entities, participants, participant_dict, contracts, companies


def _contract_pairs(spark, sf_dir):
    return contract_pairs(*_inputs(spark, sf_dir))


def _count_contract_pairs(spark, sf_dir):
    return count_contract_pairs(*_inputs(spark, sf_dir))


QUERIES = {"contract_pairs": _contract_pairs, "count_contract_pairs": _count_contract_pairs}

ORACLE = {
    "contract_pairs": """
        WITH company AS (
          SELECT s_suppkey, s_name, s_acctbal, n_name, r_name, n_regionkey
          FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
        SELECT a.n_name AS inn, CAST(a.s_suppkey AS VARCHAR) AS ogrn, a.r_name AS kpp, b.n_name AS customer_inn,
               CAST(b.s_suppkey AS VARCHAR) AS customer_ogrn,
               CASE WHEN b.s_acctbal > 0 THEN b.r_name END AS customer_kpp,
               CASE WHEN b.s_acctbal > 0 THEN CAST(b.n_regionkey AS VARCHAR) END AS customer_okopf_code,
               CASE WHEN b.s_acctbal > 0 THEN b.s_name END AS full_name_rus, lower(b.s_name) AS short_name_rus,
               CAST(o_orderdate AS DATE) AS contract_date, o_orderstatus AS currency_code, o_totalprice AS contract_sum,
               o_orderstatus AS federallaw_code, o_orderpriority AS contract_subject_txt
        FROM orders
        JOIN lineitem x ON x.l_orderkey = o_orderkey AND x.l_returnflag = 'A'
        JOIN company a ON a.s_suppkey = x.l_suppkey AND a.r_name IN ('ASIA', 'EUROPE')
        JOIN lineitem y ON y.l_orderkey = o_orderkey AND y.l_returnflag = 'R'
        JOIN company b ON b.s_suppkey = y.l_suppkey AND b.r_name IN ('ASIA', 'EUROPE')
    """,
}
ORACLE["count_contract_pairs"] = f"SELECT count(*) AS row_count FROM ({ORACLE['contract_pairs']})"
