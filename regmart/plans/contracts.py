"""State contracts between suppliers and customers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filter_key_tuples, filter_keys, hot_join, hot_keys

# Contract roles.
SUPPLIER_ROLE = "2"
CUSTOMER_ROLE = "1"


def contract_pairs(
    entities: DataFrame,
    participants: DataFrame,
    participant_dict: DataFrame,
    contracts: DataFrame,
    company_keys: DataFrame | Iterable[tuple[str, str]],
) -> DataFrame:
    """Contracts on which a company of `company_keys` (INN, KPP) supplies another entry of those companies, with
    both parties' details. All given companies form one set: either party may be any of them."""
    companies = filter_key_tuples(entities, ["inn", "kpp"], company_keys).select("spark_id", "inn", "ogrn", "kpp")
    parties = filter_keys(participants, "spark_id", companies.select("spark_id")).select(
        "contract_code", "spark_id", "contract_participant_code", "state_contract_role_code"
    )
    role = F.col("state_contract_role_code")
    registered = participant_dict.select(
        F.col("code").alias("contract_participant_code"), F.col("participant_inn_code").alias("inn")
    )
    suppliers = (
        parties.filter(role == SUPPLIER_ROLE)
        .select("contract_code", "spark_id", "contract_participant_code")
        .join(companies, "spark_id")
        .join(registered, ["contract_participant_code", "inn"])
        .select("contract_code", "inn", "ogrn", "kpp")
    )
    customers = parties.filter(role == CUSTOMER_ROLE).select(
        "contract_code", F.col("contract_participant_code").alias("customer_code")
    )
    # Either side may hold a third of all rows in one contract: supplier rows are spread, customer rows repeated.
    pairs = hot_join(suppliers, customers, ["contract_code"], hot=hot_keys(participants, ["contract_code"]))
    customer_details = participant_dict.select(
        F.col("code").alias("customer_code"),
        F.col("participant_spark_id").alias("customer_spark_id"),
        F.col("participant_inn_code").alias("customer_inn"),
        F.col("participant_ogrn_code").alias("customer_ogrn"),
        F.col("participant_name").alias("short_name_rus"),
    )
    customer_entities = entities.select(
        F.col("spark_id").alias("customer_spark_id"),
        F.col("kpp").alias("customer_kpp"),
        F.col("okopf_code").alias("customer_okopf_code"),
        "full_name_rus",
    )
    terms = contracts.select(
        F.col("code").alias("contract_code"), "contract_date", "currency_code", "contract_sum", "federallaw_code",
        "contract_subject_txt",
    )
    return (
        pairs.join(customer_details, "customer_code")
        .join(customer_entities, "customer_spark_id", "left")
        .join(terms, "contract_code")
        .select(
            "inn", "ogrn", "kpp", "customer_inn", "customer_ogrn", "customer_kpp", "customer_okopf_code",
            "full_name_rus", "short_name_rus", "contract_date", "currency_code", "contract_sum", "federallaw_code",
            "contract_subject_txt",
        )
    )
