"""`SELECT count(*) FROM (job)` of the jobs whose joins multiply rows, from per-key counts alone.

Each function takes the job's arguments and gives what `row_count(job(...))` gives, without a pair, copy or wide row being built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import active_only, filter_key_tuples, filter_keys, key_filter
from ..operators.counting import Counts
from .adverts import AGENCIES, AdvertTables, Keys, _pick, best_adverts
from .contracts import CUSTOMER_ROLE, SUPPLIER_ROLE
from .deals import LISTING_DOC_TYPE_CODE


def count_contract_pairs(
    entities: DataFrame,
    participants: DataFrame,
    participant_dict: DataFrame,
    contracts: DataFrame,
    company_keys: DataFrame | Iterable[tuple[str, str]],
) -> DataFrame:
    """The number of rows of `contract_pairs`: per contract its suppliers times its customers times its entries."""
    companies = filter_key_tuples(entities, ["inn", "kpp"], company_keys).select("spark_id", "inn")
    parties = filter_keys(participants, "spark_id", companies.select("spark_id"))
    role = F.col("state_contract_role_code")
    registered = participant_dict.select(
        F.col("code").alias("contract_participant_code"), F.col("participant_inn_code").alias("inn")
    )
    suppliers = (
        Counts.of(parties.filter(role == SUPPLIER_ROLE), ["contract_code", "spark_id", "contract_participant_code"])
        .extend(Counts.of(companies, ["spark_id", "inn"]), "spark_id")
        .join(registered, ["contract_participant_code", "inn"])
        .per("contract_code")
    )
    customer_entities = entities.select(F.col("spark_id").alias("participant_spark_id"))
    details = Counts.of(participant_dict, ["code", "participant_spark_id"]).join(customer_entities, "participant_spark_id", "left")
    details = Counts(details.frame.withColumnRenamed("code", "contract_participant_code"))
    customers = Counts.of(parties.filter(role == CUSTOMER_ROLE), ["contract_code", "contract_participant_code"])
    customers = customers.join(details, "contract_participant_code")
    terms = contracts.select(F.col("code").alias("contract_code"))
    return suppliers.join(customers, "contract_code").join(terms, "contract_code").total()


def count_deal_listing(
    realty: DataFrame,
    deals: DataFrame,
    docs: DataFrame,
    doc_types: DataFrame,
    shares: DataFrame,
    addresses: DataFrame,
    regions: DataFrame,
    type_code: int = LISTING_DOC_TYPE_CODE,
    year_from: int = 2021,
) -> DataFrame:
    """The number of rows of `deal_listing`: per deal its documents times its shares, per realty its deals times its addresses."""
    types = doc_types.filter(F.col("cadastral_doc_type_code").cast("bigint") == type_code)
    types = types.select(F.col("bkh").alias("cadastral_doc_type_bkh"))
    typed = Counts.of(docs.withColumnRenamed("reference_bkh", "deal_bkh"), ["deal_bkh", "cadastral_doc_type_bkh"])
    typed = typed.join(types, "cadastral_doc_type_bkh")
    recent = deals.filter(F.col("registration_date") >= F.lit(dt.date(year_from, 1, 1)))
    per_realty = (
        Counts.of(recent.withColumnRenamed("bkh", "deal_bkh"), ["deal_bkh", "realty_bkh"])
        .join(typed, "deal_bkh")
        .join(shares.select(F.col("reference_bkh").alias("deal_bkh")), "deal_bkh", "left")
        .per("realty_bkh")
    )
    entries = regions.select(F.col("bkh").alias("realty_region_bkh"))
    places = Counts.of(addresses, ["realty_bkh", "realty_region_bkh"]).join(entries, "realty_region_bkh", "left")
    homes = realty.select(F.col("bkh").alias("realty_bkh"))
    return per_realty.join(homes, "realty_bkh").join(places, "realty_bkh", "left").total()


def count_advert_versions(
    t: AdvertTables,
    agency_names: Sequence[str] = AGENCIES,
    keys: Keys | None = None,
    with_history_address: bool = False,
    only_with_address: bool = False,
) -> Counts:
    """Per advert id how many versions `advert_versions` has, times their history addresses if asked for."""
    live = active_only(t.adverts)
    if keys is not None:
        live = _pick(keys)(live)
    agencies = active_only(t.agencies).filter(F.col("realty_agency_name").isin(list(agency_names)))
    updates = active_only(t.statistics).select(F.col("advert_bkh").alias("bkh"), "valid_from")
    versions = (
        Counts.of(live, ["src_cian_id", "src_realty_id", "bkh", "valid_from", "realty_agency_bkh", "status_bkh"])
        .join(agencies.select(F.col("bkh").alias("realty_agency_bkh")), "realty_agency_bkh")
        .join(t.statuses.select(F.col("bkh").alias("status_bkh")), "status_bkh")
        .join(updates, ["bkh", "valid_from"])
    )
    if with_history_address or only_with_address:
        if t.addresses is None:
            raise ValueError("the history address needs the address history table")
        versions = versions.per("src_cian_id", "src_realty_id")
        places = active_only(t.addresses).select("src_realty_id")
        versions = versions.join(places, "src_realty_id", "inner" if only_with_address else "left")
    return versions.per("src_cian_id")


def count_advert_history(
    t: AdvertTables,
    agency_names: Sequence[str] = AGENCIES,
    keys: Keys | None = None,
    with_history_address: bool = False,
    only_with_address: bool = False,
) -> DataFrame:
    """The number of rows of `advert_history` with the same arguments: per current advert its versions times its views,
    addresses and dictionary entries."""
    if keys is not None:
        keys = key_filter(["src_cian_id"], keys)
    versions = count_advert_versions(t, agency_names, keys, with_history_address, only_with_address)
    current = t.actual if keys is None else _pick(keys)(t.actual)
    best = best_adverts(t, agency_names, keys).withColumnRenamed("advert_bkh", "bkh")
    references = ["bkh", "src_cian_id", "src_realty_id", "status_bkh", "advert_category_bkh", "building_type_bkh"]
    return (
        Counts.of(current, references)
        .join(best, "bkh")
        .join(t.actual_statuses.select(F.col("bkh").alias("status_bkh")), "status_bkh")
        .join(t.categories.select(F.col("bkh").alias("advert_category_bkh")), "advert_category_bkh")
        .join(t.building_types.select(F.col("bkh").alias("building_type_bkh")), "building_type_bkh", "left")
        .join(t.actual_statistics.select(F.col("advert_bkh").alias("bkh")), "bkh", "left")
        .per("src_cian_id", "src_realty_id")
        .join(t.actual_addresses.select("src_realty_id"), "src_realty_id", "left")
        .per("src_cian_id")
        .join(versions, "src_cian_id", "left")
        .total()
    )
