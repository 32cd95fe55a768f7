"""Property deals and the property register."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import array_agg_nulls, as_of_date, contains_any, flag_if, year_week
from ..operators import distinct_on, hot_join, hot_keys

# Words marking a dwelling, and words marking an escrow account (one of them a common misspelling).
LIVING_WORDS = ["КВАРТИР"]
ESCROW_WORDS = ["ЭСКРОУ", "ЭКСРОУ", "ESCROW"]
# The document types of the two deal jobs.
ROLLUP_DOC_TYPE = "6538d008-0e48-9b8c-10a0-d228ec21f9ec"
LISTING_DOC_TYPE_CODE = 558401010201


def property_register(realty: DataFrame, as_of=None) -> DataFrame:
    """One row per cadastral number, with the load date. The smallest type and region win."""
    one = distinct_on(
        realty.select("cadastral_num", "realty_type_bkh", "region_code"),
        ["cadastral_num"],
        ["realty_type_bkh", "region_code"],
    )
    return one.withColumn("create_dt", as_of_date(as_of))


def deal_rollup(
    deals: DataFrame,
    docs: DataFrame,
    realty: DataFrame,
    shares: DataFrame,
    since=dt.date(2020, 1, 1),
    doc_type: str = ROLLUP_DOC_TYPE,
    living_words: list[str] = LIVING_WORDS,
    escrow_words: list[str] = ESCROW_WORDS,
) -> DataFrame:
    """One row per deal number, with the descriptions of its shares.

    1. Join deals registered after `since` to their documents of `doc_type`, shares and realty.
    2. Keep one row per (description, region, week).
    3. Collect descriptions per deal and document, keep one row per (document text, cadastral number, date).
    4. Keep one row per deal number.

    Realty addresses and regions, whose columns the job does not use, would only repeat rows that step 2 folds again,
    so they are not joined.
    """
    # Step 2 can only pick a deal's first document, so only that one is joined.
    first_doc = distinct_on(
        docs.filter(F.col("cadastral_doc_type_bkh") == doc_type).select(
            F.col("reference_bkh").alias("deal_bkh"), F.col("bkh").alias("doc_bkh"), "cadastral_doc_addition_txt"
        ),
        ["deal_bkh"],
        ["cadastral_doc_addition_txt", "doc_bkh"],
    )
    recent = deals.filter(F.col("registration_date") > F.lit(since)).select(
        F.col("bkh").alias("deal_bkh"), "realty_bkh", "registration_date", "cancel_date", "region_code", "deal_num",
        "deal_price_amt", "subject_description", "deal_condition_txt",
    )
    documented = recent.join(first_doc, "deal_bkh")
    deal_shares = shares.select(
        F.col("reference_bkh").alias("deal_bkh"), F.col("bkh").alias("share_bkh"), "ods_description"
    )
    shared = hot_join(deal_shares, documented, ["deal_bkh"], "one_outer")
    numbers = realty.select(F.col("bkh").alias("realty_bkh"), "cadastral_num")
    placed = hot_join(shared, numbers, ["realty_bkh"], "many_outer", hot=hot_keys(recent, ["realty_bkh"]))

    described = placed.select(
        "cadastral_num", "registration_date", "cancel_date", "region_code", "deal_num", "cadastral_doc_addition_txt",
        "deal_price_amt", "subject_description", "deal_bkh", "doc_bkh", "share_bkh",
        F.coalesce("ods_description", "subject_description").alias("ods_description"),
        flag_if(F.col("ods_description").isNull()).alias("ods_is_null"),
        flag_if(contains_any("subject_description", living_words)).alias("living"),
        flag_if(contains_any("deal_condition_txt", escrow_words)).alias("escrow"),
        year_week(F.date_add(F.col("registration_date").cast("date"), 1)).alias("wk_dst"),
    )
    per_week = distinct_on(
        described,
        ["ods_description", "region_code", "wk_dst"],
        ["cadastral_num", "deal_num", "cadastral_doc_addition_txt"],
        ["deal_bkh", "doc_bkh", "share_bkh", "ods_is_null"],
    )
    per_deal = per_week.groupBy(
        "cadastral_num", "region_code", "registration_date", "cancel_date", "deal_num", "subject_description",
        "living", "escrow", "cadastral_doc_addition_txt",
    ).agg(
        F.max("deal_price_amt").alias("deal_price_amt"),
        array_agg_nulls("ods_description").alias("agg_ods_description"),
        F.count(F.lit(1)).alias("cnt_ods_description"),
        F.sum("ods_is_null").alias("sum_ods_is_null"),
    )
    per_document = distinct_on(
        per_deal,
        ["cadastral_doc_addition_txt", "cadastral_num", "registration_date"],
        ["region_code", "cancel_date", "deal_num", "subject_description", "living", "escrow"],
    )
    per_number = distinct_on(
        per_document,
        ["deal_num"],
        ["cadastral_num"],
        ["registration_date", "cadastral_doc_addition_txt", "region_code", "cancel_date", "subject_description",
         "living", "escrow"],
    )
    return per_number.select(
        "agg_ods_description", F.col("cadastral_doc_addition_txt").cast("string"),
        F.col("cadastral_num").cast("string"), "cancel_date", "cnt_ods_description", F.col("deal_num").cast("string"),
        "deal_price_amt", "escrow", "living", F.col("region_code").cast("string"), "registration_date",
        F.col("subject_description").cast("string"), "sum_ods_is_null",
    )


def deal_listing(
    realty: DataFrame,
    deals: DataFrame,
    docs: DataFrame,
    doc_types: DataFrame,
    shares: DataFrame,
    addresses: DataFrame,
    regions: DataFrame,
    type_code: int = LISTING_DOC_TYPE_CODE,
    year_from: int = 2021,
    as_of=None,
) -> DataFrame:
    """Realty, deal and document of one type, with shares if any, for deals registered from `year_from` on.

    A row appears once per address of the realty and per region entry of the address, although neither has columns in
    the result. That number is counted per realty and applied at the end, instead of
    carrying the repeated rows through the joins.
    """
    types = doc_types.filter(F.col("cadastral_doc_type_code").cast("bigint") == type_code)
    typed_docs = docs.join(types.select(F.col("bkh").alias("cadastral_doc_type_bkh")), "cadastral_doc_type_bkh").select(
        F.col("reference_bkh").alias("deal_bkh"), "cadastral_doc_num"
    )
    recent = deals.filter(F.col("registration_date") >= F.lit(dt.date(year_from, 1, 1))).select(
        F.col("bkh").alias("deal_bkh"), "realty_bkh", "registration_date", "cancel_date", "region_code", "deal_num",
        "deal_condition_txt", "subject_description", "deal_price_txt", "deal_price_amt",
    )
    deal_shares = shares.select(
        F.col("reference_bkh").alias("deal_bkh"), F.col("bkh").alias("ods_bkh"), "ods_description",
        "transfer_deadline_txt",
    )
    documented = hot_join(deal_shares, recent.join(typed_docs, "deal_bkh"), ["deal_bkh"], "one_outer")

    entries = regions.groupBy(F.col("bkh").alias("realty_region_bkh")).agg(F.count(F.lit(1)).alias("entries"))
    copies = (
        addresses.groupBy("realty_bkh", "realty_region_bkh")
        .agg(F.count(F.lit(1)).alias("addresses"))
        .join(entries, "realty_region_bkh", "left")
        .groupBy("realty_bkh")
        .agg(F.sum(F.col("addresses") * F.coalesce("entries", F.lit(1))).alias("copies"))
    )
    homes = realty.select(
        F.col("bkh").alias("realty_bkh"), "cadastral_num", "room_number_txt", "room_name", "floor_number_txt",
        "plan_number_txt", "room_area_amt",
    ).join(copies, "realty_bkh", "left")
    listed = hot_join(documented, homes, ["realty_bkh"], hot=hot_keys(recent, ["realty_bkh"]))
    return listed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).select(
        "realty_bkh", "deal_bkh", "ods_bkh", "region_code", "cadastral_num", "cadastral_doc_num", "registration_date",
        "cancel_date", "deal_num", "deal_condition_txt", "subject_description", "ods_description", "deal_price_txt",
        "deal_price_amt", "room_number_txt", "room_name", "floor_number_txt", "plan_number_txt", "room_area_amt",
        "transfer_deadline_txt", as_of_date(as_of).alias("create_dt"),
    )
