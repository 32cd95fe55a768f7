"""Property adverts: price history and period snapshots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_of_date, day_gap_label, days_listed
from ..operators import (
    Dim,
    Period,
    active_only,
    desc,
    distinct_on,
    enrich,
    filter_keys,
    hot_join,
    hot_keys,
    in_any_period,
    key_filter,
    key_profile,
    period_snapshots,
    top_rank,
    with_neighbours,
)

# The agencies reported on, the status of a running advert, the texts of the price-change column, the
# text for a missing address and the label of an advert's first version.
AGENCIES = ["Банк ДОМ.РФ", "ДОМ.РФ"]
OPEN_STATUS = "активно"
CHANGED, UNCHANGED = "Да", "Нет"
EMPTY_ADDRESS = "(пусто)"
NEW_ADVERT = "Новое объявление"
# Region, status and periods of the snapshots. The second period ends with the start of its last second.
REGION = "Москва"
ACTIVE_STATUS_CODE = 1
PERIODS = [
    Period("before", end=dt.datetime(2022, 6, 1)),
    Period("within", dt.datetime(2022, 6, 1), dt.datetime(2022, 6, 30, 23, 59, 59), closed=True),
]


# Advert ids as a list, a one-column DataFrame, or what `key_filter` made of either.
Keys = DataFrame | Iterable[int] | Callable[[DataFrame], DataFrame]


class AdvertTables(NamedTuple):
    """Inputs of the advert history. The first four hold all versions, the others current rows."""

    adverts: DataFrame
    statistics: DataFrame
    agencies: DataFrame
    statuses: DataFrame
    actual: DataFrame
    actual_statistics: DataFrame
    actual_agencies: DataFrame
    actual_statuses: DataFrame
    categories: DataFrame
    actual_addresses: DataFrame
    building_types: DataFrame
    addresses: DataFrame | None = None


_VERSION_COLUMNS = [
    "advert_id", "src_cian_id", "realty_agency_name", "price_amt", "total_area_amt", "price_sqm_amt", "room_cnt",
    "housing_complex_name", "valid_from", "bkh", "historic_status",
]


def _agency_dim(agencies: DataFrame, names: Sequence[str]) -> Dim:
    named = agencies.filter(F.col("realty_agency_name").isin(list(names)))
    return Dim(named, "realty_agency_bkh", "bkh", {"realty_agency_name": "realty_agency_name"}, "inner")


def _pick(keys: Keys) -> Callable[[DataFrame], DataFrame]:
    return keys if callable(keys) else key_filter(["src_cian_id"], keys)


def advert_versions(t: AdvertTables, agency_names: Sequence[str] = AGENCIES, keys: Keys | None = None) -> DataFrame:
    """Live versions of the agencies' adverts with the statistics of the same version; `valid_from` is the statistics'
    update, `version_from` the version's own start. Status entries are joined whether deleted or not, and may repeat rows."""
    live = active_only(t.adverts)
    if keys is not None:
        live = _pick(keys)(live)
    known = enrich(
        live,
        [
            _agency_dim(active_only(t.agencies), agency_names),
            Dim(t.statuses, "status_bkh", "bkh", {"historic_status": "status_name"}, "inner"),
        ],
    )
    updates = active_only(t.statistics).select(F.col("advert_bkh").alias("bkh"), "valid_from", "src_update_date")
    versions = known.join(updates, ["bkh", "valid_from"]).withColumn("version_from", F.col("valid_from"))
    versions = versions.withColumn("valid_from", F.col("src_update_date"))
    return versions.select(*_VERSION_COLUMNS, "src_realty_id", "version_from")


def with_history_addresses(versions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Versions with every live address of their realty, whenever it held."""
    places = active_only(addresses).select("src_realty_id", F.col("user_address_txt").alias("historic_address"))
    return hot_join(places, versions, ["src_realty_id"], "one_outer")


def price_steps(
    t: AdvertTables,
    agency_names: Sequence[str] = AGENCIES,
    keys: Keys | None = None,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Versions with the starts of the advert's previous and next one, the days from the next one's start to this one's
    update as text (the newest is labelled a new advert), and the price before in the same record (0 for its first version).

    Versions follow each other by their own start, not by their update. Those with one start are ordered by all columns,
    so the result does not depend on how rows are dealt out. For `stage` see `advert_history`."""
    versions = stage(advert_versions(t, agency_names, keys).select(*_VERSION_COLUMNS, "version_from"))
    live = active_only(t.adverts)
    order = ["version_from", *(c for c in _VERSION_COLUMNS if c != "src_cian_id")]
    timed = with_neighbours(versions, ["src_cian_id"], order, ["version_from"], key_profile(live, ["src_cian_id"]))
    record = ["src_cian_id", "bkh"]
    priced = with_neighbours(timed, record, [c for c in order if c != "bkh"], ["price_amt"], key_profile(live, record))
    return priced.select(
        *_VERSION_COLUMNS,
        F.col("prev_version_from").alias("prev_valid_date"),
        F.col("next_version_from").alias("next_valid_date"),
        day_gap_label("next_version_from", "valid_from", NEW_ADVERT).alias("days_to_next"),
        F.coalesce("prev_price_amt", F.lit(0)).alias("past_price"),
    )


def best_adverts(t: AdvertTables, agency_names: Sequence[str] = AGENCIES, keys: Keys | None = None) -> DataFrame:
    """`advert_bkh` of the most recently updated current record(s) per advert id, ties included. With `keys`, those
    that a record of the given adverts can match: usually their own."""
    actual = t.actual
    if keys is not None:
        # Records are matched by bkh alone, so an advert sharing one with a given advert has its say, too.
        records = _pick(keys)(actual).select("bkh")
        related = actual.join(records, "bkh", "left_semi").select(F.col("src_cian_id").alias("_id")).distinct()
        actual = actual.join(related, F.col("src_cian_id").eqNullSafe(F.col("_id")), "left_semi")
    stats = t.actual_statistics.select("advert_bkh", "src_update_date", "src_upload_date")
    listed = enrich(actual.select("bkh", "src_cian_id", "realty_agency_bkh"), [_agency_dim(t.actual_agencies, agency_names)])
    dated = listed.select(F.col("bkh").alias("advert_bkh"), "src_cian_id").join(stats, "advert_bkh")
    return top_rank(dated, ["src_cian_id"], [desc("src_update_date"), desc("src_upload_date")]).select("advert_bkh")


def advert_history(
    t: AdvertTables,
    agency_names: Sequence[str] = AGENCIES,
    as_of=None,
    keys: Keys | None = None,
    with_history_address: bool = False,
    empty_address: str | None = None,
    open_status: str = OPEN_STATUS,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
    only_with_address: bool = False,
) -> DataFrame:
    """Current adverts with every version of theirs: last update, days listed, whether the price ever changed.

    `only_with_address` takes a version once per live address in its realty's history, and versions without one not at all, also for the
    last update and the price change.

    Adverts without versions stay, with NULLs. `keys` limits the advert ids before any work is done. A hidden address
    becomes `empty_address` if that is given.

    The versions are needed twice, to summarise them and to list them. `stage` may store them in between and return
    them, e.g. `DataFrame.checkpoint`; by default they are computed twice, the first time with fewer columns.
    """
    if keys is not None:
        keys = key_filter(["src_cian_id"], keys)
    versions = stage(advert_versions(t, agency_names, keys))
    if (with_history_address or only_with_address) and t.addresses is None:
        raise ValueError("the history address needs the address history table")
    if only_with_address:
        # For the summary once is enough.
        placed = active_only(t.addresses).select("src_realty_id")
        versions = versions.join(placed, "src_realty_id", "left_semi")
    # What a window per advert would tell, as one row per advert: an advert with very many versions is aggregated before
    # the shuffle and never held in one task.
    summary = (
        versions.groupBy("src_cian_id")
        .agg(
            F.max("valid_from").alias("last_valid_from"),
            F.min("price_amt").alias("_low"),
            F.max("price_amt").alias("_high"),
        )
        .select(
            "src_cian_id", "last_valid_from", (F.col("_low") < F.col("_high")).alias("_changed"),
            F.lit(True).alias("_has_versions"),
        )
    )
    if with_history_address:
        versions = with_history_addresses(versions, t.addresses)
    elif only_with_address:
        versions = versions.join(placed, "src_realty_id")

    current = t.actual if keys is None else _pick(keys)(t.actual)
    current = current.join(
        best_adverts(t, agency_names, keys).withColumnRenamed("advert_bkh", "bkh"), "bkh"
    ).select(
        "src_cian_id", "bkh", "status_bkh", "advert_category_bkh", "building_type_bkh", "src_realty_id",
        F.col("price_amt").alias("actual_price_amt"), F.col("total_area_amt").alias("actual_total_area_amt"),
        F.col("price_sqm_amt").alias("actual_price_sqm_amt"), "create_date", "advert_url_txt", "subway_minute_amt",
        "prepay_month_cnt", "deposit_amt", F.col("user_address_txt").alias("user_address_txt2"),
    )
    described = enrich(
        current,
        [
            Dim(t.actual_statuses, "status_bkh", "bkh", {"status_name": "status_name"}, "inner"),
            Dim(t.categories, "advert_category_bkh", "bkh", {"advert_category_name": "advert_category_name"}, "inner"),
            Dim(t.building_types, "building_type_bkh", "bkh", {"building_type_name": "building_type_name"}),
            Dim(summary, "src_cian_id", "src_cian_id", {c: c for c in ("last_valid_from", "_changed", "_has_versions")}),
        ],
    )
    views = t.actual_statistics.select(F.col("advert_bkh").alias("bkh"), "view_cnt")
    # A version's own record is `bkh` in the result; the current record's has served its purpose.
    viewed = hot_join(views, described, ["bkh"], "one_outer").drop("bkh")
    places = t.actual_addresses.select("src_realty_id", "region_name", "settlement_name", "user_address_txt")
    located = hot_join(places, viewed, ["src_realty_id"], "one_outer")
    hot_ids = hot_keys(active_only(t.adverts), ["src_cian_id"])
    versions = versions.drop("src_realty_id")
    joined = hot_join(versions, located, ["src_cian_id"], "one_outer", hot=hot_ids, matched="_has_versions")

    def address(name: str):
        return F.col(name) if empty_address is None else F.coalesce(F.col(name), F.lit(empty_address)).alias(name)

    return joined.select(
        "advert_id",
        F.when(F.col("_has_versions"), F.col("src_cian_id")).alias("src_cian_id"),
        "realty_agency_name", "price_amt", "total_area_amt", "price_sqm_amt", "room_cnt", "housing_complex_name",
        "valid_from", "last_valid_from", "bkh", "historic_status",
        *(["historic_address"] if with_history_address else []),
        days_listed("status_name", "create_date", "valid_from", as_of_date(as_of), open_status).alias("srok"),
        "status_name", "actual_price_amt", "actual_total_area_amt", "actual_price_sqm_amt", "create_date",
        "advert_url_txt", "building_type_name", "subway_minute_amt", "prepay_month_cnt", "deposit_amt",
        "advert_category_name", "view_cnt", "region_name", "settlement_name", address("user_address_txt"),
        address("user_address_txt2"),
        F.when(F.col("_changed"), CHANGED).otherwise(UNCHANGED).alias("change_price"),
    )


def advert_history_of(t: AdvertTables, keys: DataFrame | Iterable[int], **options) -> DataFrame:
    """The history of some adverts, with the address history."""
    rows = advert_history(t, keys=keys, with_history_address=True, **options)
    return rows.drop("advert_id", "price_sqm_amt", "user_address_txt2")


def advert_history_all(t: AdvertTables, **options) -> DataFrame:
    """The history of all adverts; hidden addresses are spelled out."""
    return advert_history(t, empty_address=EMPTY_ADDRESS, **options)


def advert_snapshots(
    adverts: DataFrame,
    statuses: DataFrame,
    addresses: DataFrame,
    categories: DataFrame,
    blocks: DataFrame,
    classes: DataFrame,
    periods: Sequence[Period] = PERIODS,
    region: str = REGION,
    status_code: int = ACTIVE_STATUS_CODE,
) -> DataFrame:
    """Per period, the last live version in it of each advert of the region with the given status.

    Region and status only select, so they are semi-joins before the choice; descriptive dimensions are reduced to one
    row per key and joined to the chosen rows only. Ties go to the smallest version values, then dimension values.
    """
    in_region = addresses.filter(F.col("region_name") == region).select("src_realty_id")
    with_status = statuses.filter(F.col("status_code") == status_code).select(F.col("bkh").alias("status_bkh"))
    measures = [
        "price_sqm_amt", "price_amt", "currency_name", "realty_latitude", "realty_longitude", "room_cnt",
        "total_area_amt",
    ]
    references = ["advert_category_bkh", "housing_complex_block_code"]
    candidates = (
        active_only(adverts)
        .filter(in_any_period(F.col("valid_from"), periods))
        .join(with_status, "status_bkh", "left_semi")
        .select("src_cian_id", "src_realty_id", "valid_from", *measures, *references)
    )
    candidates = filter_keys(candidates, "src_realty_id", in_region).drop("src_realty_id")
    chosen = period_snapshots(candidates, "src_cian_id", "valid_from", periods, [*measures, *references])

    category = distinct_on(categories, ["bkh"], ["advert_category_code", "advert_category_name"])
    block_class = enrich(
        blocks,
        [Dim(classes, "building_class_bkh", "bkh",
             {"building_class_type": "building_class_type", "building_class_name": "building_class_name"})],
    )
    block = distinct_on(block_class, ["housing_complex_block_code"], ["building_class_type", "building_class_name"])
    described = enrich(
        chosen,
        [
            Dim(category, "advert_category_bkh", "bkh",
                {"advert_category_code": "advert_category_code", "advert_category_name": "advert_category_name"}),
            Dim(block, "housing_complex_block_code", "housing_complex_block_code",
                {"building_class_type": "building_class_type", "building_class_name": "building_class_name"}),
        ],
    )
    return described.select(
        "period", "src_cian_id", F.lit(region).alias("region_name"), *measures, "advert_category_code",
        "advert_category_name", "building_class_type", "building_class_name",
    )
