"""The analytics jobs: DataFrames in, DataFrame out."""

from .adverts import (
    AdvertTables,
    advert_history,
    advert_history_all,
    advert_history_of,
    advert_snapshots,
    advert_versions,
    best_adverts,
    price_steps,
)
from .contracts import contract_pairs
from .counts import count_advert_history, count_contract_pairs, count_deal_listing
from .deals import deal_listing, deal_rollup, property_register
from .flags import counterparty_check, include_list
from .objects import document_rollup, object_rollup
from .reports import latest_report_lines, report_extract
from .requests import merged_stats, request_sketches, request_stats

__all__ = [
    "AdvertTables",
    "advert_history",
    "advert_history_all",
    "advert_history_of",
    "advert_snapshots",
    "advert_versions",
    "best_adverts",
    "contract_pairs",
    "count_advert_history",
    "count_contract_pairs",
    "count_deal_listing",
    "counterparty_check",
    "deal_listing",
    "deal_rollup",
    "document_rollup",
    "include_list",
    "latest_report_lines",
    "merged_stats",
    "object_rollup",
    "price_steps",
    "property_register",
    "report_extract",
    "request_sketches",
    "request_stats",
]
