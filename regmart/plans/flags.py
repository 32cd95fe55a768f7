"""Counterparty checks and include lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions import outcome_flag, to_flag
from ..operators import filter_keys, optional_key_lookup
from ..sources.schemas import CHECK_FLAGS

# Columns of a counterparty check, in output order.
COMPANY_COLUMNS = [
    "spark_id", "inn", "ogrn", "kpp", "okfs_code", "okfs_name", "okopf_name", "full_name_rus", "short_name_rus",
    "status_name", "first_registration_date", "revenue", "net_profit", "net_assets",
]
RISK_FLAGS = [f"{f}_flag" for f in CHECK_FLAGS]
# Check results that pass and that fail; any other has no verdict.
PASSED = ["GREEN FLAG", "APPROVAL"]
FAILED = ["RED FLAG"]

INCLUDE_LIST_KEYS = ["inn", "ogrn", "kpp"]
INCLUDE_LIST_COLUMNS = ["list_name", "is_negative", "status_name", "full_name_rus", "inn", "ogrn", "kpp"]


def counterparty_check(
    checks: DataFrame, keys: DataFrame | Iterable[str] | None = None, strict: bool = True
) -> DataFrame:
    """Company identity and finances for the INNs in `keys` (all when None), with the risk flags as booleans
    and `check_res`: whether the check passed, NULL when its result is neither a pass nor a failure."""
    if keys is not None:
        checks = filter_keys(checks, "inn", keys)
    return checks.select(
        *COMPANY_COLUMNS,
        *[to_flag(f, strict).alias(f) for f in RISK_FLAGS],
        "report_year",
        outcome_flag("check_result", PASSED, FAILED).alias("check_res"),
        "check_result",
        "lim_calc",
    )


def include_list(
    lists: DataFrame,
    requests: DataFrame | Iterable[tuple[str, str, str]],
) -> DataFrame:
    """List entries naming each requested company. A request is (INN, OGRN, KPP), `''` for a key not given."""
    found = optional_key_lookup(lists, requests, INCLUDE_LIST_KEYS)
    return found.select(*[f"request_{k}" for k in INCLUDE_LIST_KEYS], *INCLUDE_LIST_COLUMNS)
