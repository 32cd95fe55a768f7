"""Accounting reports: extracts by company and the newest report lines of a period."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import active_only, filter_keys, newest_versions

REPORT_COLUMNS = [
    "spark_id", "balance_type", "accounting_period_code", "form_name", "financial_indicator_code", "valid_from",
    "section_name", "line_code", "line_name", "line_value", "deleted_flag",
]


def report_extract(reports: DataFrame, keys: DataFrame | Iterable[int]) -> DataFrame:
    """Live report lines of the companies in `keys`."""
    return filter_keys(active_only(reports), "spark_id", keys).select(*REPORT_COLUMNS)


def latest_report_lines(
    reports: DataFrame,
    actual: DataFrame,
    scope: DataFrame,
    periods: DataFrame,
    lower,
    upper,
    line_code: str = "2100",
) -> DataFrame:
    """Current lines of the newest report version per hash.

    Versions count when their company is in `scope` and `valid_from` lies in [lower, upper]; with dates as bounds,
    times after midnight of the last day are outside. A version replaced since then yields no line.
    """
    dated = reports.filter(F.col("valid_from").between(F.lit(lower), F.lit(upper)))
    in_scope = filter_keys(dated, "spark_id", scope.select("spark_id"))
    newest = newest_versions(in_scope, "bk_hash", "accounting_report_id")
    newest = newest.select(F.col("accounting_report_id"))  # one row per hash: may repeat an id, as the job counts it
    lines = actual.filter(F.col("line_code") == line_code).join(newest, "accounting_report_id")
    named = lines.join(
        periods.select(F.col("code").alias("accounting_period_code"), "period_name"), "accounting_period_code"
    )
    return named.select(
        "bk_hash", "spark_id", "balance_type", "period_name", "form_name", "financial_indicator_code",
        F.lit(True).alias("status"), "section_name", "line_code", "line_name", "line_value",
    )
