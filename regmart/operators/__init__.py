"""Reusable DataFrame operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changes import changed_values, with_neighbours
from .counting import Counts
from .dedup import distinct_on, latest_version, newest_versions, top_rank
from .joins import Dim, checked_broadcast, enrich, require_unique, role_pairs
from .keys import active_only, filter_key_tuples, filter_keys, key_filter, key_frame, optional_key_lookup
from .ordering import By, desc
from .skew import KeyProfile, hot_join, hot_keys, key_profile, repeated
from .snapshots import Period, in_any_period, period_snapshots


def row_count(df: DataFrame) -> DataFrame:
    """One row: how many rows `df` has."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


__all__ = [
    "By",
    "Counts",
    "Dim",
    "KeyProfile",
    "Period",
    "active_only",
    "changed_values",
    "checked_broadcast",
    "desc",
    "distinct_on",
    "enrich",
    "filter_key_tuples",
    "filter_keys",
    "hot_join",
    "hot_keys",
    "in_any_period",
    "key_filter",
    "key_frame",
    "key_profile",
    "latest_version",
    "newest_versions",
    "optional_key_lookup",
    "period_snapshots",
    "repeated",
    "require_unique",
    "role_pairs",
    "row_count",
    "top_rank",
    "with_neighbours",
]
