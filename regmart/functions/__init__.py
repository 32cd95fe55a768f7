"""Column functions and SQL table functions."""

from .columns import (
    array_agg_nulls,
    as_of_date,
    concat_distinct,
    contains_any,
    day_gap_label,
    days_listed,
    flag_if,
    join_sorted,
    outcome_flag,
    sorted_set,
    to_flag,
    year_week,
)

__all__ = [
    "array_agg_nulls",
    "as_of_date",
    "concat_distinct",
    "contains_any",
    "day_gap_label",
    "days_listed",
    "flag_if",
    "join_sorted",
    "outcome_flag",
    "sorted_set",
    "to_flag",
    "year_week",
]
