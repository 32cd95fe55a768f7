"""Column functions: each takes and returns a Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Texts read as booleans besides those Spark's own cast reads.
TRUE_WORDS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"]
FALSE_WORDS = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]


def to_flag(col: Column | str, strict: bool = True) -> Column:
    """Text to boolean. Other text is an error when `strict` (in an ANSI session), NULL otherwise."""
    c = _col(col).cast("string")
    word = F.lower(F.trim(c))
    other = c.cast("boolean") if strict else c.try_cast("boolean")
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(other)


def year_week(day: Column | str) -> Column:
    """`YYYY-WW`, where week 1 is the first seven days of the year; 31 December is in week 53."""
    d = _col(day)
    week = F.floor((F.dayofyear(d) - 1) / 7) + 1
    return F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def contains_any(col: Column | str, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words, whatever the case. NULL for a NULL text."""
    text = F.upper(_col(col))
    return reduce(lambda a, b: a | b, [text.contains(w.upper()) for w in words])


def flag_if(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def join_sorted(values: Column, sep: str = ",") -> Column:
    """Array of texts as one sorted text; NULL for an empty array."""
    return F.when(F.size(values) > 0, F.array_join(F.sort_array(values), sep))


def concat_distinct(col: Column | str, sep: str = ",") -> Column:
    """Aggregate: the distinct non-NULL values as one sorted text, NULL if there are none."""
    return join_sorted(F.collect_set(_col(col).cast("string")), sep)


def sorted_set(col: Column | str) -> Column:
    """Aggregate: the distinct non-NULL values as a sorted array. Equal sets are equal arrays."""
    return F.sort_array(F.collect_set(_col(col)))


def array_agg_nulls(col: Column | str) -> Column:
    """Aggregate: all values as an array, NULLs included and first, the others ascending. NULL for no rows."""
    rows = F.collect_list(F.struct(_col(col).alias("v")))
    return F.when(F.size(rows) > 0, F.transform(F.sort_array(rows), lambda r: r["v"]))


def days_listed(
    status: Column | str, created: Column | str, changed: Column | str, as_of: Column | str, open_status: str
) -> Column:
    """Whole days from creation to `as_of` while the status is the open one, else to the last change."""
    return F.when(_col(status) == open_status, F.datediff(_col(as_of), _col(created))).otherwise(
        F.datediff(_col(changed), _col(created))
    )


def day_gap_label(earlier: Column | str, later: Column | str, missing: str) -> Column:
    """Days between two times as text, or `missing` where one of them is NULL."""
    return F.coalesce(F.datediff(_col(later), _col(earlier)).cast("string"), F.lit(missing))


def outcome_flag(result: Column | str, passed: Sequence[str], failed: Sequence[str]) -> Column:
    """True or False for known results, NULL for any other."""
    r = _col(result)
    return F.when(r.isin(list(failed)), False).when(r.isin(list(passed)), True)


def as_of_date(as_of) -> Column:
    """The given date, or the current one."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")
