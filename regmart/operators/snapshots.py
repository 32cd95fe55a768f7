"""Latest row per key within each of several periods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import distinct_on
from .ordering import By, desc


class Period(NamedTuple):
    """Half-open [start, end) unless `closed`; a missing bound is open."""

    label: str
    start: object = None
    end: object = None
    closed: bool = False

    def contains(self, time: Column) -> Column:
        inside = time.isNotNull()
        if self.start is not None:
            inside = inside & (time >= F.lit(self.start))
        if self.end is not None:
            inside = inside & ((time <= F.lit(self.end)) if self.closed else (time < F.lit(self.end)))
        return inside


def in_any_period(time: Column, periods: Sequence[Period]) -> Column:
    return reduce(lambda a, b: a | b, [p.contains(time) for p in periods])


def period_snapshots(
    df: DataFrame,
    key: str,
    time: str,
    periods: Sequence[Period],
    tie_break: Sequence[By | str] = (),
    label: str = "period",
) -> DataFrame:
    """For every period, each key's last row in it, with the period's label; the union over all periods.

    One pass for all periods: a row is offered to each period that contains it, and the first row
    per (period, key) is kept.
    """
    labels = [p.label for p in periods]
    if len(set(labels)) != len(labels):
        raise ValueError("period labels must differ")
    offered = F.array_compact(F.array(*[F.when(p.contains(F.col(time)), F.lit(p.label)) for p in periods]))
    tagged = df.filter(in_any_period(F.col(time), periods)).withColumn(label, F.explode(offered))
    return distinct_on(tagged, [label, key], [desc(time, nulls_first=False)], tie_break)
