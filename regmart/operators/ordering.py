"""Sort keys with explicit NULL placement."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class By(NamedTuple):
    """One sort key. NULL counts as the largest value unless `nulls_first` says otherwise:
    last when ascending, first when descending."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    def column(self) -> Column:
        first = self.descending if self.nulls_first is None else self.nulls_first
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


def desc(name: str, nulls_first: bool | None = None) -> By:
    return By(name, True, nulls_first)


def sort_columns(order: Sequence[By | str]) -> list[Column]:
    return [(By(o) if isinstance(o, str) else o).column() for o in order]


def sort_names(order: Sequence[By | str]) -> list[str]:
    return [o if isinstance(o, str) else o.name for o in order]
