"""Counting the rows of joins without joining rows: products of per-key counts.

A `Counts` says how many rows there are per key. Before each join both sides are folded to one row per key, in the tasks that
read them and again after the shuffle, so a key with very many rows on both sides costs two rows instead of their product.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_N, _M = "_n", "_m"


class Counts(NamedTuple):
    """A frame of key columns and `_n`, the number of rows that each of its rows stands for."""

    frame: DataFrame

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str]) -> Counts:
        """Rows of `df` per key tuple. NULL keys form one group."""
        return cls(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N)))

    def per(self, *keys: str) -> Counts:
        """The same rows counted per fewer keys."""
        return Counts(self.frame.groupBy(*keys).agg(F.sum(_N).alias(_N)))

    def join(self, other: DataFrame | Counts, on: Sequence[str] | str, how: str = "inner") -> Counts:
        """Counts of the equi-join with `other`, whose columns besides `on` are not kept.

        ``inner``: a row for each pair, and none where `other` has no match; ``left``: rows without a match count as they are.
        NULL keys match nothing, as in any equi-join.
        """
        if how not in ("inner", "left"):
            raise ValueError("how must be inner or left")
        on = [on] if isinstance(on, str) else list(on)
        side = (other.per(*on) if isinstance(other, Counts) else Counts.of(other, on)).frame.withColumnRenamed(_N, _M)
        return self._times(self.frame.join(side, on, how))

    def extend(self, other: Counts, on: Sequence[str] | str) -> Counts:
        """As an inner `join`, but the other side's further keys are kept for later joins."""
        on = [on] if isinstance(on, str) else list(on)
        return self._times(self.frame.join(other.frame.withColumnRenamed(_N, _M), on))

    @staticmethod
    def _times(joined: DataFrame) -> Counts:
        return Counts(joined.withColumn(_N, F.col(_N) * F.coalesce(_M, F.lit(1))).drop(_M))

    def total(self) -> DataFrame:
        """One row: `row_count`, 0 for no rows."""
        return self.frame.agg(F.coalesce(F.sum(_N), F.lit(0)).alias("row_count"))
