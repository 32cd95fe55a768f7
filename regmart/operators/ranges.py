"""Rows dealt out by ranges of their sort order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import By

# The column that with_range adds, and how many ranges there may be.
RANGE = "_range"
MAX_RANGES = 20_000
# Rows looked at per range to find the borders.
_SAMPLED = 40
_NEGATED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _sort_key(df: DataFrame, keys: Sequence[str], order: Sequence[By | str]) -> Column:
    """A struct that never decreases along the order: the key's hash, then the order's columns as far as they can be compared so.

    A descending number or time goes in as its negated double, which may be the same for close values, so nothing follows it; a
    descending text cannot go in. Rows that differ further on only stay in one range.
    """
    parts = [F.xxhash64(*keys)]
    for by in (By(o) if isinstance(o, str) else o for o in order):
        kind, c = df.schema[by.name].dataType, F.col(by.name)
        first = by.descending if by.nulls_first is None else by.nulls_first
        place = F.when(c.isNull(), F.lit(0 if first else 2)).otherwise(F.lit(1))
        if by.descending:
            if isinstance(kind, _NEGATED):
                number = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c.cast("timestamp")) if not isinstance(kind, T.NumericType) else c
                parts += [place, -number.cast("double")]
            else:
                parts.append(place)
            break
        parts += [place, c]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def with_range(df: DataFrame, keys: Sequence[str], order: Sequence[By | str], ranges: int) -> DataFrame:
    """Add `RANGE`, a number from 0 that never decreases in the order of (hash of the key, order), and deal the rows out by it.

    The borders are quantiles of a sample, a scalar subquery of the same plan. It is drawn by a hash of the sort key, so that it is the
    same whenever it is computed. Each row finds its range by binary search. Ranges are about equal, but rows
    with one sort key, and what the sample misses, stay together; that changes no result.
    """
    if ranges < 2:
        return df.withColumn(RANGE, F.lit(0)).repartition(1)
    key = _sort_key(df, keys, order)
    # One in `step` distinct sort keys; about _SAMPLED per range if the keys are distinct.
    listed = df.select(key.alias("_key")).withColumn("_h", F.xxhash64("_key"))
    smallest = listed.select("_key", "_h").distinct().orderBy("_h").limit(_SAMPLED * ranges)
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.floor(i * F.size("_all") / ranges).cast("int"))
    cuts = smallest.agg(F.sort_array(F.collect_list("_key")).alias("_all")).select(
        F.transform(at, lambda i: F.get(F.col("_all"), i)).alias("_cuts")
    )
    borders = cuts.scalar()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(math.ceil(math.log2(ranges))))])
    keyed = df.withColumn("_key", key).withColumn("_cuts", borders)
    found = F.aggregate(
        steps, F.lit(0), lambda n, step: F.when(F.get(F.col("_cuts"), n + step - 1) <= F.col("_key"), n + step).otherwise(n)
    )
    return keyed.withColumn(RANGE, found).drop("_key", "_cuts").repartitionById(ranges, F.col(RANGE))
