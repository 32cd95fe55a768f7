"""Dimension enrichment and pairing by role."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import BROADCAST_BYTES, fits_broadcast
from .skew import hot_join


class Dim(NamedTuple):
    """A dimension to join: `df.left_key = table.key`, adding `columns` (output name -> dimension column)."""

    table: DataFrame
    left_key: str
    key: str
    columns: Mapping[str, str]
    how: str = "left"


def require_unique(df: DataFrame, key: str) -> None:
    """Raise if a non-NULL key value occurs twice. Runs a job."""
    repeated = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"{key} is not unique, e.g. {repeated[0][0]!r} occurs {repeated[0][1]} times")


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`broadcast(df)` if its rows hold at most `max_bytes`, else `df` as it is. Runs a job that adds up their sizes."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def enrich(
    df: DataFrame,
    dims: Sequence[Dim],
    check_unique: bool = False,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join a chain of dimensions by equality; a dimension key that repeats multiplies rows.

    With `check_unique`, keys are verified first. With `broadcast_bytes`, dimensions measured to be no larger are
    broadcast; otherwise Spark decides by their size.
    """
    for i, dim in enumerate(dims):
        if check_unique:
            require_unique(dim.table, dim.key)
        key = f"_k{i}"
        side = dim.table.select(F.col(dim.key).alias(key), *[F.col(src).alias(out) for out, src in dim.columns.items()])
        if broadcast_bytes is not None:
            side = checked_broadcast(side, broadcast_bytes)
        df = df.join(side, F.col(dim.left_key) == F.col(key), dim.how)
        if dim.how not in ("left_semi", "left_anti"):
            df = df.drop(key)
    return df


def role_pairs(
    df: DataFrame, key: str, role: str, left_role, right_role, suffix: str = "_2", **skew
) -> DataFrame:
    """Pairs of rows with one `key`, a row of `left_role` with a row of `right_role`.

    The right row's columns get `suffix`. Frequent keys are spread over tasks (see `hot_join`).
    """
    left = df.filter(F.col(role) == left_role)
    right = df.filter(F.col(role) == right_role)
    right = right.select(key, *[F.col(c).alias(c + suffix) for c in df.columns if c != key])
    return hot_join(left, right, [key], "inner", **skew)
