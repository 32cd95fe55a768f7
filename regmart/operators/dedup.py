"""Picking rows per key: first row, newest version, best rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import By, sort_columns

# The tied best rows of a key stay in so many tasks.
TIE_SALTS = 1024


def distinct_on(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[By | str],
    tie_break: Sequence[By | str] = (),
) -> DataFrame:
    """First row per key tuple under `order`, then `tie_break`. NULL keys form one group.

    Filtering `row_number() = 1` lets Spark keep one row per key and input partition before
    the shuffle, so a very frequent key sends at most one row per map task to its reducer.
    """
    full_order = [*order, *tie_break]
    if not full_order:
        raise ValueError("distinct_on needs an order or a tie-break, otherwise the winner is arbitrary")
    w = Window.partitionBy(*keys).orderBy(*sort_columns(full_order))
    return df.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") == 1).drop("_row")


def top_rank(df: DataFrame, keys: Sequence[str], order: Sequence[By | str]) -> DataFrame:
    """All rows with rank 1 per key, ties included. NULL keys form one group.

    Rows are ranked per key and salt first, of which each map task sends its best rows only, so a key's tied rows come to as many tasks as
    there are salts. One row of each (key, salt) then stands for it: the salts with the key's best values are told, and their rows stay
    where they are. `df` is read once.
    """
    given, group, salt = F.struct(*df.columns), "_group", "_salt"
    salted = df.select(
        given.alias("_row"),
        F.struct(*keys).alias(group),  # never NULL, and equal if all keys are or are both NULL
        F.coalesce(F.pmod(F.spark_partition_id(), F.lit(TIE_SALTS)), F.lit(0)).alias(salt),  # so it is known not to be NULL
    )
    best_of = lambda *by: F.rank().over(Window.partitionBy(*by).orderBy(*sort_columns(inside)))
    inside = [By(f"_row.{o.name}", o.descending, o.nulls_first) for o in (By(o) if isinstance(o, str) else o for o in order)]
    local = salted.withColumn("_rank", best_of(group, salt)).filter("_rank = 1").drop("_rank")
    speakers = local.groupBy(group, salt).agg(F.first("_row").alias("_row"))
    winners = speakers.withColumn("_rank", best_of(group)).filter("_rank = 1").select(group, salt)
    return local.join(winners, [group, salt]).select("_row.*")


def newest_versions(
    df: DataFrame,
    key: str | Sequence[str],
    version: str,
    lower=None,
    upper=None,
    on: str | None = None,
) -> DataFrame:
    """One row per key with its largest `version`, among rows whose `on` lies in [lower, upper]."""
    keys = [key] if isinstance(key, str) else list(key)
    return _between(df, lower, upper, on).groupBy(*keys).agg(F.max(version).alias(version))


def _between(df: DataFrame, lower, upper, on: str | None) -> DataFrame:
    if (lower is not None or upper is not None) and on is None:
        raise ValueError("a window needs the column it applies to (on=)")
    if lower is not None:
        df = df.filter(F.col(on) >= F.lit(lower))
    if upper is not None:
        df = df.filter(F.col(on) <= F.lit(upper))
    return df


def latest_version(
    df: DataFrame,
    key: str | Sequence[str],
    version: str,
    lower=None,
    upper=None,
    on: str | None = None,
) -> DataFrame:
    """Rows that carry the largest `version` of their key, among rows whose `on` lies in
    [lower, upper]. NULL keys form one group."""
    keys = [key] if isinstance(key, str) else list(key)
    return top_rank(_between(df, lower, upper, on).filter(F.col(version).isNotNull()), keys, [By(version, descending=True)])
