"""Change detection and neighbouring rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import By, sort_columns
from .ranges import MAX_RANGES, RANGE, with_range
from .skew import ROWS_PER_TASK, KeyProfile, key_profile


def changed_values(df: DataFrame, key: str | Sequence[str], col: str) -> DataFrame:
    """Keys whose `col` takes more than one non-NULL value.

    Two values differ exactly if the smallest and largest do, which needs two numbers per key instead of a set.
    """
    keys = [key] if isinstance(key, str) else list(key)
    bounds = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return bounds.filter(F.col("_lo") < F.col("_hi")).select(*keys)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[By | str],
    cols: Sequence[str],
    profile: KeyProfile | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add `prev_<col>` and `next_<col>`: the values in the row before and after, per key in the given order (ascending with
    NULLs last unless `By` says otherwise). Rows that are equal in keys and order may stand either way.

    A window keeps all rows of a key in one task. So if some key has many rows, all rows are dealt out by ranges of (key, order)
    instead: a window over each range looks at the rows beside each row, whatever their key, and only the first and last row of each range
    look at the ends of the next ranges, one row per range. `profile` takes the result of `key_profile` on a cheaper input with about the
    same keys; by default `df` is looked through. `ranges` is the number of ranges, by default one for `ROWS_PER_TASK` rows.
    """
    keys, cols = list(keys), list(cols)
    profile = key_profile(df, keys) if profile is None else profile
    if not profile.hot:
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        added = {f"prev_{c}": F.lag(c).over(w) for c in cols} | {f"next_{c}": F.lead(c).over(w) for c in cols}
        return df.withColumns(added)

    n = ranges or min(MAX_RANGES, profile.rows // ROWS_PER_TASK + 1)
    ranged = with_range(df, keys, order, n).withColumn("_kh", F.xxhash64(*keys))
    w = Window.partitionBy(RANGE).orderBy("_kh", *[F.col(k).asc_nulls_last() for k in keys], *sort_columns(order))
    seen = F.struct(F.struct(*keys).alias("key"), F.struct(*cols).alias("row"))
    inside = ranged.withColumns({"_seen": seen, "_before": F.lag(seen).over(w), "_after": F.lead(seen).over(w)}).drop("_kh")
    first, last = F.col("_before").isNull(), F.col("_after").isNull()
    ends = inside.filter(first | last).groupBy(RANGE).agg(
        F.first(F.when(first, F.col("_seen")), ignorenulls=True).alias("_head"),
        F.first(F.when(last, F.col("_seen")), ignorenulls=True).alias("_tail"),
    )
    across = Window.orderBy(RANGE)  # one row per range
    borders = ends.select(
        F.col(RANGE).alias("_border"), F.lag("_tail").over(across).alias("_tail"), F.lead("_head").over(across).alias("_head")
    )
    # MAX_RANGES rows at most
    joined = inside.join(F.broadcast(borders), F.when(first | last, F.col(RANGE)) == F.col("_border"), "left")
    before, after = F.coalesce("_before", "_tail"), F.coalesce("_after", "_head")

    def of_key(side: Column, c: str) -> Column:
        return F.when(side["key"] == F.col("_seen.key"), side["row"][c])

    added = {f"prev_{c}": of_key(before, c) for c in cols} | {f"next_{c}": of_key(after, c) for c in cols}
    return joined.withColumns(added).select(*df.columns, *added)
