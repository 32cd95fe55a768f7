"""Equi-joins whose larger side may hold very frequent keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A frequent key's rows are spread so that about this many come to one task.
ROWS_PER_TASK = 1_000_000
# Sketches of map tasks are merged in this many groups, as there may be very many map tasks, and tell so many keys of each.
_SKETCH_GROUPS = 256
_SKETCH_KEYS = 10_000

# Rows to be repeated are dealt out to so many tasks at most, each of which then makes more.
_REPEAT_TASKS = 20_000

_HOWS = {"inner": "inner", "many_outer": "left", "many_semi": "left_semi", "one_outer": "left"}


def _key_hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*on)


def hot_keys(
    df: DataFrame,
    on: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    max_keys: int | None = None,
    max_salts: int | None = None,
) -> dict[int, int]:
    """Hashes of the most frequent keys of `df`, each with the number of tasks to spread it over. Runs a job.

    All keys that the sketches tell to have `rows_per_task` rows, or only the `max_keys` most frequent of them. So there are about as
    many entries, of a few bytes each, as one task's rows go into the table. Counts come from the frequent-items sketch of `approx_top_k`:
    each map task ships one sketch of bounded size, the keys themselves are not shuffled. Estimates are enough, since a key listed or
    missed by mistake changes only how rows are spread, never a join's result.
    """
    salts = key_profile(df, on, rows_per_task, max_keys).hot
    return {k: min(max_salts or n, n) for k, n in salts.items()}


class KeyProfile(NamedTuple):
    """How many rows a table has, and its frequent keys as `hot_keys` tells them."""

    rows: int
    hot: Mapping[int, int]


def key_profile(df: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK, max_keys: int | None = None) -> KeyProfile:
    """`hot_keys` and the number of rows, in the same job."""
    hashed = df.select(_key_hash(on).alias("_kh"), F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS)).alias("_g"))
    told = max_keys or _SKETCH_KEYS
    tops = hashed.groupBy("_g").agg(F.expr(f"approx_top_k(_kh, {told}, {told * 10})").alias("_top"), F.count(F.lit(1)).alias("_all"))
    # The number of all rows goes as the count of no key, which no hash is.
    items = F.concat("_top", F.array(F.struct(F.lit(None).cast("bigint").alias("item"), F.col("_all").alias("count"))))
    counted = (
        tops.select(F.explode(items).alias("_t"))
        .groupBy(F.col("_t.item").alias("_hot"))
        .agg(F.sum("_t.count").alias("_rows"))
        .filter((F.col("_rows") >= rows_per_task) | F.col("_hot").isNull())
    )
    if max_keys:
        counted = counted.orderBy(F.col("_hot").isNull().desc(), F.col("_rows").desc()).limit(max_keys + 1)
    found = {r["_hot"]: r["_rows"] for r in counted.collect()}
    rows = found.pop(None, 0)
    return KeyProfile(rows, {k: n // rows_per_task + 1 for k, n in found.items()})


def hot_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    hot: Mapping[int, int] | None = None,
    matched: str | None = None,
    **limits: int,
) -> DataFrame:
    """Join `many` to `one` on equally named columns, spreading frequent keys over several tasks.

    Rows of `many` with a frequent key get a salt, the matching rows of `one` are repeated once
    per salt; all other rows are joined as usual. The result is that of the plain join:

    - ``inner``: matching pairs
    - ``many_outer``: all rows of `many`, with NULLs where `one` has no match
    - ``one_outer``: all rows of `one`, with NULLs where `many` has no match. Adaptive execution
      cannot split this one by itself, since the frequent key is on the null-supplying side
    - ``many_semi``: rows of `many` that have a match; `one` may repeat keys, they are folded first

    `hot` takes the result of `hot_keys` on a cheaper input with the same keys; by default `many` is looked through
    (with `limits` as there). `matched`, for ``one_outer``, names a boolean column of `one` that is true exactly for rows
    with a match, if that is known already. The salt is a hash of the row's other columns, so a task run again gives its rows the same.
    """
    if how not in _HOWS:
        raise ValueError(f"how must be one of {list(_HOWS)}")
    on = list(on)
    many_types, one_types = dict(many.dtypes), dict(one.dtypes)
    for c in on:
        if many_types[c] != one_types[c]:
            raise ValueError(f"join column {c} is {many_types[c]} on one side and {one_types[c]} on the other")
    shared = (set(many.columns) & set(one.columns)) - set(on)
    if shared and how != "many_semi":
        raise ValueError(f"columns on both sides: {sorted(shared)}")

    if how == "many_semi":
        one = one.select(*on).distinct()
    if hot is None:
        hot = hot_keys(many, on, **limits)
    if not hot:
        return one.join(many, on, "left") if how == "one_outer" else many.join(one, on, _HOWS[how])

    keys = [*on, "_salt"]
    if how == "one_outer":
        # Salted copies of a preserved row that meet an empty salt must not come out as unmatched
        # rows. So only keys known to exist in `many` are salted, and their unmatched copies go.
        many = flag_hot(many.dropna(subset=on), on, hot)
        if matched is None:
            present = many.filter(F.col("_salts").isNotNull()).select(*on, F.lit(True).alias("_present")).distinct()
            one, matched = one.join(F.broadcast(present), on, "left"), "_present"  # listed keys only
        one = flag_hot(one, on, hot).withColumn("_salts", F.when(F.col(matched), F.col("_salts")))
        joined = _copies(one).join(_spread(many, on).drop("_salts").withColumn("_hit", F.lit(1)), keys, "left")
        kept = joined.filter(F.col("_salts").isNull() | F.col("_hit").isNotNull())
        return kept.drop("_salts", "_hit", "_salt", "_present")

    spread = _spread(flag_hot(many, on, hot), on).drop("_salts")
    copies = _copies(flag_hot(one, on, hot)).drop("_salts")
    return spread.join(copies, keys, _HOWS[how]).drop("_salt")


def repeated(df: DataFrame, times: str, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each row as often as its whole number `times`, which is dropped. About `rows` rows come out, `rows_per_task` of them in a task.

    A row that is repeated often is dealt out in pieces first, so that few rows in one task do not make all of the output there.
    """
    tasks = min(rows // rows_per_task + 1, _REPEAT_TASKS)
    if tasks > 1:
        piece = max(1, rows_per_task // 100)
        n = F.col(times)
        df = df.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.ceil(n / piece).cast("int") - 1)))
        df = df.withColumn(times, F.least(F.lit(piece).cast("bigint"), n - F.col("_piece").cast("bigint") * piece)).drop("_piece").repartition(tasks)
    return df.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(times)


def flag_hot(df: DataFrame, on: Sequence[str], hot: Mapping[int, int]) -> DataFrame:
    """Add `_salts`: the number of tasks for a frequent key, NULL for an ordinary one."""
    listed = df.sparkSession.createDataFrame(list(hot.items()), "_hot bigint, _salts int")
    hashed = df.withColumn("_kh", _key_hash(on))
    # one short row per ROWS_PER_TASK rows of the table, at most
    return hashed.join(F.broadcast(listed), F.col("_kh") == F.col("_hot"), "left").drop("_kh", "_hot")


def _spread(flagged: DataFrame, on: Sequence[str]) -> DataFrame:
    # By what else a row holds, as rows of a key may stand in one partition already; rows of keys alone go by partition.
    others = [c for c, kind in flagged.dtypes if c not in on and c != "_salts" and "map<" not in kind]
    spread = F.xxhash64(*others) if others else F.spark_partition_id()
    return flagged.withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), F.lit(0)))


def _copies(flagged: DataFrame) -> DataFrame:
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    return flagged.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
