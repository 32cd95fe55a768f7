"""Row selection by keys and flags."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import thinned
from .skew import ROWS_PER_TASK, hot_join, repeated

# Keys of up to so many bytes, measured beforehand, are broadcast; a value counts 16 bytes besides its text.
BROADCAST_BYTES = 64 << 20
_VALUE_BYTES = 16


def key_frame(df: DataFrame, cols: Sequence[str], rows: Iterable) -> DataFrame:
    """Caller's key rows as a distinct DataFrame with the types of `cols` in `df`, broadcast if short."""
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in cols])
    tuples = list(dict.fromkeys(r if isinstance(r, tuple) else (r,) for r in rows))
    frame = df.sparkSession.createDataFrame(tuples, schema)
    size = sum(_VALUE_BYTES + len(str(v).encode()) for t in tuples for v in t)
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of `df` hold at most `max_bytes`. Runs a job that sends one number per task."""
    texts = [F.coalesce(F.octet_length(df[c].cast("string")), F.lit(0)) + _VALUE_BYTES for c in df.columns]
    return (df.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0) <= max_bytes


def key_filter(
    cols: Sequence[str], keys: DataFrame | Iterable, broadcast_bytes: int = BROADCAST_BYTES
) -> Callable[[DataFrame], DataFrame]:
    """A function keeping the rows whose `cols` are among `keys`, to be applied to one or more DataFrames.

    A list, or a DataFrame measured to hold at most `broadcast_bytes`, is broadcast, and the filtered rows are not shuffled. For longer
    keys a bitmap of them thins the rows where they are read; the few that remain are joined exactly, with those of frequent keys spread.
    """
    cols = list(cols)
    if not isinstance(keys, DataFrame):
        listed = list(keys)
        return lambda df: df.join(key_frame(df, cols, listed), cols, "left_semi")
    if len(keys.columns) != len(cols):
        raise ValueError(f"keys must have {len(cols)} column(s)")
    distinct = keys.toDF(*cols).distinct()
    short = fits_broadcast(distinct, broadcast_bytes)

    def apply(df: DataFrame) -> DataFrame:
        typed = _with_types_of(df, cols, distinct)
        if short:
            return df.join(F.broadcast(typed), cols, "left_semi")
        # Keys are distinct, so this is the semi-join, which Spark would push below the bitmap's join.
        return hot_join(thinned(df, cols, typed), typed, cols, "inner")

    return apply


def filter_keys(df: DataFrame, col: str, keys: DataFrame | Iterable) -> DataFrame:
    """Rows whose `col` is among `keys`: a list, or a one-column DataFrame. Texts compare exactly.

    Always a semi-join: rows are never multiplied, and repeated or NULL keys change nothing. Filter `df` before rather than
    after, as conditions on the result may not reach its scan.
    """
    return key_filter([col], keys)(df)


def filter_key_tuples(df: DataFrame, cols: Sequence[str], keys: DataFrame | Iterable) -> DataFrame:
    """As `filter_keys`, for keys of several columns given in the order of `cols`."""
    return key_filter(cols, keys)(df)


def _with_types_of(df: DataFrame, cols: Sequence[str], keys: DataFrame) -> DataFrame:
    """Keys with whole numbers widened to the column's type; other types must be the same."""
    for c in cols:
        wanted, given = df.schema[c].dataType, keys.schema[c].dataType
        if wanted != given:
            if not (isinstance(wanted, T.IntegralType) and isinstance(given, T.IntegralType)):
                raise ValueError(f"{c} is {wanted.simpleString()}, its keys are {given.simpleString()}")
            keys = keys.withColumn(c, F.col(c).try_cast(wanted))
    return keys


def active_only(df: DataFrame, flag: str = "deleted_flag") -> DataFrame:
    """Rows whose flag is false; rows with a NULL flag are dropped as well."""
    return df.filter(~F.col(flag))


def optional_key_lookup(
    rows: DataFrame,
    requests: DataFrame | Iterable[tuple],
    cols: Sequence[str],
) -> DataFrame:
    """Rows matching each request, where `''` in a request means "any value".

    Output: `request_<col>` columns, then all columns of `rows`; a row is repeated once per request it
    matches. A NULL in a request matches nothing.

    A request looks its rows up by the rarest of the values it gives, as counted in `rows`; its other values are tested on what is found.
    So a row is offered once per column that some request looks up by, and meets the requests for its value there. Values that
    many rows have are spread over tasks. Equal requests are looked up once and what they find is repeated last, dealt out to tasks by the
    number of rows that come out. Requests that give no value are all alike: each row is repeated as often as there are such
    requests, without a join. One job counts the values that requests give and tells the frequent ones.
    """
    cols, names = list(cols), [f"request_{c}" for c in cols]
    if not isinstance(requests, DataFrame):
        requests = key_frame(rows, cols, [tuple(r) for r in requests])
    asked = requests.toDF(*names).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("_times"))
    chosen = _with_rarest_value(rows, asked, cols)
    profile = {
        r["_by"]: r
        for r in chosen.groupBy("_by")
        .agg(
            F.max("_times").alias("times"),
            F.sum(F.col("_n").cast("double") * F.col("_times")).alias("rows"),
            # one value per ROWS_PER_TASK rows at most
            F.collect_set(F.when(F.col("_n") >= ROWS_PER_TASK, F.struct(F.xxhash64("_value").alias("hash"), "_n"))).alias("hot"),
        )
        .collect()
    }
    found = []
    for i, c in enumerate(cols):
        if i in profile:
            by_value = chosen.filter(F.col("_by") == i).select(F.col("_value").alias(c), *names, "_times")
            hot = {h["hash"]: h["_n"] // ROWS_PER_TASK + 1 for h in profile[i]["hot"]}
            others = [F.col(n).isin("", F.col(k)) for n, k in zip(names, cols) if k != c]
            met = hot_join(rows, by_value, [c], "inner", hot=hot)
            found.append((met.filter(reduce(lambda a, b: a & b, others)) if others else met, profile[i]["times"], profile[i]["rows"]))
    if -1 in profile:
        blank = [F.lit("").alias(n) for n in names]
        times = profile[-1]["times"]
        found.append((rows.select(*blank, *rows.columns, F.lit(times).alias("_times")), times, times * rows.count() if times > 1 else 0))
    if not found:
        return rows.limit(0).select(*[F.lit("").alias(n) for n in names], *rows.columns)
    parts = [
        (df if times == 1 else repeated(df, "_times", int(n), ROWS_PER_TASK)).select(*names, *rows.columns)
        for df, times, n in found
    ]
    return reduce(DataFrame.unionByName, parts)


def _with_rarest_value(rows: DataFrame, asked: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Requests with `_by`, the place of the column whose given value the fewest rows have (-1 if none is given), that `_value` and how many, `_n`.

    Rows are counted per value in the tasks that read them; only values that are asked for are shuffled further."""
    given = lambda c: F.col(f"request_{c}") != ""
    pair = lambda i, value: F.struct(F.lit(i).alias("_by"), value.alias("_value"))
    counted = asked
    for i, c in enumerate(cols):
        values = asked.filter(given(c)).select(F.col(f"request_{c}").alias(c)).distinct()
        n = rows.select(c).join(values, c, "left_semi").groupBy(F.col(c).alias(f"request_{c}")).agg(F.count(F.lit(1)).alias(f"_n{i}"))
        counted = counted.join(n, f"request_{c}", "left")
    choices = [F.when(given(c), F.struct(F.coalesce(f"_n{i}", F.lit(0)).alias("_n"), *(pair(i, F.col(f"request_{c}"))[f].alias(f) for f in ("_by", "_value")))) for i, c in enumerate(cols)]
    best = F.array_min(F.array_compact(F.array(*choices)))
    return counted.select(
        *asked.columns, F.coalesce(best["_by"], F.lit(-1)).alias("_by"), best["_value"].alias("_value"), F.coalesce(best["_n"], F.lit(0)).alias("_n")
    )
