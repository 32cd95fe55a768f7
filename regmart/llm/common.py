"""Helpers shared by the operators: written intermediate tables, joins to group results, document folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# A group with at least this share of all rows is joined by broadcast; there are at most as many such groups.
HOT_SHARE = 1000
# A repeated row is counted, and repeated again at the end in blocks of so many rows.
_BLOCK = 100_000


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share, as `spark.checkpoint.dir` names it."""
    return f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = work_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def carried(docs: DataFrame, *columns: Column) -> DataFrame:
    """`row`, all of the caller's columns in one, and the given columns: whatever the caller's are called, nothing clashes. `row.*` has them back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *columns)


def fold(col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join `rows` to one row per group, none of whose `key`s is null, without piling a frequent key's rows up.

    Groups of at least a thousandth of `total` rows, of which there are a thousand at most, are broadcast. Rows
    of all other groups are shuffled, so that no key holds more than a thousandth of them.
    """
    hot = groups.filter(F.col(size) * HOT_SHARE >= total)
    cold = groups.filter(F.col(size) * HOT_SHARE < total)
    listed = F.broadcast(hot)  # at most HOT_SHARE rows
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(listed, key, "inner").unionByName(rest.join(cold, key, how))


def repeated(rows: DataFrame) -> DataFrame:
    """Each row `n` times. `kept` is true for the first of them if its doc_id is keep_id."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _BLOCK))))
    here = F.least(F.lit(_BLOCK), F.col("n") - F.col("block") * _BLOCK)
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1), here.cast("int"))))
    first = (F.col("block") == 0) & (F.col("copy") == 1)
    return copies.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & first)
