"""Exact de-duplication: local groups, salted digest groups, then the salts' winners; the full text is compared throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, repeated, text_or_empty, written

# The copies of one text are merged in so many groups first.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of `docs`: the group of equal texts it is in. Of each group the row with the largest id stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Only built-in functions are used.

    1. Each task folds its own rows of one text before anything is shuffled (partial aggregation).
    2. Rows are grouped by digest, salt and full text, so that the copies of one text meet in `salts` groups.
    3. The winners of the salts are grouped by digest and full text.

    Each row then finds its group by its digest, and by digest and full text where different texts share a digest.

    Nulls: a null text counts as empty, a null id as smaller than any other. Repeated rows (same id and text) count
    one by one and all come out, one of them kept at most. An empty table gives no rows. Other columns are not looked
    at, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = given.withColumn("digest", digest(F.col("text")))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    by_salt = salted.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # One exchange by digest serves both groupings below; it gets at most `salts` rows of a text.
    by_text = (
        by_salt.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    groups = written(
        by_text.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
        )
    )
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    alone = groups.filter("texts = 1").drop("texts")
    shared = groups.filter("texts > 1").select("digest")
    rows = keyed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    found = join_groups(rows, alone, "digest", "group_size", total)
    if shared.head(1):
        compared = by_text.join(shared, "digest", "left_semi").withColumnRenamed("digest", "_d").withColumnRenamed("text", "_t")
        mixed = keyed.join(shared, "digest", "left_semi").groupBy("doc_id", "digest", "text").agg(F.count(F.lit(1)).alias("n"))
        on = (F.col("digest") == F.col("_d")) & (F.col("text") == F.col("_t"))
        more = mixed.join(compared, on).withColumn("digest", sha256(F.col("text")))
        found = found.unionByName(more.select(*found.columns))
    return repeated(found).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.col("digest")).alias("text_sha256")
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, with unchanged texts compared."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
        FROM d"""
}
