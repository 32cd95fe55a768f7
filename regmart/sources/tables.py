"""Reading the register tables and key lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One register table, stored as Parquet under `root/name`."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, root, n) for n in names}


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make the tables known to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def key_table(spark: SparkSession, keys: Iterable, ddl: str) -> DataFrame:
    """A short key list as a DataFrame, e.g. `key_table(spark, [1, 2], "spark_id bigint")`."""
    return spark.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], ddl)
