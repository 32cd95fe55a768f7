"""A bitmap of many keys that thins a large table before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a row of a bitmap (a fixed value of Spark's bitmap functions), and rows of the whole: 64 MB, whatever the number of keys.
_ROW_BITS = 32768
BITMAP_ROWS = 16384


def _row(cols: Sequence[str], rows: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(rows)).cast("int")


def _bits(cols: Sequence[str]) -> list[Column]:
    """The two bits of a key in its row, from another hash than the row's."""
    h = F.hash(*cols)
    return [F.pmod(x, F.lit(_ROW_BITS)).cast("int") for x in (h, F.shiftright(h, 15))]


def key_bitmap(keys: DataFrame, cols: Sequence[str], rows: int = BITMAP_ROWS) -> DataFrame:
    """`_row` and `_bitmap` of all keys: at most `rows` rows of 4 KB. Keys go to the rows' tasks as numbers, not as partial bitmaps."""
    places = keys.select(_row(cols, rows).alias("_row"), F.explode(F.array(*_bits(cols))).alias("_bit"))
    return places.repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def thinned(df: DataFrame, cols: Sequence[str], keys: DataFrame, rows: int = BITMAP_ROWS) -> DataFrame:
    """The rows of `df` whose `cols` may be among `keys` (equally named and typed): all that are, and few others; none with a NULL.

    The bitmap has a fixed size and is broadcast; `df` is not shuffled. With the default size 1 in 1,000 other rows is kept for 8 million
    keys, 1 in 20 for 64 million; for several hundred million keys nearly all are.
    """
    cols = list(cols)
    bitmap = F.broadcast(key_bitmap(keys, cols, rows))  # 4 KB * rows at most
    met = df.dropna(subset=cols).withColumn("_row", _row(cols, rows)).join(bitmap, "_row")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substr("_bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return F.getbit(byte.cast("long"), bit % 8) == 1

    first, second = _bits(cols)
    return met.filter(is_set(first) & is_set(second)).select(*df.columns)
