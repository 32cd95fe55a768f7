"""Construction objects and their documents, rolled up with land numbers.

Every output value is a maximum, a minimum or a set, which repeated rows do not change. So each
branch (lands, declarations, addresses, files) is reduced per object or document before branches meet, and a plain join
of all of them, whose size is the product of the branches, is never built.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import join_sorted, sorted_set
from ..operators import filter_keys, hot_join, key_filter
from ..session import staged

# Dictionary codes. The file type code has a trailing blank.
DOCUMENT_TYPE_CODE = "4"
FILE_TYPE_CODE = "10 "

_PAIR = ["object_bkh", "project_declaration_bkh"]
# Land numbers of one set of documents, repeated ones counted, that are put together in one row.
SET_VALUES = 1_000_000


def _declared(df: DataFrame, prepared: DataFrame) -> DataFrame:
    """Rows whose declaration is the prepared one."""
    bkh = prepared.select(F.col("project_declaration_prepared_bkh").alias("project_declaration_bkh"))
    return df.join(bkh, "project_declaration_bkh", "left_semi")


def object_rollup(
    lands: DataFrame,
    prepared: DataFrame,
    decl_objects: DataFrame,
    objects: DataFrame,
    addresses: DataFrame,
    keys: DataFrame | Iterable[str],
) -> DataFrame:
    """Per construction object with a land number in `keys`: all its land numbers, titles, addresses and house
    numbers as sorted texts, largest areas, highest and lowest floors. Key texts compare exactly."""
    hits = _declared(filter_keys(lands, "cadastral_num", keys).select(*_PAIR).distinct(), prepared)
    hits = decl_objects.select(*_PAIR).distinct().join(hits, _PAIR, "left_semi").select("object_bkh").distinct()
    cards = objects.withColumnRenamed("bkh", "object_bkh")
    wanted = cards.join(hits, "object_bkh", "left_semi")
    chosen = staged(hot_join(cards, wanted, ["src_object_id"], "many_semi"))
    of_chosen = key_filter(["object_bkh"], chosen.select("object_bkh"))

    extents = (
        of_chosen(decl_objects)
        .groupBy(*_PAIR)
        .agg(
            F.max("total_area_amt").alias("summary_area"),
            F.max("living_area_amt").alias("living_area"),
            F.max("floor_max_cnt").alias("floor_max"),
            F.min("floor_min_cnt").alias("floor_min"),
        )
    )
    landed = _declared(hot_join(of_chosen(lands.select(*_PAIR, "cadastral_num")), extents, _PAIR), prepared)
    # A row for each value of an object, once, with the largest of what stands beside it.
    measures = [*[F.max(c).alias(c) for c in ("summary_area", "living_area", "floor_max")], F.min("floor_min").alias("floor_min")]
    numbers = staged(landed.groupBy("object_bkh", F.lit("num").alias("kind"), F.col("cadastral_num").alias("value")).agg(*measures))
    with_lands = numbers.select("object_bkh").distinct()
    houses = of_chosen(addresses).select("object_bkh", F.lit("house").alias("kind"), F.col("house_num").alias("value")).distinct()
    group = [F.col("src_object_id").alias("oks_xml_id"), F.col("object_id").alias("oks_id")]
    named = chosen.join(with_lands, "object_bkh", "left_semi")
    ids = named.select("object_bkh", *group).distinct()
    own = named.select(
        *group,
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("title", "title_name"), ("address", "full_address_txt"))])
        ).alias("pair"),
    ).select("oks_xml_id", "oks_id", "pair.*")
    pairs = (
        ids.join(numbers, "object_bkh").drop("object_bkh")
        .unionByName(ids.join(houses, "object_bkh").drop("object_bkh"), allowMissingColumns=True)
        .unionByName(own, allowMissingColumns=True)
    )
    rolled = values_by_kind(pairs, ["oks_xml_id", "oks_id"], ["num", "title", "address", "house"], measures)
    return rolled.select(
        "oks_xml_id", "oks_id", F.col("num").alias("cadastral_num"), "title", "summary_area", "living_area", "floor_max", "floor_min",
        F.col("address").alias("full_address"), F.col("house").alias("house_num"),
    )


def values_by_kind(pairs: DataFrame, group: list[str], kinds: list[str], measures: list[Column] = []) -> DataFrame:  # noqa: B006
    """Per group the distinct non-NULL values of each kind as a sorted text, and the measures.

    Pairs (group, kind, value) are made distinct first, in the tasks that read them and again after the shuffle, so that a value is
    collected once, however many branches and rows have it."""
    once = pairs.groupBy(*group, "kind", "value").agg(*(measures or [F.lit(1).alias("_one")]))
    texts = [join_sorted(F.collect_list(F.when(F.col("kind") == k, F.col("value").cast("string")))).alias(k) for k in kinds]
    return once.groupBy(*group).agg(*texts, *measures)


def document_rollup(
    files: DataFrame,
    file_types: DataFrame,
    doc_files: DataFrame,
    docs: DataFrame,
    doc_types: DataFrame,
    doc_objects: DataFrame,
    objects: DataFrame,
    lands: DataFrame,
    prepared: DataFrame,
    keys: DataFrame | Iterable[int],
    document_type: str = DOCUMENT_TYPE_CODE,
    file_type: str = FILE_TYPE_CODE,
) -> DataFrame:
    """Per (document, file) of the given types, for documents about an object in `keys`: the land numbers and ids of
    all objects the document is about, as sorted texts."""
    type_bkh = doc_types.filter(F.col("document_type_code") == document_type).select(
        F.col("bkh").alias("document_type_bkh")
    )
    typed = docs.join(type_bkh, "document_type_bkh", "left_semi").withColumnRenamed("bkh", "document_bkh")
    key_objects = filter_keys(objects.select("src_object_id"), "src_object_id", keys)
    about_keys = hot_join(doc_objects, key_objects, ["src_object_id"], "many_semi").select("document_bkh").distinct()
    wanted = typed.join(about_keys, "document_bkh", "left_semi")
    chosen = staged(hot_join(typed, wanted, ["document_id"], "many_semi"))

    about = filter_keys(doc_objects, "document_bkh", chosen.select("document_bkh"))
    about = staged(about.select("document_bkh", "src_object_id").distinct())
    # Only objects that the documents are about, and only the lands of these, are reduced. An object's land numbers stand in one row,
    # however many documents are about it.
    subject_objects = objects.select(F.col("bkh").alias("object_bkh"), "src_object_id").join(
        about.select("src_object_id"), "src_object_id", "left_semi"
    )
    object_lands = staged(
        _declared(lands, prepared)
        .join(subject_objects.distinct(), "object_bkh")
        .groupBy("src_object_id")
        .agg(F.collect_set(F.col("cadastral_num").cast("string")).alias("lands"))
        .withColumn("n", F.size("lands").cast("bigint"))
    )
    subjects = about.join(object_lands, "src_object_id")
    file_type_bkh = file_types.filter(F.col("file_type_code") == file_type).select(F.col("bkh").alias("file_type_bkh"))
    typed_files = files.join(file_type_bkh, "file_type_bkh", "left_semi").withColumnRenamed("bkh", "file_bkh")
    described = chosen.join(about.join(object_lands.select("src_object_id"), "src_object_id"), "document_bkh", "left_semi")
    # Files know which documents (versions) they are of; the values of such documents are collected once and attached to the files last.
    listed = staged(
        doc_files.select("document_bkh", "file_bkh")
        .join(typed_files, "file_bkh")
        .join(described, "document_bkh")
        .groupBy(
            "document_id", "document_num", F.col("document_issue_date").alias("document_date"), "file_id",
            F.col("file_original_name").alias("file_name"), F.col("file_url_txt").alias("file_link"),
        )
        .agg(sorted_set("document_bkh").alias("versions"))
    )
    versions = listed.select("versions").distinct().withColumn("document_bkh", F.explode("versions"))
    values = land_texts(versions.join(subjects, "document_bkh"))
    return hot_join(listed, values, ["versions"]).select(
        "document_id", F.col("num").alias("cadastral_num"), F.col("id").alias("oks_xml_id"), "document_num", "document_date", "file_id",
        "file_name", "file_link",
    )


def land_texts(subjects: DataFrame, most: int | None = None) -> DataFrame:
    """Per `versions` the land numbers, `num`, and object ids, `id`, of its rows (src_object_id, lands, n: how many) as sorted texts.

    The lands of a set's objects are put together in one row, if there are at most `most` (SET_VALUES), repeated ones counted. Those of
    larger sets are made distinct as pairs first, spread over all tasks. Runs a job that looks for such sets.
    """
    total = subjects.groupBy("versions").agg(F.sum("n").alias("total"))
    large = staged(total.filter(F.col("total") > (SET_VALUES if most is None else most)).select("versions"))
    object_id = F.col("src_object_id").cast("string").substr(1, 255)
    small = subjects if large.isEmpty() else subjects.join(large, "versions", "left_anti")
    texts = small.groupBy("versions").agg(
        join_sorted(F.array_distinct(F.flatten(F.collect_list("lands")))).alias("num"), join_sorted(F.collect_set(object_id)).alias("id")
    )
    if large.isEmpty():
        return texts
    rest = subjects.join(large, "versions", "left_semi")
    pairs = rest.select("versions", F.lit("num").alias("kind"), F.explode("lands").alias("value")).unionByName(
        rest.select("versions", F.lit("id").alias("kind"), object_id.alias("value"))
    )
    return texts.unionByName(values_by_kind(pairs, ["versions"], ["num", "id"]))
