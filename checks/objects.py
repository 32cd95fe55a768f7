"""Parts as construction objects, line items as land, declaration and document links, orders as documents."""

from pyspark.sql import functions as F

from regmart.plans import document_rollup, object_rollup

from .tables import read, text


def _lands(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        text("l_partkey").alias("object_bkh"),
        text("l_suppkey").alias("project_declaration_bkh"),
        F.concat_ws(":", "l_suppkey", "l_linenumber").alias("cadastral_num"),
    )


def _prepared(spark, sf_dir):
    return (
        read(spark, sf_dir, "supplier")
        .filter("s_acctbal > 1000")
        .select(text("s_suppkey").alias("project_declaration_prepared_bkh"))
    )


def _object_rollup(spark, sf_dir):
    decl_objects = (
        read(spark, sf_dir, "lineitem")
        .filter("l_linestatus = 'F'")
        .select(
            text("l_suppkey").alias("project_declaration_bkh"),
            text("l_partkey").alias("object_bkh"),
            F.col("l_extendedprice").alias("total_area_amt"),
            F.col("l_quantity").alias("living_area_amt"),
            F.col("l_linenumber").alias("floor_max_cnt"),
            F.col("l_linenumber").alias("floor_min_cnt"),
        )
    )
    objects = read(spark, sf_dir, "part").select(
        text("p_partkey").alias("bkh"),
        F.col("p_size").cast("bigint").alias("src_object_id"),
        F.expr("cast(substring(p_brand, 7) as bigint)").alias("object_id"),
        F.col("p_name").alias("title_name"),
        F.col("p_type").alias("full_address_txt"),
    )
    addresses = read(spark, sf_dir, "lineitem").select(
        text("l_partkey").alias("object_bkh"), F.concat_ws("/", "l_linenumber", "l_linestatus").alias("house_num")
    )
    keys = read(spark, sf_dir, "supplier").select(F.concat(text("s_suppkey"), F.lit(":1")))
    return object_rollup(_lands(spark, sf_dir), _prepared(spark, sf_dir), decl_objects, objects, addresses, keys)


def _document_rollup(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    lineitem = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part")
    files = read(spark, sf_dir, "supplier").select(
        text("s_suppkey").alias("bkh"),
        F.col("s_suppkey").alias("file_id"),
        text("s_nationkey").alias("file_type_bkh"),
        F.col("s_name").alias("file_original_name"),
        F.lower("s_name").alias("file_url_txt"),
    )
    file_types = read(spark, sf_dir, "nation").select(
        text("n_nationkey").alias("bkh"),
        F.when(F.col("n_regionkey") == 1, "10 ").otherwise("10").alias("file_type_code"),
    )
    docs = orders.select(
        text("o_orderkey").alias("bkh"),
        F.col("o_orderkey").alias("document_id"),
        F.col("o_orderstatus").alias("document_type_bkh"),
        F.col("o_orderpriority").alias("document_num"),
        F.col("o_orderdate").cast("date").alias("document_issue_date"),
    )
    doc_types = (
        orders.select(
            F.col("o_orderstatus").alias("bkh"),
            F.when(F.col("o_orderstatus") == "F", "4").otherwise("5").alias("document_type_code"),
        )
        .distinct()
    )
    doc_files = lineitem.select(text("l_orderkey").alias("document_bkh"), text("l_suppkey").alias("file_bkh"))
    doc_objects = lineitem.select(text("l_orderkey").alias("document_bkh"), F.col("l_partkey").alias("src_object_id"))
    objects = part.select(text("p_partkey").alias("bkh"), F.col("p_partkey").alias("src_object_id"))
    keys = part.filter("p_type = 'PROMO'").select("p_partkey")
    return document_rollup(
        files, file_types, doc_files, docs, doc_types, doc_objects, objects, _lands(spark, sf_dir),
        _prepared(spark, sf_dir), keys,
    )


QUERIES = {"object_rollup": _object_rollup, "document_rollup": _document_rollup}

ORACLE = {
    "object_rollup": """
        WITH declared AS (
          SELECT p.*, concat(l.l_suppkey, ':', l.l_linenumber) AS land, d.l_extendedprice AS total,
                 d.l_quantity AS living, d.l_linenumber AS floors
          FROM lineitem l
          JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 1000
          JOIN lineitem d ON d.l_suppkey = l.l_suppkey AND d.l_partkey = l.l_partkey AND d.l_linestatus = 'F'
          JOIN part p ON p.p_partkey = l.l_partkey),
        houses AS (
          SELECT l_partkey, concat(l_linenumber, '/', l_linestatus) AS house
          FROM lineitem)
        SELECT CAST(p_size AS BIGINT) AS oks_xml_id, CAST(substring(p_brand, 7) AS BIGINT) AS oks_id,
               string_agg(DISTINCT land, ',' ORDER BY land) AS cadastral_num,
               string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS title, max(total) AS summary_area,
               max(living) AS living_area, max(floors) AS floor_max, min(floors) AS floor_min,
               string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS full_address,
               string_agg(DISTINCT house, ',' ORDER BY house) AS house_num
        FROM declared LEFT JOIN houses h ON h.l_partkey = p_partkey
        WHERE p_size IN (SELECT p_size FROM declared
                         WHERE land IN (SELECT concat(s_suppkey, ':1') FROM supplier))
        GROUP BY p_size, p_brand
    """,
    "document_rollup": """
        WITH wanted AS (
          SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey AND p_type = 'PROMO'),
        object_lands AS (
          SELECT DISTINCT l_partkey, concat(l_suppkey, ':', l_linenumber) AS land
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 1000)
        SELECT o.o_orderkey AS document_id, string_agg(DISTINCT g.land, ',' ORDER BY g.land) AS cadastral_num,
               string_agg(DISTINCT CAST(b.l_partkey AS VARCHAR), ',' ORDER BY CAST(b.l_partkey AS VARCHAR)) AS oks_xml_id,
               o.o_orderpriority AS document_num, CAST(o.o_orderdate AS DATE) AS document_date, f.s_suppkey AS file_id,
               f.s_name AS file_name, lower(f.s_name) AS file_link
        FROM orders o
        JOIN wanted w ON w.l_orderkey = o.o_orderkey
        JOIN lineitem a ON a.l_orderkey = o.o_orderkey
        JOIN supplier f ON f.s_suppkey = a.l_suppkey
        JOIN nation n ON n.n_nationkey = f.s_nationkey AND n.n_regionkey = 1
        JOIN lineitem b ON b.l_orderkey = o.o_orderkey
        JOIN object_lands g ON g.l_partkey = b.l_partkey
        WHERE o.o_orderstatus = 'F'
        GROUP BY ALL
    """,
}
