"""Plans are the ones meant: what is read, what is reduced before a shuffle, what is never planned."""

import datetime as dt
import re

import pytest

from checks import QUERIES
from regmart.operators import KeyProfile, desc, filter_keys, row_count, top_rank, with_neighbours
from regmart.plans import advert_snapshots, deal_rollup, latest_report_lines, property_register, report_extract
from regmart.sources import SCHEMAS, key_table, read_tables, register_views

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Empty register tables on disk."""
    root = str(tmp_path_factory.mktemp("register"))
    for name, ddl in SCHEMAS.items():
        spark.createDataFrame([], ddl).write.parquet(f"{root}/{name}")
    return read_tables(spark, root, SCHEMAS)


def scan(text, column):
    """The scan line whose read schema holds the column."""
    return next(line for line in text.splitlines() if "FileScan" in line and re.search(rf"ReadSchema.*{column}", line))


@pytest.fixture(autouse=True, scope="module")
def long_plans(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", old)


def test_tables_have_declared_types(spark, stored):
    assert len(stored) == len(SCHEMAS)
    assert dict(stored["accounting_report"].dtypes)["line_value"] == "decimal(18,2)"
    register_views({"report": stored["accounting_report"]})
    assert spark.sql("select count(*) from report").collect()[0][0] == 0
    assert [tuple(r) for r in key_table(spark, [1, 2], "spark_id bigint").collect()] == [(1,), (2,)]


def test_report_extract_pushes_the_flag_and_broadcasts_the_list(stored):
    text = plan(report_extract(stored["accounting_report"], list(range(5000))))
    line = scan(text, "deleted_flag")
    assert "Not(EqualTo(deleted_flag,true))" in line and "IsNotNull(spark_id)" in line
    assert "bk_hash" not in line.split("ReadSchema")[1]
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "SortMergeJoin" not in text


def test_latest_report_lines_pushes_window_and_line(stored):
    text = plan(
        latest_report_lines(
            stored["accounting_report"], stored["accounting_report_actual"], stored["cd_inn"], stored["dct_accounting_period"],
            dt.date(2021, 4, 1), dt.date(2021, 4, 18),
        )
    )
    versions = scan(text, "valid_from")
    assert "GreaterThanOrEqual(valid_from" in versions and "LessThanOrEqual(valid_from" in versions
    assert "line_value" not in versions.split("ReadSchema")[1]
    assert "EqualTo(line_code,2100)" in scan(text, "line_value")


def test_snapshots_push_flag_and_periods(stored):
    names = ["advert", "dct_status_actual", "address_actual", "dct_advert_category_actual", "dct_housing_complex_block_actual",
             "dct_building_class_actual"]
    text = plan(advert_snapshots(*[stored[n] for n in names]))
    assert "LessThan(valid_from,2022-06-01" in scan(text, "valid_from") and "deleted_flag" in scan(text, "valid_from")
    assert "EqualTo(region_name,Москва)" in scan(text, "region_name")


def test_deal_rollup_pushes_date_and_type(stored):
    tables = [stored[n] for n in ("deal_actual", "cadastral_doc_actual", "realty_actual", "share_subject_description_actual")]
    text = plan(deal_rollup(*tables))
    assert "GreaterThan(registration_date,2020-01-01)" in scan(text, "registration_date")
    assert "EqualTo(cadastral_doc_type_bkh,6538d008-0e48-9b8c-10a0-d228ec21f9ec)" in scan(text, "cadastral_doc_type_bkh")


def test_first_rows_are_chosen_before_the_shuffle(stored):
    text = plan(property_register(stored["realty_actual"]))
    assert re.search(r"Final.*Exchange.*Partial", text, re.S)
    assert text.count("Exchange") == 1
    assert "room_name" not in scan(text, "cadastral_num").split("ReadSchema")[1]


def final_plan(df):
    df.collect()
    return re.split(r"^\+- == Initial Plan", plan(df), flags=re.M)[0]


def test_ties_are_read_once_and_stay_where_they_are(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderkey")
    text = final_plan(top_rank(orders, ["o_custkey"], [desc("o_totalprice")]))
    assert text.count("ReusedExchange") == 1 and "LeftSemi" not in text
    assert text.count("hashpartitioning(_group") - text.count("ReusedExchange [") <= 2


def test_neighbours_by_ranges_are_shuffled_once(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select("user_id", "ts", "event_id")
    text = final_plan(with_neighbours(events, ["user_id"], ["ts", "event_id"], ["ts"], KeyProfile(1000, {1: 2}), 8))
    main = [line for line in text.splitlines() if "shufflepartitionidpassthrough" in line]
    assert len([line for line in main if "Reused" not in line]) == 1 and len(main) == 2


def test_counting_reads_no_columns(stored):
    assert "ReadSchema: struct<>" in plan(row_count(stored["accounting_report"]))


def test_key_table_semi_join_keeps_the_scan_narrow(stored):
    df = filter_keys(stored["accounting_report"].select("spark_id", "line_code"), "spark_id", stored["cd_inn"])
    assert "struct<spark_id:bigint,line_code:string>" in plan(df)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_plans_a_product_or_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_windows_only_choose_rows_or_look_at_neighbours(spark, name):
    """Windows keep one row per key, limited before the shuffle, or look one row back and ahead, per slice for long keys."""
    text = plan(QUERIES[name](spark, SF_DIR))
    for line in text.splitlines():
        if "Window [" in line and "WindowGroupLimit" not in line:
            assert re.search(r"row_number\(\)|lag\(|lead\(|rank\(.*_group#", line), line
            assert not re.search(r"(max|min|sum|count|collect_list)\(", line), line
