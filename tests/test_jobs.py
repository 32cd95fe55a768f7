"""Jobs on hand-made rows with the expected result written out."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regmart.functions.table_functions import register_table_functions
from regmart.plans import (
    contract_pairs,
    counterparty_check,
    deal_listing,
    include_list,
    latest_report_lines,
    property_register,
    report_extract,
    request_stats,
)
from regmart.plans.flags import RISK_FLAGS
from regmart.sources import SCHEMAS, register_views

D, TS = dt.date, dt.datetime


@pytest.fixture
def table(spark):
    """table(name, {column: value}, ...): rows of a register table, other columns NULL."""

    def make(name, *dicts):
        empty = spark.createDataFrame([], SCHEMAS[name])
        return spark.createDataFrame([tuple(d.get(c) for c in empty.columns) for d in dicts], empty.schema)

    return make


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: [(v is None, str(v)) for v in r])


def test_counterparty_check(table):
    base = {f: "0" for f in RISK_FLAGS}
    checks = table(
        "counterparty_checks",
        {**base, "inn": "1", "check_result": "RED FLAG", "debt_flag": "1", "age_flag": None},
        {**base, "inn": "1", "check_result": "GREEN FLAG"},
        {**base, "inn": "2", "check_result": "APPROVAL", "bl_flag": "t"},
        {**base, "inn": "2", "check_result": "PENDING"},
        {**base, "inn": "2"},
        {**base, "inn": "3", "check_result": "APPROVAL"},
    )
    found = counterparty_check(checks, ["1", "2"])
    assert rows(found, "inn", "check_result", "check_res", "debt_flag", "age_flag", "bl_flag") == [
        ("1", "GREEN FLAG", True, False, False, False),
        ("1", "RED FLAG", False, True, None, False),
        ("2", "APPROVAL", True, False, False, True),
        ("2", "PENDING", None, False, False, False),
        ("2", None, None, False, False, False),
    ]
    assert len(found.columns) == 14 + 22 + 4
    assert counterparty_check(checks).count() == 6
    broken = table("counterparty_checks", {**base, "inn": "1", "debt_flag": "perhaps"})
    with pytest.raises(PySparkException):
        counterparty_check(broken, ["1"]).collect()
    assert rows(counterparty_check(broken, ["1"], strict=False), "debt_flag") == [(None,)]


def test_include_list_and_sql_functions(spark, table):
    lists = table(
        "include_lists",
        {"list_name": "a", "inn": "7707049388", "ogrn": "5", "kpp": "1"},
        {"list_name": "b", "inn": "7707049388", "ogrn": "6", "kpp": "2"},
        {"list_name": "c", "inn": "3904085758", "ogrn": "5"},
    )
    requests = [("7707049388", "", ""), ("3904085758", "", ""), ("", "5", ""), ("7707049388", "", "2")]
    found = include_list(lists, requests)
    assert rows(found, "request_inn", "request_ogrn", "request_kpp", "list_name") == [
        ("", "5", "", "a"), ("", "5", "", "c"), ("3904085758", "", "", "c"), ("7707049388", "", "", "a"),
        ("7707049388", "", "", "b"), ("7707049388", "", "2", "b")]

    register_views({"include_lists": lists, "counterparty_checks": table("counterparty_checks", {"inn": "7", "bl_flag": "1"})})
    register_table_functions(spark)
    for request in requests:
        expected = found.filter(" and ".join(f"request_{k} = '{v}'" for k, v in zip(("inn", "ogrn", "kpp"), request)))
        by_sql = spark.sql(f"SELECT list_name FROM include_list{request}")
        assert rows(by_sql) == rows(expected, "list_name")
    checked = spark.sql("SELECT spark_id, cast(bl_flag AS boolean) AS bl FROM counterparty_check_by_inn('7', '0')")
    assert rows(checked) == [(None, True)]


def test_report_extract(table):
    reports = table(
        "accounting_report",
        {"spark_id": 262342, "line_code": "2100", "deleted_flag": False, "line_value": Decimal("1.50")},
        {"spark_id": 262342, "line_code": "2110", "deleted_flag": True},
        {"spark_id": 262342, "line_code": "2120"},
        {"spark_id": 5, "line_code": "2100", "deleted_flag": False},
        {"line_code": "2100", "deleted_flag": False},
    )
    found = report_extract(reports, [262342, 262342, 918202])
    assert rows(found, "spark_id", "line_code", "line_value") == [(262342, "2100", Decimal("1.50"))]
    assert len(found.columns) == 11


def test_latest_report_lines(table):
    def version(id, hash, company, at):
        return {"accounting_report_id": id, "bk_hash": hash, "spark_id": company, "valid_from": at}

    reports = table(
        "accounting_report",
        version(1, "h1", 10, TS(2021, 4, 1)),
        version(2, "h1", 10, TS(2021, 4, 18)),
        version(3, "h1", 10, TS(2021, 4, 18, 0, 0, 1)),  # after midnight of the last day: outside
        version(4, "h2", 10, TS(2021, 4, 5)),  # newest in the window, but replaced since
        version(5, "h3", 99, TS(2021, 4, 5)),  # company out of scope
        version(6, None, 10, TS(2021, 4, 6)),
        version(2, "h4", 10, TS(2021, 4, 6)),  # the same id under another hash counts again
    )

    def line(id, code, period="p"):
        return {"accounting_report_id": id, "bk_hash": f"row{id}", "line_code": code, "accounting_period_code": period}

    actual = table(
        "accounting_report_actual", line(2, "2100"), line(2, "2110"), line(3, "2100"), line(5, "2100"), line(6, "2100"),
        line(6, "2100", "unknown"),
    )
    scope = table("cd_inn", {"spark_id": 10}, {"spark_id": 10}, {"spark_id": None})
    periods = table("dct_accounting_period", {"code": "p", "period_name": "Q1"})
    found = latest_report_lines(reports, actual, scope, periods, D(2021, 4, 1), D(2021, 4, 18))
    assert rows(found, "bk_hash", "period_name", "status", "line_code") == [
        ("row2", "Q1", True, "2100"), ("row2", "Q1", True, "2100"), ("row6", "Q1", True, "2100")]


def test_contract_pairs(table):
    entities = table(
        "legal_entity_actual",
        {"spark_id": 1, "inn": "7707049388", "kpp": "784201001", "ogrn": "o1", "full_name_rus": "one"},
        {"spark_id": 2, "inn": "7707049388", "kpp": "784201001", "ogrn": "o2", "full_name_rus": "two"},
        {"spark_id": 3, "inn": "7707049388", "kpp": "other", "ogrn": "o3", "full_name_rus": "three"},
        {"spark_id": 4, "inn": "7707049388", "ogrn": "o4", "full_name_rus": "four"},
    )

    def part(company, contract, code, role):
        return {"spark_id": company, "contract_code": contract, "contract_participant_code": code, "state_contract_role_code": role}

    participants = table(
        "state_contract_participant_actual",
        part(1, "c1", "p1", "2"), part(2, "c1", "p2", "1"),
        part(3, "c1", "p3", "1"),  # not one of the companies
        part(1, "c2", "p1", "2"), part(1, "c2", "p9", "1"),  # customer missing in the dictionary
        part(1, "c3", "p4", "2"), part(2, "c3", "p2", "1"),  # supplier code registered for another INN
        part(2, "c4", "p2", "2"), part(1, "c4", "p1", "1"), part(2, "c4", "p5", "1"),
        part(1, "gone", "p1", "2"), part(2, "gone", "p2", "1"),  # no such contract
    )

    def known(code, company, inn):
        return {"code": code, "participant_spark_id": company, "participant_inn_code": inn, "participant_name": f"n-{code}"}

    dictionary = table(
        "dct_contract_participant_actual", known("p1", 1, "7707049388"), known("p2", 2, "7707049388"),
        known("p3", 3, "7707049388"), known("p4", 1, "5"), known("p5", None, "7707049388"),
    )
    contracts = table("state_contract_actual", *[{"code": c, "contract_subject_txt": c} for c in ("c1", "c2", "c3", "c4")])
    found = contract_pairs(entities, participants, dictionary, contracts, [("7707049388", "784201001")])
    assert rows(found, "ogrn", "short_name_rus", "full_name_rus", "contract_subject_txt") == [
        ("o1", "n-p2", "two", "c1"), ("o2", "n-p1", "one", "c4"), ("o2", "n-p5", None, "c4")]


def test_property_register(table):
    realty = table(
        "realty_actual",
        {"cadastral_num": "77:1", "realty_type_bkh": "b", "region_code": "1"},
        {"cadastral_num": "77:1", "realty_type_bkh": "a", "region_code": "2"},
        {"cadastral_num": "77:1", "realty_type_bkh": None, "region_code": "0"},
        {"cadastral_num": "77:1 ", "realty_type_bkh": "z"},
        {"realty_type_bkh": "n", "region_code": "7"}, {"realty_type_bkh": "n", "region_code": "8"},
    )
    day = D(2022, 7, 1)
    assert rows(property_register(realty, day)) == [
        ("77:1", "a", "2", day), ("77:1 ", "z", None, day), (None, "n", "7", day)]
    assert property_register(realty).filter(F.col("create_dt").between(F.date_sub(F.current_date(), 1), F.current_date())).count() == 3


def test_deal_listing_rejects_bad_type_codes(table):
    realty = table("realty_actual", {"bkh": "r"})
    deals = table("deal_actual", {"bkh": "d", "realty_bkh": "r", "registration_date": D(2022, 1, 1)})
    docs = table("cadastral_doc_actual", {"reference_bkh": "d", "cadastral_doc_type_bkh": "t"})
    rest = [table(n) for n in ("share_subject_description_actual", "realty_address_actual", "dct_region_actual")]
    good = table("dct_cadastral_doc_type_actual", {"bkh": "t", "cadastral_doc_type_code": " 558401010201"})
    assert deal_listing(realty, deals, docs, good, *rest).count() == 1
    bad = table("dct_cadastral_doc_type_actual", {"bkh": "t", "cadastral_doc_type_code": "x1"})
    with pytest.raises(PySparkException):
        deal_listing(realty, deals, docs, bad, *rest).collect()


def test_request_stats(table):
    def request(second, name, ms, length=1, error=None):
        at = TS(2024, 1, 1, 0, second // 60, second % 60)
        return {"event_time": at, "query_name": name, "response_time_ms": ms, "response_length": length, "exception": error}

    log = table(
        "request_log", request(1, "a", 100), request(2, "a", 300), request(3, "a", 200, 4, "boom"), request(4, "a", None, None, "x"),
        request(61, "a", 50), request(2, "b", 10),
    )
    columns = ["query_name", "bucket_start", "requests", "failures", "failure_rate", "mean_ms", "p50_ms", "total_length"]
    first, second = TS(2024, 1, 1), TS(2024, 1, 1, 0, 1)
    expected = [("a", first, 4, 2, 0.5, 200.0, 200, 6), ("a", second, 1, 0, 0.0, 50.0, 50, 1), ("b", first, 1, 0, 0.0, 10.0, 10, 1)]
    assert rows(request_stats(log), *columns) == expected
    assert rows(request_stats(log, exact=True), *columns) == expected
    tail = request_stats(log, exact=True).filter("query_name = 'a' and requests = 4").select("p95_ms", "p99_ms").collect()[0]
    assert tuple(round(v, 6) for v in tail) == (290.0, 298.0)
