"""Events as versions of adverts: a user is an advert id, a user's events of one type are one advert record."""

import datetime as dt

from pyspark.sql import functions as F

from regmart.operators import Period, desc, top_rank
from regmart.plans import (
    AdvertTables,
    advert_history_all,
    advert_history_of,
    advert_snapshots,
    count_advert_history,
    price_steps,
)

from .tables import customer_places, nation_regions, read, text

AS_OF = dt.date(2024, 2, 15)
AGENCIES = ["ASIA", "EUROPE", "AMERICA"]


def _versions(spark, sf_dir):
    """Events with their customer, and the columns all advert tables are made from."""
    return (
        read(spark, sf_dir, "events")
        .join(customer_places(spark, sf_dir), F.col("user_id") == F.col("c_custkey"))
        .withColumn("record", F.concat_ws("-", "user_id", "event_type"))
        .withColumn("price", F.floor(F.col("value") / 300))
    )


def _adverts(spark, sf_dir):
    return _versions(spark, sf_dir).select(
        F.col("event_id").alias("advert_id"),
        F.col("record").alias("bkh"),
        F.col("user_id").alias("src_cian_id"),
        F.col("user_id").alias("src_realty_id"),
        text("c_nationkey").alias("realty_agency_bkh"),
        F.col("event_type").alias("status_bkh"),
        F.col("event_type").alias("advert_category_bkh"),
        text("c_nationkey").alias("housing_complex_block_code"),
        F.col("c_name").alias("housing_complex_name"),
        F.col("price").alias("price_amt"),
        F.col("value").alias("price_sqm_amt"),
        F.col("c_acctbal").alias("total_area_amt"),
        F.col("props").alias("currency_name"),
        F.col("c_nationkey").alias("room_cnt"),
        F.col("value").alias("realty_latitude"),
        F.col("c_acctbal").alias("realty_longitude"),
        F.col("ts").alias("valid_from"),
        (F.col("value") < 1).alias("deleted_flag"),
    )


def _event_types(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_type").distinct()


def advert_tables(spark, sf_dir) -> AdvertTables:
    events = _versions(spark, sf_dir)
    types = _event_types(spark, sf_dir)
    nations = nation_regions(spark, sf_dir)
    statistics = events.select(
        F.col("record").alias("advert_bkh"),
        F.col("ts").alias("valid_from"),
        F.date_trunc("day", "ts").alias("src_update_date"),
        (F.col("event_type") == "signup").alias("deleted_flag"),
    )
    agencies = nations.select(
        text("n_nationkey").alias("bkh"),
        F.col("r_name").alias("realty_agency_name"),
        (F.col("n_name") == "NATION_3").alias("deleted_flag"),
    )
    status = types.select(F.col("event_type").alias("bkh"), F.col("event_type").alias("status_name"))
    archived = status.filter("bkh = 'purchase'").select("bkh", F.lit("archived").alias("status_name"))
    addresses = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src_realty_id"),
        F.col("o_orderpriority").alias("user_address_txt"),
        (F.col("o_orderstatus") != "P").alias("deleted_flag"),
    )
    records = events.groupBy("record", "user_id", "event_type", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment").agg(
        F.min("ts").cast("date").alias("first_day"),
        F.date_trunc("day", F.max("ts")).alias("last_day"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    actual = records.select(
        F.col("record").alias("bkh"),
        F.col("user_id").alias("src_cian_id"),
        F.col("user_id").alias("src_realty_id"),
        text("c_nationkey").alias("realty_agency_bkh"),
        F.col("event_type").alias("status_bkh"),
        text("c_nationkey").alias("advert_category_bkh"),
        text("c_nationkey").alias("building_type_bkh"),
        F.col("first_day").alias("create_date"),
        F.col("high").alias("price_amt"),
        F.col("c_acctbal").alias("total_area_amt"),
        F.col("low").alias("price_sqm_amt"),
        F.col("high").alias("deposit_amt"),
        F.col("c_name").alias("advert_url_txt"),
        F.col("c_nationkey").alias("subway_minute_amt"),
        F.col("c_nationkey").alias("prepay_month_cnt"),
        F.when(F.col("event_type") != "click", F.col("c_mktsegment")).alias("user_address_txt"),
    )
    actual_statistics = records.select(
        F.col("record").alias("advert_bkh"),
        F.col("last_day").alias("src_update_date"),
        F.when(~F.col("event_type").isin("view", "click"), F.col("last_day")).alias("src_upload_date"),
        F.col("n").alias("view_cnt"),
    )
    places = (
        customer_places(spark, sf_dir)
        .select(
            F.col("c_custkey").alias("src_realty_id"),
            F.col("r_name").alias("region_name"),
            F.col("n_name").alias("settlement_name"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("user_address_txt"),
        )
        .union(
            read(spark, sf_dir, "supplier").select(
                "s_suppkey", F.lit("SUPPLY"), F.lower("s_name"), F.col("s_name")
            )
        )
    )
    return AdvertTables(
        adverts=_adverts(spark, sf_dir),
        statistics=statistics,
        agencies=agencies,
        statuses=status.union(archived),
        actual=actual,
        actual_statistics=actual_statistics,
        actual_agencies=agencies,
        actual_statuses=status,
        categories=nations.select(text("n_nationkey").alias("bkh"), F.col("n_name").alias("advert_category_name")),
        actual_addresses=places,
        building_types=read(spark, sf_dir, "region").select(
            text("r_regionkey").alias("bkh"), F.col("r_name").alias("building_type_name")
        ),
        addresses=addresses,
    )


def _advert_history(spark, sf_dir):
    tables = advert_tables(spark, sf_dir)
    return advert_history_all(tables, agency_names=AGENCIES, as_of=AS_OF, open_status="view")


def _advert_history_placed(spark, sf_dir):
    """Versions once per live address in their realty's history."""
    tables = advert_tables(spark, sf_dir)
    return advert_history_all(tables, agency_names=AGENCIES, as_of=AS_OF, open_status="view", only_with_address=True)


def _count_advert_history(spark, sf_dir):
    return count_advert_history(advert_tables(spark, sf_dir), agency_names=AGENCIES)


def _advert_history_one(spark, sf_dir):
    """The adverts with the highest value of their event type."""
    tables = advert_tables(spark, sf_dir)
    events = read(spark, sf_dir, "events").select("event_type", "user_id", "value")
    best = top_rank(events, ["event_type"], [desc("value")]).select("user_id")
    return advert_history_of(tables, best, agency_names=AGENCIES, as_of=AS_OF, open_status="view")


def _price_steps(spark, sf_dir):
    return price_steps(advert_tables(spark, sf_dir), agency_names=AGENCIES)


SNAPSHOT_PERIODS = [
    Period("before", end=dt.datetime(2024, 1, 15)),
    Period("within", dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 29, 23, 59, 59), closed=True),
]


def _period_snapshots(spark, sf_dir):
    types = _event_types(spark, sf_dir)
    name = F.col("event_type")
    statuses = types.select(
        name.alias("bkh"), name.alias("status_name"), F.when(name.isin("error", "signup"), 2).otherwise(1).alias("status_code")
    )
    addresses = customer_places(spark, sf_dir).select(
        F.col("c_custkey").alias("src_realty_id"), F.col("r_name").alias("region_name")
    )
    categories = types.select(
        name.alias("bkh"), F.upper(name).alias("advert_category_code"), name.alias("advert_category_name")
    ).union(types.select(name, F.lower(name), name))
    blocks = read(spark, sf_dir, "nation").select(
        text("n_nationkey").alias("housing_complex_block_code"), text("n_regionkey").alias("building_class_bkh")
    )
    classes = read(spark, sf_dir, "region").select(
        text("r_regionkey").alias("bkh"),
        F.col("r_name").alias("building_class_type"),
        F.lower("r_name").alias("building_class_name"),
    )
    return advert_snapshots(
        _adverts(spark, sf_dir), statuses, addresses, categories, blocks, classes, SNAPSHOT_PERIODS, region="ASIA"
    )


QUERIES = {
    "period_snapshots": _period_snapshots,
    "advert_history": _advert_history,
    "advert_history_placed": _advert_history_placed,
    "count_advert_history": _count_advert_history,
    "advert_history_one": _advert_history_one,
    "price_steps": _price_steps,
}

_BASE = """
        v AS (
          SELECT e.*, c.*, n.n_name, r.r_name, concat(user_id, '-', event_type) AS record,
                 CAST(floor(value / 300) AS BIGINT) AS price
          FROM events e JOIN customer c ON c.c_custkey = e.user_id
          JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
        statuses AS (
          SELECT DISTINCT event_type AS bkh, event_type AS status_name FROM events
          UNION ALL SELECT DISTINCT 'purchase', 'archived' FROM events WHERE event_type = 'purchase'),
        all_data AS (
          SELECT a.event_id AS advert_id, a.user_id AS src_cian_id, a.r_name AS realty_agency_name, a.price AS price_amt,
                 a.c_acctbal AS total_area_amt, a.value AS price_sqm_amt, a.c_nationkey AS room_cnt,
                 a.c_name AS housing_complex_name, date_trunc('day', s.ts) AS valid_from, a.ts AS version_from, a.record AS bkh,
                 t.status_name AS historic_status
          FROM v a JOIN v s ON s.record = a.record AND s.ts = a.ts AND s.event_type <> 'signup'
          JOIN statuses t ON t.bkh = a.event_type
          WHERE a.value >= 1 AND a.n_name <> 'NATION_3' AND a.r_name IN ('ASIA', 'EUROPE', 'AMERICA'))"""

_HISTORY = f"""
        WITH {_BASE},
        dated AS (SELECT *, max(valid_from) OVER (PARTITION BY src_cian_id) AS last_valid_from FROM all_data),
        changed AS (SELECT src_cian_id FROM all_data GROUP BY src_cian_id HAVING count(DISTINCT price_amt) > 1),
        records AS (
          SELECT record, user_id, event_type, c_nationkey, c_acctbal, c_name, c_mktsegment, r_name, n_name,
                 CAST(min(ts) AS DATE) AS first_day, date_trunc('day', max(ts)) AS last_day, max(value) AS high,
                 min(value) AS low, count(*) AS n
          FROM v GROUP BY ALL),
        best AS (
          SELECT * FROM records WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA')
          QUALIFY rank() OVER (PARTITION BY user_id ORDER BY last_day DESC NULLS FIRST,
                  CASE WHEN event_type NOT IN ('view', 'click') THEN last_day END DESC NULLS FIRST) = 1),
        places AS (
          SELECT c_custkey AS realty, r_name AS region, n_name AS settlement,
                 CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS address
          FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
          UNION ALL SELECT s_suppkey, 'SUPPLY', lower(s_name), s_name FROM supplier)
"""

ORACLE = {
    "period_snapshots": """
        WITH base AS (
          SELECT e.*, c.*, p.period, x.cat AS category_code, e.event_type AS category_name, k.r_name AS class_type,
                 lower(k.r_name) AS class_name
          FROM events e
          JOIN (VALUES ('before', TIMESTAMP '1900-01-01', TIMESTAMP '2024-01-14 23:59:59.999999'),
                       ('within', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-29 23:59:59')) p(period, lo, hi)
            ON e.ts BETWEEN p.lo AND p.hi
          JOIN customer c ON c.c_custkey = e.user_id
          JOIN nation n ON n.n_nationkey = c.c_nationkey
          JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_name = 'ASIA'
          LEFT JOIN (SELECT DISTINCT event_type, upper(event_type) AS cat FROM events
                     UNION ALL SELECT DISTINCT event_type, lower(event_type) FROM events) x ON x.event_type = e.event_type
          LEFT JOIN region k ON k.r_regionkey = n.n_regionkey
          WHERE e.value >= 1 AND e.event_type IN ('view', 'click', 'purchase'))
        SELECT period, user_id AS src_cian_id, 'ASIA' AS region_name, value AS price_sqm_amt,
               CAST(floor(value / 300) AS BIGINT) AS price_amt, props AS currency_name, value AS realty_latitude,
               c_acctbal AS realty_longitude, c_nationkey AS room_cnt, c_acctbal AS total_area_amt,
               category_code AS advert_category_code, category_name AS advert_category_name,
               class_type AS building_class_type, class_name AS building_class_name
        FROM base
        QUALIFY row_number() OVER (PARTITION BY period, user_id ORDER BY ts DESC NULLS LAST, value, props, c_acctbal,
                c_nationkey, event_type, CAST(c_nationkey AS VARCHAR), category_code, category_name, class_type) = 1
    """,
    "advert_history": _HISTORY
    + """
        SELECT d.advert_id, d.src_cian_id, d.realty_agency_name, d.price_amt, d.total_area_amt, d.price_sqm_amt,
               d.room_cnt, d.housing_complex_name, d.valid_from, d.last_valid_from, d.bkh, d.historic_status,
               CAST(CASE WHEN b.event_type = 'view' THEN DATE '2024-02-15' - b.first_day
                         ELSE CAST(d.valid_from AS DATE) - b.first_day END AS INTEGER) AS srok,
               b.event_type AS status_name, b.high AS actual_price_amt, b.c_acctbal AS actual_total_area_amt,
               b.low AS actual_price_sqm_amt, b.first_day AS create_date, b.c_name AS advert_url_txt,
               t.r_name AS building_type_name, b.c_nationkey AS subway_minute_amt, b.c_nationkey AS prepay_month_cnt,
               b.high AS deposit_amt, b.n_name AS advert_category_name, b.n AS view_cnt, p.region AS region_name,
               p.settlement AS settlement_name, coalesce(p.address, '(пусто)') AS user_address_txt,
               coalesce(CASE WHEN b.event_type <> 'click' THEN b.c_mktsegment END, '(пусто)') AS user_address_txt2,
               CASE WHEN b.user_id IN (SELECT src_cian_id FROM changed) THEN 'Да' ELSE 'Нет' END AS change_price
        FROM best b
        LEFT JOIN dated d ON d.src_cian_id = b.user_id
        LEFT JOIN region t ON t.r_regionkey = b.c_nationkey
        LEFT JOIN places p ON p.realty = b.user_id
    """,
    "advert_history_one": _HISTORY
    + """
        SELECT d.src_cian_id, d.realty_agency_name, d.price_amt, d.total_area_amt, d.room_cnt, d.housing_complex_name,
               d.valid_from, d.last_valid_from, d.bkh, d.historic_status, h.o_orderpriority AS historic_address,
               CAST(CASE WHEN b.event_type = 'view' THEN DATE '2024-02-15' - b.first_day
                         ELSE CAST(d.valid_from AS DATE) - b.first_day END AS INTEGER) AS srok,
               b.event_type AS status_name, b.high AS actual_price_amt, b.c_acctbal AS actual_total_area_amt,
               b.low AS actual_price_sqm_amt, b.first_day AS create_date, b.c_name AS advert_url_txt,
               t.r_name AS building_type_name, b.c_nationkey AS subway_minute_amt, b.c_nationkey AS prepay_month_cnt,
               b.high AS deposit_amt, b.n_name AS advert_category_name, b.n AS view_cnt, p.region AS region_name,
               p.settlement AS settlement_name, p.address AS user_address_txt,
               CASE WHEN b.user_id IN (SELECT src_cian_id FROM changed) THEN 'Да' ELSE 'Нет' END AS change_price
        FROM best b
        LEFT JOIN dated d ON d.src_cian_id = b.user_id
        LEFT JOIN orders h ON h.o_custkey = d.src_cian_id AND h.o_orderstatus = 'P'
        LEFT JOIN region t ON t.r_regionkey = b.c_nationkey
        LEFT JOIN places p ON p.realty = b.user_id
        WHERE b.user_id IN (SELECT user_id FROM events e
                            WHERE value = (SELECT max(value) FROM events x WHERE x.event_type = e.event_type))
    """,
    "price_steps": f"""
        WITH {_BASE},
        stepped AS (
          SELECT *,
                 lag(version_from) OVER w AS prev_valid_date, lead(version_from) OVER w AS next_valid_date,
                 lag(price_amt) OVER (PARTITION BY src_cian_id, bkh ORDER BY version_from, advert_id, price_amt, historic_status) AS past
          FROM all_data
          WINDOW w AS (PARTITION BY src_cian_id ORDER BY version_from, advert_id, price_amt, bkh, historic_status))
        SELECT advert_id, src_cian_id, realty_agency_name, price_amt, total_area_amt, price_sqm_amt, room_cnt,
               housing_complex_name, valid_from, bkh, historic_status, prev_valid_date, next_valid_date,
               coalesce(CAST(CAST(valid_from AS DATE) - CAST(next_valid_date AS DATE) AS VARCHAR), 'Новое объявление')
                 AS days_to_next,
               coalesce(past, 0) AS past_price
        FROM stepped
    """,
}
ORACLE["count_advert_history"] = f"SELECT count(*) AS row_count FROM ({ORACLE['advert_history']})"
# Versions are joined with the live addresses of their realty, which is the advert id here, before anything is made of them.
ORACLE["advert_history_placed"] = ORACLE["advert_history"].replace(
    "WHERE a.value >= 1 AND", "JOIN orders h ON h.o_custkey = a.user_id AND h.o_orderstatus = 'P'\n          WHERE a.value >= 1 AND"
)
