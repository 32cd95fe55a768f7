"""Counts of jobs from per-key counts against the jobs themselves."""

import random

import pytest

from checks import adverts, contracts, deals
from regmart.operators import Counts, row_count
from regmart.plans import advert_history, advert_history_of, contract_pairs, count_advert_history, count_contract_pairs, count_deal_listing, deal_listing

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def number(df):
    return df.first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_joins(spark, seed):
    rng = random.Random(seed)
    some = lambda n, k: [(rng.choice([None, *range(k)]), rng.choice([None, *range(k)])) for _ in range(n)]
    a, b, c = (spark.createDataFrame(some(n, 5), s) for n, s in ((60, "x int, y int"), (40, "x int, z int"), (30, "z int, w int")))
    inner = Counts.of(a, ["x", "y"]).join(b, "x").total()
    assert number(inner) == a.join(b, "x").count()
    left = Counts.of(a, ["x", "y"]).join(b, "x", "left").per("y").total()
    assert number(left) == a.join(b, "x", "left").count()
    chain = Counts.of(a, ["x"]).extend(Counts.of(b, ["x", "z"]), "x").per("z").join(c, "z", "left")
    assert number(chain.total()) == a.join(b, "x").join(c, "z", "left").count()
    assert number(Counts.of(a.filter("x > 99"), ["x"]).join(b, "x").total()) == 0
    with pytest.raises(ValueError):
        Counts.of(a, ["x"]).join(b, "x", "outer")


def test_contract_pairs_and_listing(spark):
    given = contracts._inputs(spark, SF_DIR)
    assert number(count_contract_pairs(*given)) == number(row_count(contract_pairs(*given))) > 0
    given = deals._listing_inputs(spark, SF_DIR)
    counted = count_deal_listing(*given)
    assert number(counted) == number(row_count(deal_listing(*given))) > 0
    assert "Generate" not in plan_of(counted)


@pytest.mark.parametrize("keys", [None, [0, 3, 7, 12]])
@pytest.mark.parametrize("address", [{}, {"with_history_address": True}, {"only_with_address": True}])
def test_advert_history(spark, keys, address):
    tables = adverts.advert_tables(spark, SF_DIR)
    counted = count_advert_history(tables, adverts.AGENCIES, keys, **address)
    rows = advert_history(tables, adverts.AGENCIES, keys=keys, **address)
    assert number(counted) == number(row_count(rows)) > 0
    assert "Generate" not in plan_of(counted)


def test_only_with_address_needs_the_addresses(spark):
    tables = adverts.advert_tables(spark, SF_DIR)._replace(addresses=None)
    for job in (advert_history, count_advert_history):
        with pytest.raises(ValueError):
            job(tables, only_with_address=True)
    with pytest.raises(ValueError):
        advert_history_of(tables, [1])
