"""Roll-ups: what several steps need is made once, and sets of land numbers by either way."""

import random

import pytest

from checks import QUERIES
from regmart.plans import objects

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_document_rollup_makes_its_branches_once(spark):
    """What is left to do reads no branch again and puts the lands of whole objects together, not one pair after the other."""
    text = plan(QUERIES["document_rollup"](spark, SF_DIR))
    assert "l_orderkey" not in text and "l_partkey" not in text and "flatten(" in text


def test_object_rollup_reads_lands_once(spark):
    """Only the house numbers are read again."""
    assert plan(QUERIES["object_rollup"](spark, SF_DIR)).count("l_suppkey") == 1


@pytest.mark.parametrize("most", [0, 6, 1_000_000])
def test_land_texts(spark, most):
    """Sets with more lands than `most` by pairs, the others in one row; objects without numbers, equal and repeated ones."""
    rng = random.Random(most)
    lands = {i: rng.sample("abcdefgh", rng.randrange(4)) for i in range(6)}
    rows = [([f"d{v}"], i, lands[i], len(lands[i])) for v in range(12) for i in rng.choices(range(6), k=rng.randrange(1, 5))]
    found = objects.land_texts(spark.createDataFrame(rows, "versions array<string>, src_object_id bigint, lands array<string>, n bigint"), most)
    expected = {}
    for v, i, own, _ in rows:
        num, ids = expected.setdefault(v[0], (set(), set()))
        num.update(own)
        ids.add(str(i))
    assert {r["versions"][0]: (r["num"], r["id"]) for r in found.collect()} == {
        v: (",".join(sorted(num)) or None, ",".join(sorted(ids))) for v, (num, ids) in expected.items()
    }
