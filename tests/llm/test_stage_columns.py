"""What stages do with the caller's columns, and with benchmark items that share their beginning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmart.llm import bag_minhash, decontamination, mixing

NAMES = ["_own", "_id", "_digest", "own", "row", "probability", "_sampled", "_tokens", "_topic", "_measured", "_cell_0", "digest", "size", "key", "passage", "a.b"]


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, 60), f"l{i % 2}", "s", 1, *[f"{n}-{i}" for n in NAMES]) for i in range(30)]
    rows += [(30, rows[3][1], "l0", "s", 1, *NAMES)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_columns_come_through(spark, clashing):
    item = spark.createDataFrame([(1, clashing.filter("doc_id = 5").first().text)], "item_id long, text string")
    given = {r.doc_id: r for r in clashing.collect()}
    for name, kept, most in (
        ("near_dedup", bag_minhash.drop_near_copies(clashing), 30),
        ("decontamination", decontamination.drop_leaks(clashing, item), 30),
        ("mixing", mixing.sample_mixture(clashing), 30),
    ):
        rows = kept.collect()
        assert kept.columns == clashing.columns and 0 < len(rows) <= most, name
        assert all(r == given[r.doc_id] for r in rows), name
    assert 5 not in {r.doc_id for r in decontamination.drop_leaks(clashing, item).collect()}


def test_items_with_one_beginning_are_not_aligned_with_every_text(spark, monkeypatch):
    """A run of words stands in every third text and begins all items: no alignments for it alone, and leaks are still found."""
    rng = np.random.default_rng(2)
    common = words(rng, 9)
    texts = [(i, words(rng, 80) + (f" {common} " if i % 3 == 0 else " ") + words(rng, 80)) for i in range(150)]
    seen = []
    real = decontamination.seed_pairs
    monkeypatch.setattr(decontamination, "seed_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    made = {}
    for n in (100, 400):
        items = [(i, f"{common} {words(rng, 50, 100_000)}") for i in range(n)]
        planted = [(1000 + i, f"{words(rng, 30)} {items[i][1]} {words(rng, 30)}") for i in range(5)]
        docs = spark.createDataFrame(texts + planted, "doc_id long, text string").repartition(4)
        bench = spark.createDataFrame(items, "item_id long, text string")
        found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
        assert found == {(1000 + i, i) for i in range(5)}
        made[n] = seen[-1].count()
    assert made[400] <= 2 * made[100]
    # Items that are little more than the run are compared with all texts that have it.
    items = [(i, f"{common} {words(rng, 2, 100_000)}") for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    assert found.select("doc_id").distinct().count() == 50 and found.count() == 50 * 40


def test_a_long_item_does_not_lengthen_the_others_passages(spark):
    rng = np.random.default_rng(3)
    items = [(0, words(rng, 3000, 10**6)), (1, words(rng, 20, 10**6))]
    docs = spark.createDataFrame([(1, f"{words(rng, 4000)} {items[1][1]} {words(rng, 4000)}"), (2, f"{words(rng, 50)} {items[0][1]} x")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = docs.withColumn("digest", F.lit(b"1"))
    seeds = decontamination.rare_seeds(docs.select("text"), decontamination.item_words(bench))
    sizes = {r.doc_id: len(r.words) for r in decontamination.passages(texts, seeds).collect()}
    assert sizes[1] < 200 and sizes[2] > 3000
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(1, 1), (2, 0)}
