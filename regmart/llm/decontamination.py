"""Benchmark decontamination: rare n-gram seeds find passages like test items, Smith-Waterman alignment judges them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bag_minhash import mix
from .common import carried, text_or_empty, written

# Seeds are runs of so many words. One is rare if its words, drawn singly, make it at most so likely at a place; of an item
# without enough rare ones the rarest quarter counts. As a paraphrase may replace just the rare words, the rarest seed of so
# many places in a row counts too, all along the item.
SEED, RARITY, LEAST_SHARE, PLACES = 3, 1e-7, 0.25, 3
# Alignment: a word that agrees, one that differs or is missing on either side.
MATCH, MISMATCH, GAP = 2, -1, -1
# An item leaks if an alignment reaches this share of its own score, or that of so many agreeing words in a row.
LEAK_SHARE, LEAK_WORDS = 0.5, 13
# Alignments of fewer agreeing words never count, unless the item is as short and agrees in full.
MIN_WORDS = 8
# Seeds further apart than this begin another passage.
APART = 60
# A seed of more items than this is shared; it takes this part of an item's seeds to look closer by shared ones alone.
SHARED, SHARED_PART = 16, 0.25
CHUNK_CHARS = 8 << 20
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Seeds are looked up in a bitmap of fixed size first, whatever the number of items: 2 MB.
_BITS = 24
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all texts, which of them stand where, and how many words each text has.

    Words are what white space parts, in lower case, without ASCII signs around them; pieces of signs only are no words.
    """
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    names = pc.utf8_trim(coded.dictionary, _SIGNS)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[which] > 0 if len(which) else np.empty(0, bool)
    return names, which[real], np.diff(np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]])


def hashes(names: pa.Array) -> np.ndarray:
    words = names.to_numpy(zero_copy_only=False)
    return mix(pd.util.hash_array(words, categorize=False)) if len(words) else np.empty(0, np.uint64)


def grams(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed that begins at each word, and whether it ends within the text. A shorter text's first seed is all of it."""
    n = len(word)
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(n)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        inside = place + k < ends
        value = np.zeros(n, np.uint64)
        value[inside] = word[np.minimum(place + k, n - 1)[inside]]
        out = mix(out * _GOLDEN + value + np.uint64(k + 1))
    return out, (place + SEED <= ends) | (place == starts)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which of 2^24 places the `key`s fall on; at most 512 rows of 4 kB come to the driver."""
    place = F.pmod("key", F.lit(1 << _BITS))
    rows = (
        keys.select(place.alias("p")).distinct()
        .groupBy(F.floor(F.col("p") / 32768).alias("b"))
        .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m"))
        .collect()
    )
    bits = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in rows:
        bits[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64((1 << _BITS) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of at most `CHUNK_CHARS` bytes of text, or one row."""
    for batch in batches:
        upto, a = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (int(upto[a - 1]) if a else 0) + CHUNK_CHARS)))
            yield batch.slice(a, b - a)
            a = b


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, place, word (hash), key (hash of the seed that begins there) and whole (whether it fits) for all items."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 1):
            names, which, sizes = words_of(batch.column(1))
            word = hashes(names)[which]
            key, whole = grams(word, sizes)
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))),
                "place": np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes),
                "word": word.view(np.int64), "key": key.view(np.int64), "whole": pa.array(whole),
            })

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).dropna(subset=["item_id"])
    return items.dropDuplicates().mapInArrow(listed, "item_id long, place long, word long, key long, whole boolean")


def rare_seeds(texts: DataFrame, words: DataFrame) -> DataFrame:
    """item_id and key of the seeds looked up: rare by how often their words occur in all of `texts`, or the rarest of their place."""
    bits = _bitmap(words.select(F.col("word").alias("key")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in _chunks(batches, 0):
            names, which, _ = words_of(batch.column(0))
            n, word = np.bincount(which, minlength=len(names)), hashes(names)
            held = _in(bits, word) & (n > 0)
            total += len(which)
            yield pa.RecordBatch.from_pydict({"word": word[held].view(np.int64), "n": n[held].astype(np.int64), "total": np.zeros(int(held.sum()), np.int64)})
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.int64()), "n": pa.array([0], pa.int64()), "total": pa.array([total], pa.int64())})

    counts = written(texts.mapInArrow(counted, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = counts.agg(F.sum("total")).first()[0] or 0
    listed = words.join(counts.select("word", "n"), "word", "left")
    # A word that the corpus lacks counts as half a time.
    listed = listed.withColumn("log", F.log(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0.5)) / max(1, total)))
    order = Window.partitionBy("item_id").orderBy("place")
    spans = listed.withColumn("logs", F.sum("log").over(order.rowsBetween(0, SEED - 1))).filter("whole")
    ranked = spans.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("logs", "place")))
    ranked = ranked.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    near = Window.partitionBy("item_id", F.floor(F.col("place") / PLACES)).orderBy("logs", "place")
    ranked = ranked.withColumn("near", F.row_number().over(near))
    kept = ranked.filter((F.col("logs") <= math.log(RARITY)) | (F.col("rank") <= F.ceil(F.col("of") * LEAST_SHARE)) | (F.col("near") == 1))
    return telling_seeds(kept.select("item_id", "key").distinct(), listed.groupBy("item_id").agg(F.count(F.lit(1)).alias("size")))


def telling_seeds(seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """item_id, key, shared (whether more than `SHARED` items have the seed), seeds (of the item) and size (its words).

    A seed that many items begin with, say, tells of none of them. So shared seeds are looked up only for items of which they are `SHARED_PART` of
    all seeds or more, and there it takes as many of them to look closer; other items have seeds of their own all along."""
    items = seeds.groupBy("key").agg((F.count(F.lit(1)) > SHARED).alias("shared"))
    marked = seeds.join(items, "key")
    own = marked.groupBy("item_id").agg(F.count(F.lit(1)).alias("seeds"), F.count_if("shared").alias("shares"))
    told = marked.join(own, "item_id").filter(~F.col("shared") | (F.col("shares") >= F.col("seeds") * SHARED_PART))
    return told.drop("shares").join(sizes, "item_id")


def passages(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """passage, doc_id, digest, words, keys and places (of the seeds): the parts of `texts` (doc_id, digest, text) around seeds (key, size).

    A passage goes beyond each seed by the length of the items that have it, up to the next power of 4; seeds more than `APART` words apart
    begin another one.
    """
    # One bitmap for each power of 4 that some item's length reaches: ten for lengths up to a million.
    reach = seeds.select("key", F.ceil(F.log(F.greatest("size", F.lit(SEED))) / math.log(4)).cast("int").alias("power"))
    powers = sorted(r["power"] for r in reach.select("power").distinct().collect())
    bitmaps = [(4**p, _bitmap(reach.filter(F.col("power") == p).select("key"))) for p in powers]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in _chunks(batches, 2):
            names, which, sizes = words_of(batch.column(2))
            key, whole = grams(hashes(names)[which], sizes)
            margin = np.zeros(len(key), np.int64)
            for length, bits in bitmaps:
                margin[whole & _in(bits, key)] = length
            hit = np.flatnonzero(margin)
            if not len(hit):
                continue
            margin = margin[hit]
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, hit, "right")
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > APART) | (np.diff(doc) > 0)]))
            of = doc[new]
            a = np.maximum(np.minimum.reduceat(hit - margin, new), ends[of] - sizes[of])
            b = np.minimum(np.maximum.reduceat(hit + SEED + margin, new), ends[of])
            n = b - a
            stops = np.cumsum(n)
            inside = which[np.repeat(a - (stops - n), n) + np.arange(int(stops[-1]))]
            offsets = lambda x: pa.array(np.concatenate([[0], x]).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "passage": number + np.arange(len(new)), "doc_id": batch.column(0).take(pa.array(of)), "digest": batch.column(1).take(pa.array(of)),
                "words": pa.ListArray.from_arrays(offsets(stops), names.take(pa.array(inside)).cast(pa.string())),
                "keys": pa.ListArray.from_arrays(offsets(np.concatenate([new[1:], [len(hit)]])), pa.array(key[hit].view(np.int64))),
                "places": pa.ListArray.from_arrays(
                    offsets(np.concatenate([new[1:], [len(hit)]])), pa.array(hit - np.repeat(a, np.diff(np.concatenate([new, [len(hit)]]))))
                ),
            })
            number += len(new)

    schema = "passage long, doc_id long, digest binary, words array<string>, keys array<bigint>, places array<bigint>"
    return written(texts.select("doc_id", "digest", "text").mapInArrow(found, schema))


def seed_pairs(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """passage, item_id, low and high (places of the item's first and last seed in the passage) and size (the item's words): what is aligned.

    A pair has a seed that few items have, or `SHARED_PART` of the item's seeds. Frequent seeds are spread over tasks by the join."""
    at = found.select("passage", F.explode(F.arrays_zip("keys", "places")).alias("hit")).select("passage", F.col("hit.keys").alias("key"), F.col("hit.places").alias("place"))
    hits = at.groupBy("passage", "key").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    met = hits.join(seeds, "key").groupBy("passage", "item_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("size").alias("size"),
        F.count(F.lit(1)).alias("met"), F.max("seeds").alias("seeds"), F.bool_or(~F.col("shared")).alias("own"),
    )
    return met.filter(F.col("own") | (F.col("met") >= F.col("seeds") * SHARED_PART)).drop("met", "seeds", "own")


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score (Smith-Waterman, linear gaps) of each passage and item, both arrays of word numbers.

    All pairs go together, a row of their tables at a time. Gaps along a row are a running maximum.
    """
    n = len(items)
    if not n:
        return np.empty(0)
    q, p = max(map(len, items)), max(map(len, passages))
    item = np.full((n, max(1, q)), -1, np.int64)
    text = np.full((n, max(1, p)), -2, np.int64)
    for i in range(n):
        item[i, : len(items[i])] = items[i]
        text[i, : len(passages[i])] = passages[i]
    step = -GAP * np.arange(item.shape[1] + 1, dtype=np.int64)
    row, best = np.zeros((n, item.shape[1] + 1), np.int64), np.zeros(n, np.int64)
    for j in range(text.shape[1]):
        word = text[:, j : j + 1]
        agree = np.where(item == word, MATCH, MISMATCH)
        agree[:, :][(item < 0)] = MISMATCH
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + agree, row[:, 1:] + GAP), 0)
        row = np.maximum(np.maximum.accumulate(new + step, axis=1) - step, 0)
        np.maximum(best, row.max(axis=1), out=best)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), item_id, score (share of the item's own alignment score) and passages: which text holds which item.

    `docs`: doc_id, text; `benchmark`: item_id, text. Words are counted over all documents, seeds are looked for in whole
    texts: first in a bitmap of fixed size, then by a join of the passages around hits with the items. Null and empty texts hold
    nothing, items without words or id are in no text. Repeated rows and items count once. Other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    words = written(item_words(benchmark))
    seeds = written(rare_seeds(texts.select("text"), words))
    found = passages(texts.withColumn("digest", _digest(F.col("text"))), seeds)
    pairs = seed_pairs(found, seeds)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("item")).dropDuplicates()
    # Of a passage, what the item's own seeds leave within its reach.
    first = F.greatest(F.col("low") - F.col("size"), F.lit(0))
    near = F.slice("words", (first + 1).cast("int"), (F.col("high") + SEED + F.col("size") - first).cast("int"))
    pairs = pairs.join(found.drop("keys", "places"), "passage").withColumn("words", near).join(items, "item_id")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, which, sizes = words_of(part.column(5))
                number = {w: i for i, w in enumerate(dict.fromkeys(names.to_pylist()))}
                own = np.array([number[w] for w in names.to_pylist()], np.int64)
                item = np.split(own[which], np.cumsum(sizes)[:-1])
                text = [np.array([number.get(w, -2) for w in x], np.int64) for x in part.column(4).to_pylist()]
                # Pairs of like length go together, so that little is filled up.
                order = sorted(range(len(text)), key=lambda i: len(text[i]))
                best = np.zeros(len(text))
                for a in range(0, len(order), 32):
                    some = order[a : a + 32]
                    best[some] = align([text[i] for i in some], [item[i] for i in some])
                full = MATCH * np.maximum(1, sizes)
                least = np.minimum(np.maximum(LEAK_SHARE * full, MATCH * np.minimum(MIN_WORDS, sizes)), MATCH * LEAK_WORDS)
                held = (best >= least) & (sizes > 0)
                out = part.select(["doc_id", "digest", "item_id"]).filter(pa.array(held))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array((best / full)[held])], names=["doc_id", "digest", "item_id", "score"])

    columns = ["passage", "doc_id", "digest", "item_id", "words", "item"]
    aligned = pairs.select(*columns).mapInArrow(judged, "doc_id long, digest binary, item_id long, score double")
    return aligned.groupBy("doc_id", "digest", "item_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("passages"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose texts hold no benchmark item, with their columns as they are."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    marked = carried(docs, _digest(text_or_empty()).alias("own"), F.col("doc_id").cast("long").alias("id"))
    on = F.col("own").eqNullSafe(F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id"))
    return marked.join(bad, on, "left_anti").select("row.*")


def op5_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items: the pairs of document and item that leak."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).select("doc_id", "item_id", "score", "passages")


QUERIES = {"op5_rare_seed_alignment": op5_rare_seed_alignment}
ORACLE: dict[str, str] = {}
