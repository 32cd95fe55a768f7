"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, exact verification, classes.

A text is the multiset of its shingles of five words. The weight of a shingle, how often it occurs, is cut at powers of two into
intervals, each with a Poisson process of its own whose rate is the interval's length. A point has a time, a register of the signature and a
level within its interval, all from a hash of shingle and interval; it counts if its level is below the weight. The least
time in a register is then the same in two texts with a probability equal to their weighted Jaccard similarity. Points
come in order of time, so a process is followed only until it is later than all registers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, join_groups, repeated, text_or_empty, written

SHINGLE = 5
SIMILARITY = 0.8
# 24 bands of 5 registers: two texts of similarity 0.8 share a band with probability 0.99993, of 0.9 with 1 - 1e-9.
BANDS, ROWS = 24, 5
# Rounds in which the nodes of a bucket that are apart from its main component are held against one of its nodes.
ROUNDS = 2
# Tasks work on so many characters at a time.
CHUNK_CHARS = 2 << 20
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and how many each has.

    Words are what white space parts, in lower case, without ASCII signs around them; pieces of signs only are no words. A
    text of fewer words than a shingle has one shingle of all its words, a text without words has none.
    """
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, _SIGNS).to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(words, categorize=False) if len(words) else np.empty(0, np.uint64)
    real = words != ""
    which = coded.indices.to_numpy(zero_copy_only=False)
    held = real[which] if len(words) else np.empty(0, bool)
    flat = mix(hashed[which][held])
    n = np.diff(np.concatenate([[0], np.cumsum(held)])[offsets - offsets[0]])
    starts = np.cumsum(n) - n
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    last = np.repeat(starts + n, many)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = first + k
        inside = at < last
        word = np.zeros(len(first), np.uint64)
        word[inside] = flat[at[inside]]
        out = mix(out * _GOLDEN + word + np.uint64(k + 1))
    return out, many


def bag(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of each distinct shingle of each document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.concatenate([at, [len(doc)]]))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Least time per document and register; infinite for documents without elements.

    All processes of all documents make their next point together, round by round, until none is earlier than its
    document's latest register.
    """
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    owner = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    seed = mix(element[owner] + _GOLDEN * (level + 1).astype(np.uint64))
    doc, limit, time = doc[owner], weight[owner], np.zeros(len(owner))
    best = np.full(n_docs * registers, np.inf)
    latest = np.full(n_docs, np.inf)
    while len(doc):
        seed = seed + _GOLDEN
        h = mix(seed)
        time = time - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / length
        alive = time < latest[doc]
        if not alive.all():
            seed, h, time, doc, limit, low, length = (x[alive] for x in (seed, h, time, doc, limit, low, length))
        g = mix(h ^ _GOLDEN)
        register = ((g >> np.uint64(40)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        place = low + ((g & np.uint64(0xFFFFFFFF)).astype(np.int64) * length >> 32)
        counts = place < limit
        np.minimum.at(best, (doc * registers + register)[counts], time[counts])
        live = np.unique(doc) if len(doc) < n_docs else np.arange(n_docs)
        latest[live] = best.reshape(n_docs, registers)[live].max(axis=1)
    return best.reshape(n_docs, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A number per document and band, equal where the band's registers are."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for i in range(bits.shape[2]):
        key = mix(key * _GOLDEN + bits[:, :, i])
    return key.view(np.int64)


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the i-th texts of `a` and `b`; 0 if neither has words."""
    (ha, na), (hb, nb) = shingles(a), shingles(b)
    da, ea, wa = bag(ha, na)
    db, eb, wb = bag(hb, nb)
    doc, element, weight = np.concatenate([da, db]), np.concatenate([ea, eb]), np.concatenate([wa, wb])
    order = np.lexsort((element, doc))
    doc, element, weight = doc[order], element[order], weight[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (element[1:] == element[:-1]))
    shared = np.bincount(doc[same], np.minimum(weight[same], weight[same + 1]), len(na))
    return shared / np.maximum(1, na + nb - shared)


# ---- Jobs


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and band keys (none for a text without words) of every row, written."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.large_string())
            upto, a = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_CHARS)))
                part = batch.slice(a, b - a)
                hashes, sizes = shingles(text.slice(a, b - a))
                signature = signatures(*bag(hashes, sizes), len(sizes))
                keys = band_keys(signature)[sizes > 0].ravel()
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "digest": part.column(1), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                })
                a = b

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", _digest().alias("digest"), "text")
    return written(rows.mapInArrow(sign, "doc_id long, digest binary, bands array<bigint>"))


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The `pairs` (a, b) whose `texts` (node, text) are similar enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                alike = similarities(part.column(2), part.column(3)) >= similarity - 1e-12
                yield part.select(["a", "b"]).filter(pa.array(alike))

    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(kept, "a long, b long")


def bags(texts: DataFrame) -> DataFrame:
    """node and bag: 32-bit hashes of the shingles of each text (node, text), of which the k-th of its kind has its own."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                doc, element, weight = bag(*shingles(part.column(1)))
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                each = mix(np.repeat(element, weight) + _GOLDEN * nth.astype(np.uint64)).astype(np.uint32).view(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, weight, part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "bag": pa.ListArray.from_arrays(pa.array(ends), pa.array(each))})

    return texts.select("node", "text").mapInArrow(hashed, "node long, bag array<int>")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for all nodes of `edges` (a, b).

    In each round a node points at its least neighbour, if that is less than itself, and then at the end of the chain it is
    in. Edges are drawn between these ends from then on, so that each round leaves half of their nodes at most. Rounds are
    written, and end when no edge is left.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    edges = written(ordered(edges).filter("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        roots = written(roots.select("node", F.least("node", "least").alias("root")))
        chained = True
        while chained:
            further = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
            after = written(roots.join(further, "root").select("node", "root", "further"))
            chained = not after.filter("further <> root").isEmpty()
            roots = after.select("node", F.col("further").alias("root"))
        edges = written(ordered(_relabelled(edges, roots)).filter("a <> b").distinct())
        labels = written(_renamed(labels, roots))
    return labels


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components `found` (node, component), further nodes and what `links` (a, b) bring together, written."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    further = ends.join(found, "node", "left_anti")
    labels = written(found.union(further.withColumn("component", F.col("node"))))
    between = _relabelled(links, labels.withColumnRenamed("component", "root")).filter("a <> b")
    return written(_renamed(labels, components(between).withColumnRenamed("component", "root")))


def _relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """`edges` (a, b) between the roots of their ends, as `roots` (node, root) has them."""
    left, right = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return edges.join(left, "a").join(right, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def _renamed(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """`labels` (node, component) with the root of each component that has one."""
    named = labels.join(roots.withColumnRenamed("node", "component"), "component", "left")
    return named.select("node", F.coalesce("root", "component").alias("component"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with theirs and the bucket's largest one, written."""
    labelled = members.select("bucket", "node").join(found, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    return written(labelled.join(mixed.filter("parts > 1").select("bucket", "main"), "bucket"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id, class_size and kept for every row of `docs` (doc_id, text), copies and near-copies alike.

    Classes are the connected components of the pairs of texts that share a band and whose weighted Jaccard similarity
    is at least `similarity`. The row with the smallest (doc_id, digest) of a class is kept, class_id is its doc_id.

    Equal texts are one node. In a band's bucket all nodes are held against one of them first, then in some rounds those
    apart from the bucket's main component against one node of that. Only pairs of nodes that this has left in
    different components are then held against each other, all of them; the join itself finds out how many shingles they
    share, so that only alike ones come out of it. So no link between components is lost, while a bucket of many
    copies of one text takes about as many pairs as it has nodes.

    Nulls: a null text counts as empty, a null doc_id is smaller than any other. Texts without words are alike if they
    are equal. Repeated rows all come out, one of them kept at most. Other columns are not looked at. An empty
    table gives no rows.
    """
    rows = signed(docs)
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    # Numbered within the job that writes them, so each node has one number from here on.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    total = nodes.count() * BANDS
    members = written(join_groups(places, written(sizes), "bucket", "size", total).select("bucket", "node", "leader"))
    pairs = written(members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())

    wanted = members.select("node").distinct().join(nodes.select("node", "digest", F.col("first_id").alias("doc_id")), "node")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("digest", _digest())
    same = given["digest"].eqNullSafe(wanted["digest"]) & given["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = written(given.join(wanted, same).select("node", "text").dropDuplicates(["node"]))

    found, tested = components(written(verified(pairs, texts, similarity))), ordered(pairs)
    for turn in range(1, ROUNDS + 1):
        apart = _apart(members, found)
        # Another node of the main component in each turn.
        mark = F.lit(int(mix(np.array([turn], np.uint64))[0] >> np.uint64(1)))
        leaders = apart.filter("component = main").groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(mark)).alias("b"))
        tries = apart.filter("component <> main").join(leaders.withColumn("b", F.col("b").bitwiseXOR(mark)), "bucket")
        tries = written(ordered(tries.select(F.col("node").alias("a"), "b")).distinct().join(tested, ["a", "b"], "left_anti"))
        found, tested = extended(found, written(verified(tries, texts, similarity))), tested.union(tries)
    apart = _apart(members, found)
    known = bags(apart.select("node").distinct().join(texts, "node")).join(nodes.select("node", "bands"), "node")
    apart = apart.join(known, "node")
    one = apart.filter("component <> main").select("bucket", *(F.col(c).alias(f"{c}_a") for c in ("node", "component", "bands", "bag")))
    other = apart.select("bucket", "main", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "bands", "bag")))
    n, m = F.size("bag_a"), F.size("bag_b")
    rest = one.join(other, "bucket").filter(
        # once per pair: not from both ends, and in one of the buckets it shares only
        ((F.col("component_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
        & (F.col("component_a") != F.col("component_b"))
        & (F.least(n, m) >= (similarity - 0.01) * F.greatest(n, m))
        & (F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("bucket"))
        & (F.size(F.array_intersect("bag_a", "bag_b")) * (1.99 + similarity - 1) >= (similarity - 0.01) * (n + m))
    )
    rest = written(ordered(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct().join(tested, ["a", "b"], "left_anti"))
    found = extended(found, written(verified(rest, texts, similarity)))

    named = nodes.drop("bands").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named)
    whole = named.groupBy("component").agg(
        F.min(F.struct("first_id", "digest")).alias("best"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts")
    )
    known = join_groups(named, written(whole), "component", "texts", named.count())
    known = known.select(
        "digest", "n", F.col("best.first_id").alias("class_id"), F.col("best.digest").alias("best"), "class_size"
    )
    counted = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    known = written(known)
    out = join_groups(counted, known, "digest", "n", rows.count()).drop("n").withColumnRenamed("times", "n")
    out = repeated(out.withColumn("same", F.col("digest") == F.col("best")).withColumn("keep_id", F.col("class_id")))
    return out.select("doc_id", "digest", "class_id", "class_size", (F.col("kept") & F.col("same")).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` of each class, with its columns as they are."""
    keys = classes(docs, similarity).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    marked = carried(docs, F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("own"), F.col("doc_id").cast("long").alias("id"))
    joined = marked.join(keys, F.col("own").eqNullSafe(F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")))
    return joined.dropDuplicates(["_digest", "_id"]).select("row.*")


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")


QUERIES = {"op6_bag_minhash": op6_bag_minhash}
ORACLE: dict[str, str] = {}
