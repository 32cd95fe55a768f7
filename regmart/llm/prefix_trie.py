"""Prefix trie of conversations, without a trie: member intervals in the sorted list of conversations.

Conversations are sequences of turns. In ascending order of sequences, those that begin with one prefix stand together. The prefix's
interval ends where the number of turns shared by neighbours (LCP) falls below its length, which two binary
searches find in a sparse table of range minima, one to the left and one to the right, for each prefix by itself.

The order is cut into blocks, each with a table of its own. Only prefixes of a block's first and last sequence can
reach into other blocks; these few are put together by what the blocks tell of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

# A block has about so many turns.
BLOCK_TURNS = 50_000
# A conversation takes its first turns from the one whose id is the next lower multiple of this, up to one turn less than `HEADS`.
FAMILY = 100
HEADS = 6
# Bytes of a turn in a sequence.
_TURN = 16
_NODE = "node string, crosses boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = "block int, node string, conv_id long, n_convs long, n_children long, ends string"


# ---- Sequences


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (code, size): a hash of role and text, and the text's code points, by turn.

    A null turn comes first, turns of one number are ordered by code; null roles and texts become empty. Repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation. One conversation's codes must fit a task (some 50 bytes a turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), code.alias("code"), F.char_length(text).alias("size")).alias("t"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["code"].alias("code"), t["size"].alias("size"))))


def with_family_heads(convs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Each conversation with the first h turns of its family's first one before its own turns after the first h; h is the
    crc32 of its decimal id modulo `heads`. A family's first id ends in zeros; negative ids are cut towards zero."""
    first = convs.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, heads - 1).alias("head")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    joined = convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family).join(first, "first_id", "left")
    head = F.slice(F.coalesce("head", F.filter("turns", lambda t: F.lit(False))), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


# ---- A block


def _texts(values: Iterable[str | None]) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _TURN
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // _TURN


class RangeMinimum:
    """Sparse table: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first] to values[last]."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.log2(last - first + 1).astype(np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def reach_right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place before which, from `start` + 1 on, no value is below `least`."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, step = self.levels[k], 1 << k
            inside = at + 1 < len(table)
            on = inside & (table[np.where(inside, at + 1, 0)] >= least)
            at[on] += step
        return at

    def reach_left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place after which, up to `start`, no value is below `least`."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, step = self.levels[k], 1 << k
            inside = at - step >= 0
            on = inside & (table[np.where(inside, at - step + 1, 0)] >= least)
            at[on] -= step
        return at


class Block:
    """The prefixes of a block's sequences. Arrays have an entry per prefix, in the order of the sequence that has it first, then of length.

    first, last: the interval; crosses: whether members may stand in other blocks; owned: whether no block before has members."""

    def __init__(self, rows: pd.DataFrame, before: bytes | None, after: bytes | None):
        rows = sorted(zip(rows["key"].map(bytes), rows["conv_id"].tolist(), rows["sizes"]), key=lambda r: r[:2])
        self.keys, ids = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        m = len(rows)
        self.ids, self.lengths = ids, np.array([len(k) // _TURN for k in self.keys], np.int64)
        lcp = np.array([-1, *map(shared_turns, self.keys[:-1], self.keys[1:])], np.int64)
        left = -1 if before is None else shared_turns(before, self.keys[0])
        right = -1 if after is None else shared_turns(self.keys[-1], after)

        new = self.lengths - lcp  # prefixes that no sequence before has
        self.starts = np.concatenate([[0], np.cumsum(new)])
        self.row = np.repeat(np.arange(m), new)
        self.depth = np.arange(len(self.row)) - self.starts[self.row] + lcp[self.row] + 1
        table = RangeMinimum(lcp)
        self.first = table.reach_left(self.row, self.depth)
        self.last = table.reach_right(self.row, self.depth)
        self.crosses_left = (self.first == 0) & (self.depth <= left)
        self.crosses = self.crosses_left | ((self.last == m - 1) & (self.depth <= right))
        self.owned = ~self.crosses_left

        self.parent = np.arange(len(self.row)) - 1
        heads = self.starts[:-1][(new > 0) & (np.arange(m) > 0)]  # prefixes whose parent another sequence has first
        rows_of = table.reach_left(self.row[heads], self.depth[heads] - 1)
        self.parent[heads] = self.starts[rows_of] + self.depth[heads] - 1 - (lcp[rows_of] + 1)

        self.n = self.last - self.first + 1
        self.conv = RangeMinimum(ids).of(self.first, self.last)
        inner = self.owned & (self.parent >= 0)
        self.children = np.bincount(self.parent[inner], minlength=len(self.row)).astype(np.int64)
        # Members that end at a prefix are the first of its interval, and equal.
        same = np.concatenate([lcp[1:] == np.minimum(self.lengths[:-1], self.lengths[1:]), [False]])
        same[:-1] &= self.lengths[:-1] == self.lengths[1:]
        breaks = np.flatnonzero(~same)
        self._run_end = breaks[np.searchsorted(breaks, np.arange(m))]
        sizes = [np.asarray(r[2], np.int64) for r in rows]
        flat = np.concatenate([*sizes, np.zeros(1, np.int64)])
        offset = np.concatenate([[0], np.cumsum(self.lengths)])
        self.tokens = np.where(self.depth > 0, flat[offset[self.row] + self.depth - 1], 0)

    def ends(self, i: int) -> str:
        at = int(self.first[i])
        if self.lengths[at] != self.depth[i]:
            return ""
        return ",".join(map(str, self.ids[at : self._run_end[at] + 1].tolist()))

    def crossing(self) -> dict[int, str]:
        """Prefixes that may reach into other blocks, by place, with a hash of theirs."""
        places = np.flatnonzero(self.crosses)
        names = {}
        for row, key in ((0, self.keys[0]), (-1, self.keys[-1])):
            mine = [p for p in places.tolist() if self.crosses_left[p]] if row == 0 else [p for p in places.tolist() if not self.crosses_left[p]]
            so_far, done = hashlib.sha256(), 0
            for p in sorted(mine, key=self.depth.__getitem__):
                so_far.update(key[done : int(self.depth[p]) * _TURN])
                done = int(self.depth[p]) * _TURN
                names[p] = so_far.hexdigest()
        return names

    def below(self, weights: np.ndarray) -> np.ndarray:
        """Sums over each prefix and its extensions, which follow it up to the end of its interval."""
        upto = np.concatenate([[0], np.cumsum(weights)])
        return upto[self.starts[self.last + 1]] - upto[: len(weights)]


# ---- Jobs


def prefix_nodes(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations' turns (conv_id, turns as `sequences` gives them), the empty one included.

    conv_id: the smallest member; depth; parent_conv_id: that of the prefix one turn shorter; n_convs: members;
    n_children: prefixes one turn longer; n_leaves: prefixes from this one on that no other extends; saved_tokens: over the same
    prefixes, the sum of (members - 1) times code points of the last text; ends_sha256 of the ascending ids of members that end here.

    Conversations without turns are members of the empty prefix; an empty table gives no rows. Equal conversations may fill
    several blocks. Of the ids that end at one prefix, which SHA-256 must read in a row, a task holds a block's part at a time.
    """
    keyed = convs.select(
        "conv_id", F.unhex(F.array_join(F.col("turns.code"), "")).alias("key"), F.col("turns.size").alias("sizes"),
        (F.size("turns") + 1).alias("weight"),
    )
    keyed = written(keyed)
    blocks = (keyed.agg(F.sum("weight")).first()[0] or 0) // block_turns + 1
    dealt = keyed.drop("weight").repartitionByRange(blocks, "key", "conv_id")
    placed = written(dealt.withColumn("block", F.spark_partition_id()))
    # One row per block of some 50,000 turns: few rows for the one task that tells each its neighbours.
    order = Window.orderBy("block")
    ends = placed.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    borders = written(ends.select("block", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after")))

    def opened(rows: pd.DataFrame, border: pd.DataFrame) -> Block:
        side = lambda c: None if border[c].iloc[0] is None else bytes(border[c].iloc[0])
        return Block(rows, side("before"), side("after"))

    def parts(rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        block = opened(rows, border)
        names = block.crossing()
        at = np.fromiter(names, np.int64, len(names))
        return pd.DataFrame({
            "block": np.full(len(at), rows["block"].iloc[0], np.int32), "node": _texts(names.values()), "conv_id": block.conv[at],
            "n_convs": block.n[at], "n_children": block.children[at], "ends": _texts(block.ends(p) for p in names),
        })

    grouped = placed.groupBy("block")
    part = written(grouped.cogroup(borders.groupBy("block")).applyInPandas(parts, _PART))
    whole = part.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"))
    told = part.select("block", "node").join(whole, "node").groupBy("block").agg(F.collect_list(F.struct("node", "conv_id", "n_convs", "n_children")).alias("told"))

    def nodes(rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        block = opened(rows, border)
        names = block.crossing()
        known = {t["node"]: t for t in border["told"].iloc[0]} if names else {}
        for place, name in names.items():
            block.conv[place], block.n[place], block.children[place] = (known[name][c] for c in ("conv_id", "n_convs", "n_children"))
        nothing = hashlib.sha256(b"").hexdigest()
        digests = [None if c else hashlib.sha256(block.ends(i).encode()).hexdigest() if block.lengths[f] == d else nothing
                   for i, (c, f, d) in enumerate(zip(block.crosses, block.first, block.depth))]
        return pd.DataFrame({
            "node": _texts(names.get(i) for i in range(len(block.row))), "crosses": block.crosses, "conv_id": block.conv, "depth": block.depth,
            "parent_conv_id": pd.Series(np.where(block.depth > 0, block.conv[block.parent], 0), dtype="Int64").mask(block.depth == 0),
            "n_convs": block.n, "n_children": block.children, "n_leaves": block.below(block.owned & (block.children == 0)),
            "saved_tokens": block.below(np.where(block.owned, (block.n - 1) * block.tokens, 0)), "ends_sha256": _texts(digests),
        })

    found = written(grouped.cogroup(borders.join(told, "block", "left").groupBy("block")).applyInPandas(nodes, _NODE), "crosses")
    within = found.filter(~F.col("crosses")).drop("node", "crosses")
    same = [F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")]
    across = found.filter("crosses").groupBy("node").agg(*same, F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return within.unionByName(across.join(_digests(part), "node").drop("node"))


def _digests(part: DataFrame) -> DataFrame:
    """node and the SHA-256 of its blocks' lists of ids, read one after the other."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, digest, begun = None, hashlib.sha256(), False
        for batch in batches:
            done = []
            for node, ids in zip(batch["node"], batch["ends"]):
                if node != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest, begun = node, hashlib.sha256(), False
                if ids:
                    digest.update((("," if begun else "") + ids).encode())
                    begun = True
            yield pd.DataFrame(done, columns=["node", "ends_sha256"], dtype=object)
        if name is not None:
            yield pd.DataFrame([(name, digest.hexdigest())], columns=["node", "ends_sha256"], dtype=object)

    dealt = part.select("node", "block", "ends").repartition("node").sortWithinPartitions("node", "block")
    return dealt.select("node", "ends").mapInPandas(read, "node string, ends_sha256 string")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(with_family_heads(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

ORACLE = {
    "op12_prefix_trie": """
        WITH steps AS (
          SELECT list(v ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS i))),
        turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        coded AS (
          SELECT conv_id, turn, length(text) AS size, md5(strlen(role) || ':' || role || text) AS code FROM turns),
        convs AS (
          SELECT conv_id, list({'code': code, 'size': size} ORDER BY turn NULLS FIRST, code) AS t FROM coded GROUP BY conv_id),
        heads AS (
          SELECT conv_id, t, CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                 lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS INT) AS h
          FROM convs, steps),
        rebuilt AS (
          SELECT c.conv_id, list_concat(coalesce(d.t[1:c.h], []), c.t[c.h + 1:]) AS t
          FROM heads c LEFT JOIN convs d ON d.conv_id = c.conv_id - c.conv_id % 100),
        member AS (
          SELECT conv_id, d, len(t) = d AS at_end, CASE WHEN d > 0 THEN t[d].size ELSE 0 END AS size,
                 array_to_string(list_transform(t[1:d], lambda x: x.code), ',') AS key,
                 array_to_string(list_transform(t[1:d - 1], lambda x: x.code), ',') AS parent
          FROM (SELECT *, CAST(unnest(range(len(t) + 1)) AS INT) AS d FROM rebuilt)),
        node AS (
          SELECT key, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
                 sha256(coalesce(string_agg(CASE WHEN at_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
          FROM member GROUP BY key, d),
        child AS (SELECT parent, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
        held AS (
          SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON c.parent = n.key AND c.d = n.d),
        above AS (
          SELECT h.d, h.n, h.size, h.n_children, CAST(unnest(range(h.d + 1)) AS INT) AS up, h.key FROM held h),
        sums AS (
          SELECT substr(key, 1, up * 33 - CASE WHEN up > 0 THEN 1 ELSE 0 END) AS key, up AS d,
                 sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * size) AS saved
          FROM above GROUP BY ALL)
        SELECT h.conv_id, CAST(h.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, h.n AS n_convs, h.n_children,
               CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, h.ends AS ends_sha256
        FROM held h JOIN sums s ON s.key = h.key AND s.d = h.d LEFT JOIN node p ON p.key = h.parent AND p.d = h.d - 1
    """,
}
