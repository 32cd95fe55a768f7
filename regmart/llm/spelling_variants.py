"""Spelling variants: words of a corpus one edit apart, found by a frontier of states that walks a trie kept as a table.

The trie is a table of edges, one row per child prefix, dealt out by prefix. A state is a word, the spelling it stands for with
its one edit made, and the depth down to which that spelling was found in the trie. Level by level all states join the edges of
their depth; a state whose spelling ends at a word is a pair of neighbours. Words enter the frontier at half of
their length, in a trie of the words read forwards for edits in the second half and in one of the words read backwards for
edits in the first half, so no state starts near the root, where every letter has an edge.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

# Words have at least so many code points and occurrences.
MIN_LENGTH = 7
MIN_COUNT = 2
# A word takes a neighbour as its form that is so many times as frequent.
FORM_FACTOR = 10
# One in so many (document, run) loses a code point.
DAMAGE = 31
# Longer words have a level each, so they are compared by the hashes of their shortened spellings instead.
LONG = 64
# A task hands on its counts when it has so many words.
_FLUSH = 200_000
# Forward and backward tries are told apart by the first sign of their prefixes.
_AHEAD, _BACK = ">", "<"
# A run of letters in UTF-8: A-Z in lower case, and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LENGTH)
_BASE = 0x9E3779B97F4A7C15


def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: runs of letters A-Z (lower-cased) and U+00C0 to U+00FF of whole texts, with their occurrences.

    If `DAMAGE` divides the crc32 of "<doc_id>:<run>", the run's code point at crc32 % length is left out. Words shorter than
    `min_length` or rarer than `min_count` are not listed. A null text has no runs; a null doc_id counts as an empty text;
    repeated rows count each; other columns are not looked at.
    """
    # A shortened run has one code point less, so shorter runs than `min_length` never matter.
    run = _RUN if min_length == MIN_LENGTH else re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % min_length)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(run.findall(text.as_buffer().to_pybytes().lower())).items():
                    h = zlib.crc32(word, start)
                    if h % DAMAGE == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) <= min_length:
                            continue
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    found[word] += n
                if len(found) > _FLUSH:
                    yield out()
                    found.clear()
        if found:
            yield out()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("text <> ''")
    counts = texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


# ---- The trie as a table


def _prefix(s: str, depth) -> Column:
    """The first `depth` letters after the trie's sign."""
    return F.col(s).substr(F.lit(1), depth + 1 if isinstance(depth, Column) else F.lit(depth + 1))


def _letter(s: str, i) -> Column:
    """Letter `i` from 0, empty beyond the end."""
    return F.col(s).substr((i if isinstance(i, Column) else F.lit(i)) + 2, F.lit(1))


def _both_ways(words: DataFrame) -> DataFrame:
    """s: each word with the sign of its trie before it, and size, its letters; `enters` is the depth at which edits begin."""
    size = F.char_length("word")
    ahead = words.select(F.concat(F.lit(_AHEAD), "word").alias("s"), size.alias("size"), F.floor(size / 2).cast("int").alias("enters"))
    back = words.select(
        F.concat(F.lit(_BACK), F.reverse("word")).alias("s"), size.alias("size"), (size - F.floor(size / 2)).cast("int").alias("enters")
    )
    return ahead.unionByName(back)


def trie_edges(spelled: DataFrame, top: int) -> DataFrame:
    """Edges of the trie from depth `top` on: depth (of the upper node), node, letter, child, words below, `ends` if
    a word ends there, and `rest`: where one word is below, the hash of what follows. Edges below a
    node with a single word are left out, as the edge to it tells all. A word's end counts like an edge of its node."""
    depth = F.explode(F.sequence(F.lit(top), "size"))
    steps = spelled.filter(F.col("size") >= top).select("s", "size", depth.alias("depth"))
    edges = (
        steps.select("depth", "size", _prefix("s", F.col("depth") + 1).alias("child"), F.xxhash64(F.col("s").substr(F.col("depth") + 3, F.col("size"))).alias("rest"))
        .groupBy("depth", "child")
        .agg(F.count(F.lit(1)).alias("below"), F.bit_xor("rest").alias("rest"), F.max(F.col("size") == F.col("depth") + 1).alias("ends"))
        .withColumn("node", _prefix("child", F.col("depth")))
        .withColumn("letter", _letter("child", F.col("depth")))
    )
    # A node has an edge per letter at most, so its window is short.
    return edges.withColumn("all", F.sum("below").over(Window.partitionBy("node"))).filter("all > 1 and letter <> ''").drop("all")


def _entering(spelled: DataFrame, depth: int) -> DataFrame:
    """States that lose the letter at `depth` of their word, joined at this level by their next letter; a word's
    last letter is lost one level higher, where its spelling ends. Of a run of equal letters the word's first one is lost."""
    def lost(rows: DataFrame, at: int) -> DataFrame:
        ahead = F.col("s").startswith(_AHEAD)
        before = F.when(F.lit(at == 0), F.lit("")).otherwise(_letter("s", max(at - 1, 0)))
        one_of_run = F.when(ahead, before == _letter("s", at)).otherwise(_letter("s", at + 1) == _letter("s", at))
        spelling = F.concat(_prefix("s", at), F.col("s").substr(F.lit(at + 3), F.col("size")))
        return rows.filter((F.col("enters") <= at) & ~one_of_run).select("s", spelling.alias("spelling"))

    inner = lost(spelled.filter(F.col("size") > depth + 1), depth)
    return inner.unionByName(lost(spelled.filter(F.col("size") == depth + 2), depth + 1))


def frontier(words: DataFrame) -> DataFrame:
    """a, b: pairs of words that differ by one edit, once each; at most `LONG` letters each.

    Only letters are replaced by larger ones and letters deleted, as the other word of a pair finds what the first one doesn't.
    States of a level are written before the next one. There are as many levels as the deepest node has letters at which two words part.
    """
    spelled = written(_both_ways(words))
    top = max(0, spelled.agg(F.min(F.least("enters", F.col("size") - 2))).first()[0] or 0)
    edges = written(trie_edges(spelled, top), "depth")
    deepest = edges.agg(F.max("depth")).first()[0]
    states, found = None, []
    for depth in range(top, (top if deepest is None else deepest) + 1):
        here = edges.filter(F.col("depth") == depth)
        exact = spelled.filter((F.col("enters") <= depth) & (F.col("size") > depth))
        replaced = (
            exact.withColumn("node", _prefix("s", depth))
            .join(here, "node")
            .filter(F.col("letter") > _letter("s", depth))
            .withColumn("spelling", F.concat("child", F.col("s").substr(F.lit(depth + 3), F.col("size"))))
        )
        edited = _entering(spelled, depth)
        edited = edited if states is None else edited.unionByName(states)
        followed = edited.withColumn("child", _prefix("spelling", depth + 1)).join(here, "child")
        columns = ["s", "spelling", "below", "rest", "ends"]
        met = replaced.select(columns).unionByName(followed.select(columns))
        # Of a single word below the rest is known; else the spelling ends here, or goes on to the next level.
        whole = F.char_length("spelling") == depth + 2
        remaining = F.xxhash64(F.col("spelling").substr(F.lit(depth + 3), F.char_length("spelling")))
        done = F.when(F.col("below") == 1, F.when(F.col("rest") == remaining, True)).when(whole, F.when(F.col("ends"), True)).otherwise(False)
        level = written(met.select("s", "spelling", done.alias("done")).filter("done is not null"), "done")
        states = level.filter(~F.col("done")).select("s", "spelling")
        found.append(level.filter("done").select("s", "spelling"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    word = lambda c: F.when(F.col(c).startswith(_AHEAD), F.col(c).substr(2, LONG + 1)).otherwise(F.reverse(F.col(c).substr(2, LONG + 1)))
    return pairs.select(word("s").alias("a"), word("spelling").alias("b"))


# ---- Long words


def _shortened(word: str) -> tuple[np.ndarray, int]:
    """Hashes of a word without each of its letters in turn, and of the word: sums of letter times power, modulo 2**64."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    power = np.full(len(letters), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)[::-1]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * power, dtype=np.uint64)])
    without = upto[:-1] * np.uint64(pow(_BASE, -1, 1 << 64)) + (upto[-1] - upto[1:])
    return without, int(upto[-1])


def long_pairs(words: DataFrame) -> DataFrame:
    """a, b: pairs of words that differ by one edit, once each, of which one has more than `LONG` letters.

    Two words of one length are equal without the same letter, a longer one is the shorter one without a letter. Words meet by the
    length and hash of what is left, and are then compared in full. Each word has as many rows of a few numbers as letters."""
    def shortened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, word in zip(batch["id"], batch["word"]):
                without, whole = _shortened(word)
                at = np.arange(len(without) + 1) - 1
                hashes = np.concatenate([np.array([whole], np.uint64), without]).view(np.int64)
                left = np.full(len(at), len(without) - 1)
                left[0] += 1
                yield pd.DataFrame({"id": np.full(len(at), key), "at": at, "left": left, "hash": hashes})

    long = words.filter(F.char_length("word") >= LONG).select(F.xxhash64("word").alias("id"), "word")
    rows = written(long.mapInPandas(shortened, "id long, at long, left long, hash long"))
    a, b = rows.filter("at >= 0").alias("a"), rows.alias("b")
    met = (F.col("a.left") == F.col("b.left")) & (F.col("a.hash") == F.col("b.hash"))
    one_edit = (F.col("b.at") == -1) | ((F.col("a.at") == F.col("b.at")) & (F.col("a.id") < F.col("b.id")))
    ids = a.join(b, met & one_edit).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct()
    named = lambda c: long.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    pairs = ids.join(named("a"), "a_id").join(named("b"), "b_id").select("a", "b")
    too_long = F.greatest(F.char_length("a"), F.char_length("b")) > LONG
    return pairs.filter(too_long & (F.levenshtein("a", "b", 1) == 1))


# ---- Groups of variants


def spelling_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words and their counts (word, n).

    n_near counts the words one inserted, deleted or replaced code point away. The form is the one of largest n, of equal ones the smallest, if
    its n is at least `factor` times the word's; root follows the forms to the last. Forms grow by the factor each time, so chains are short.
    Null and empty words and other columns are left out; an empty table gives an empty table.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''"))
    pairs = frontier(words.filter(F.char_length("word") <= LONG)).unionByName(long_pairs(words))
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = known.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b"))).alias("best")
    )
    largest = -F.col("best.less")
    counted = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(largest >= F.col("n") * factor, F.col("best.b")).alias("form"),
            F.when(largest >= F.col("n") * factor, largest).alias("form_n"),
        )
    )
    top, least = words.agg(F.max("n"), F.min("n")).first()
    chain = 1 + int(math.log(max((top or 1) / max(least or 1, 1), 1), factor)) if factor > 1 else 1
    roots = counted.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):  # each round doubles the steps
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return counted.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}

# The crc32 goes byte by byte through a table of 256 entries; the letters of a run are at most two bytes each.
ORACLE = {
    "op13_spelling_variants": r"""
        WITH steps AS (
          SELECT list(v ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS i))),
        runs AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
          FROM documents),
        per_doc AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
        hashed AS (
          SELECT run, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
                 lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                                ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))),
                 lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h
          FROM per_doc, steps),
        spelled AS (
          SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                      ELSE run END AS word, k FROM hashed),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        cut AS (
          SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short
          FROM (SELECT word, n, CAST(unnest(range(length(word))) AS BIGINT) AS i FROM words)),
        pairs AS (
          SELECT a.word AS a, b.word AS b, b.n AS b_n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.short
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.short),
        ranked AS (
          SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b) AS place FROM pairs),
        formed AS (
          SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.b_n >= 10 * w.n THEN r.b END AS form,
                 CASE WHEN r.b_n >= 10 * w.n THEN r.b_n END AS form_n
          FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.place = 1),
        chains AS (
          SELECT word, coalesce(form, word) AS root FROM formed),
        c2 AS (SELECT x.word, y.root FROM chains x JOIN chains y ON y.word = x.root),
        c4 AS (SELECT x.word, y.root FROM c2 x JOIN c2 y ON y.word = x.root),
        c8 AS (SELECT x.word, y.root FROM c4 x JOIN c4 y ON y.word = x.root),
        c16 AS (SELECT x.word, y.root FROM c8 x JOIN c8 y ON y.word = x.root)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN c16 c ON c.word = f.word
    """,
}
