"""Document fingerprints of Lempel-Ziv phrases: texts that a compressor would find alike have like fingerprints.

A text is parsed into phrases, each the shortest one not parsed before (a phrase seen before and one more letter). The set of
phrases is what a dictionary compressor learns of the text. A fingerprint is the smallest hashes of that set; the share that
two fingerprints have of the smallest hashes of both estimates how alike the sets are (their Jaccard similarity), and is it for short texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

# Smallest hashes kept per text, of 32 bits each.
SIZE = 128
# The edited text loses one in so many code points at its end, and gets as many of the next document's.
EDIT_SHARE = 4
# A task gets about so many bytes of text; there are at most so many tasks. Their borders come from a sample of so many rows a task.
TASK_BYTES = 32 << 20
MAX_TASKS = 100_000
_SAMPLED = 20
_BASE = 0x9E3779B97F4A7C15
# Phrases are hashed in pieces of about so many letters.
_PIECE = 1 << 17
_LEAST = -(1 << 63)


# ---- Fingerprints


def phrases(text: str, seen: set[str], start: int = 0) -> list[int]:
    """Ends of the phrases of text[start:], given those seen before, to which they are added. What is left at the end has been seen.

    Each prefix of a phrase is a phrase, so the search for the shortest new one may begin at the length of the last one.
    """
    ends, n, guess = [], len(text), 1
    while start < n:
        end = start + guess
        if end > n:
            end = n
        if text[start:end] in seen:
            end += 1
            while end <= n and text[start:end] in seen:
                end += 1
            if end > n:
                break
        else:
            while end - 1 > start and text[start : end - 1] not in seen:
                end -= 1
        seen.add(text[start:end])
        ends.append(end)
        guess = end - start
        start = end
    return ends


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of `_BASE` and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def phrase_hashes(text: str, ends: list[int], start: int = 0) -> np.ndarray:
    """A hash of 32 bits of each phrase, by its letters alone: sums of letters times powers, mixed."""
    stops = np.array(ends, np.int64)
    out, done = [np.empty(0, np.uint32)], 0
    while done < len(stops):
        upto = max(done + 1, int(np.searchsorted(stops, start + _PIECE, "right")))
        last = int(stops[upto - 1])
        letters = np.frombuffer(text[start:last].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        power, inverse = _power(len(letters) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        b = stops[done:upto] - start
        a = np.concatenate([[0], b[:-1]])
        h = (sums[b] - sums[a]) * inverse[a]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        out.append((h >> np.uint64(32)).astype(np.uint32))
        start, done = last, upto
    return np.concatenate(out)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of the smallest hashes of both that both have. 1 for two empty fingerprints."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    kept = np.concatenate([[True], ~twice])
    distinct = both[kept][:size]
    return int(np.count_nonzero(both[1:][twice] <= distinct[-1])) / len(distinct)


def as_text(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    return smallest(phrase_hashes(text, phrases(text, set())), size)


class Parsed:
    """A text's fingerprint, and those of texts that share its beginning, which is not parsed again."""

    def __init__(self, text: str, size: int = SIZE):
        self.text, self.size = text, size
        self.cut = len(text) - len(text) // EDIT_SHARE
        ends = phrases(text, set())
        hashes = phrase_hashes(text, ends)
        shared = int(np.searchsorted(np.array(ends, np.int64), self.cut, "right"))
        self.at = ends[shared - 1] if shared else 0
        self._ends, self._hashes = ends[:shared], hashes[:shared]
        self.fingerprint = smallest(hashes, size)

    def edited(self, next_text: str) -> tuple[str, np.ndarray]:
        """The text with its last part replaced by the beginning of the next one, and its fingerprint."""
        text = self.text[: self.cut] + next_text[: len(self.text) - self.cut]
        if text == self.text:
            return text, self.fingerprint
        starts = [0, *self._ends[:-1]] if self._ends else []
        seen = {self.text[a:b] for a, b in zip(starts, self._ends)}
        ends = phrases(text, seen, self.at)
        return text, smallest(np.concatenate([self._hashes, phrase_hashes(text, ends, self.at)]), self.size)


# ---- Jobs


def _ranges(rows: DataFrame) -> tuple[list[int], list[int]]:
    """Borders (at, tie) of ranges of about equal size, from a sample of rows."""
    n = rows.count()
    fewest = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    wanted = min(n, max(4_000, _SAMPLED * fewest, min(n // 2_000, _SAMPLED * MAX_TASKS)))
    sample = rows.select("at", "tie", F.octet_length("text").alias("size"))
    if wanted < n:
        sample = sample.sample(min(1.0, wanted / n), seed=11)
    seen = sample.toPandas().sort_values(["at", "tie"], ignore_index=True)  # some 20 rows a task
    if seen.empty:
        return [], []
    tasks = int(min(max(seen["size"].mean() * n // TASK_BYTES + 1, fewest), MAX_TASKS))
    upto = (seen["size"] + 64).cumsum().to_numpy()
    places = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, tasks) / tasks))
    cuts = seen.iloc[places][["at", "tie"]].drop_duplicates()
    return cuts["at"].tolist(), cuts["tie"].tolist()


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt out by ranges of doc_id, in order, each range followed by the first row of the next one (`ahead`; after the last, of the first).

    Columns: doc_id, text, ahead. Also the number of ranges. Rows of one doc_id are ordered by a hash of their text, then the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("tie", F.xxhash64("text"))
    at_cuts, tie_cuts = (np.array(c, np.int64) for c in _ranges(rows))

    @F.pandas_udf("int")
    def range_of(at: pd.Series, tie: pd.Series) -> pd.Series:
        found, beyond = np.searchsorted(at_cuts, at, "left"), np.searchsorted(at_cuts, at, "right")
        for i in np.unique(found[found < beyond]):  # ids at a border: the hash decides
            mine = (found == i) & (found < beyond)
            found[mine] = i + np.searchsorted(tie_cuts[i : beyond[mine][0]], tie[mine], "left")
        return pd.Series(found.astype(np.int32))

    placed = rows.withColumn("part", range_of("at", "tie"))
    # The first row of each range, one row a task: its place, then its text.
    firsts = placed.groupBy("part").agg(F.min(F.struct("at", "tie")).alias("low")).select("part", "low.*").toPandas().sort_values("part")
    firsts["goes"] = np.roll(firsts["part"], 1)
    listed = docs.sparkSession.createDataFrame(firsts[["part", "at", "tie", "goes"]].astype("int64"), "part int, at long, tie long, goes int")
    heads = rows.join(F.broadcast(listed), ["at", "tie"]).groupBy("goes").agg(F.min(F.struct("doc_id", "at", "tie", "text")).alias("row"))
    ahead = heads.select("row.*", F.col("goes").alias("part"), F.lit(True).alias("ahead"))
    tasks = len(at_cuts) + 1
    dealt = placed.withColumn("ahead", F.lit(False)).unionByName(ahead).repartitionById(tasks, F.col("part"))
    return dealt.sortWithinPartitions("part", "ahead", "at", "tie", "text").select("doc_id", "text", "ahead"), tasks


def compare_neighbours(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document (doc_id, text): n_chars, its fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    The edited text has the first letters of the next document in ascending order of ids (after the last: of the first) in place
    of its last `1 / EDIT_SHARE`. A null text counts as empty, a null doc_id comes first. Rows of one doc_id follow each other by a hash of their text and
    come out each; a single document is its own next. An empty table gives no rows; other columns are not looked at.
    A task holds two texts at a time.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt, _ = with_next(docs)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_id, parsed = None, None
        for batch in batches:
            done = []
            for i, text, ahead in zip(*(c for c in batch.columns)):
                following = Parsed(text.as_py(), size)
                if parsed is not None:
                    edited, other = parsed.edited(following.text)
                    own = parsed.fingerprint
                    done.append((
                        doc_id, len(parsed.text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other),
                        likeness(own, other, size), likeness(own, following.fingerprint, size),
                    ))
                doc_id, parsed = i.as_py(), None if ahead.as_py() else following
            if done:
                columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return dealt.mapInArrow(compared, schema)


def op11_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_phrase_fingerprints": op11_phrase_fingerprints}
# Phrases depend on all phrases before, which SQL cannot state; tests/llm parses letter by letter instead.
ORACLE: dict[str, str] = {}
