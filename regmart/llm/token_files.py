"""Token ids in binary shards, compressed by Re-Pair grammars.

A shard holds the ids of some documents in ascending order of their ids, as a sequence of symbols: ids below `BASE`, and
nonterminals above it, each of which stands for two earlier symbols. A shard is a binary value, one per row of a table:

    magic "RPG1", then as little-endian uint32: rules, symbols, documents, tokens
    rules x (left, right)    symbols of nonterminal BASE + i
    rules x length           tokens each nonterminal expands to
    symbols x symbol         the sequence
    documents x tokens       of each document, in order

The lengths lead to any token of a shard without expanding what is before it.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

# Nonterminals are numbered from here; tokenizers' ids are smaller.
BASE = 1 << 20
END_ID = 1
# A shard is closed after the document that brings it to this many characters.
SHARD_CHARS = 8 << 20
# Re-Pair: how often a pair must be replaced to earn its rule.
MIN_USES = 8
# Pairs are counted in 2 ** _SLOT_BITS slots, those of up to _EXACT places one by one.
_SLOT_BITS = 20
_EXACT = 700_000
# So many bytes of text are encoded at a time.
_ENCODED = 8 << 20
# A worker forgets the parts of words it knows when it has more than so many, or so many letters and ids of them.
_MAX_PIECES = 700_000
_MAX_LETTERS = 16 << 20
# So many parts go through the tokenizer as one text.
_TOGETHER = 512
_MAGIC = b"RPG1"
_SHARD = "part int, shard int, start_in_part long, doc_ids array<bigint>, n_tokens long, data binary"


# ---- Re-Pair


def _slots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """A slot for each pair, and the number of slots: by hash, or one per distinct pair where there are few places."""
    if len(left) <= _EXACT:
        slot, pairs = pd.factorize((left.astype(np.int64) << 32) | right)
        return slot, len(pairs)
    hashed = (left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    hashed >>= np.uint32(32 - _SLOT_BITS)
    return hashed.astype(np.int64), 1 << _SLOT_BITS


def pair_round(seq: np.ndarray, live: np.ndarray, first: int, min_uses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs of neighbours by nonterminals numbered from `first`: the shorter sequence, its live places, and the pairs.

    Pairs are counted by slot, at the live places only: a pair too rare for a rule never becomes more frequent, as only new
    nonterminals make new pairs. Of overlapping places the one with the more frequent slot is chosen, of equal ones every
    other. Of the pairs that are chosen in one slot, one stands for it and its places are counted exactly; another one
    has its turn in a later round. Pairs with fewer than `min_uses` places stay.
    """
    none = np.empty((0, 2), np.uint32)
    if len(seq) < 2:
        return seq, live, none
    dense = 2 * np.count_nonzero(live) > len(seq)  # then all places are looked at
    at = None if dense else np.flatnonzero(live[:-1])
    left, right = (seq[:-1], seq[1:]) if dense else (seq[at], seq[at + 1])
    slot, n_slots = _slots(left, right)
    counts = np.bincount(slot, minlength=n_slots).astype(np.int32)
    counts *= counts >= min_uses
    # Neighbours never tie, so no two chosen places touch.
    if dense:
        rank = counts.take(slot)
        rank *= 2
        rank[1::2] += 1
        better = rank > 1
        live = np.concatenate([better, [False]])
        better[1:] &= rank[1:] > rank[:-1]
        better[:-1] &= rank[:-1] > rank[1:]
        chosen = np.flatnonzero(better)
        slot = slot[chosen]
    else:
        own = counts.take(slot)
        still = np.flatnonzero(own)
        at, slot, own = at.take(still), slot.take(still), own.take(still)
        live = np.zeros(len(seq), bool)
        live[at] = True
        own = 2 * own + (at & 1)
        beside = at[1:] == at[:-1] + 1
        better = np.ones(len(at), bool)
        better[1:] &= ~beside | (own[1:] > own[:-1])
        better[:-1] &= ~beside | (own[:-1] > own[1:])
        better = np.flatnonzero(better)
        chosen, slot = at.take(better), slot.take(better)
    pair = (seq[chosen].astype(np.int64) << 32) | seq[chosen + 1]
    holder = np.zeros(n_slots, np.int64)
    holder[slot] = pair
    same = holder[slot] == pair
    uses = np.bincount(slot.compress(same), minlength=n_slots)
    kept = np.flatnonzero(uses >= min_uses)
    if not len(kept):
        return seq, live, none
    kept = kept[np.argsort(-uses[kept], kind="stable")]
    number = np.zeros(n_slots, np.uint32)
    number[kept] = np.arange(first, first + len(kept))
    new = number[slot]
    taken = np.flatnonzero(same & (new > 0))
    chosen = chosen[taken]
    out, live = _without([seq, live], chosen + 1)
    chosen -= np.arange(len(chosen))  # their places now
    out[chosen] = new[taken]
    live[chosen] = True
    live[chosen[chosen > 0] - 1] = True
    return out, live, np.stack([holder[kept] >> 32, holder[kept] & 0xFFFFFFFF], 1).astype(np.uint32)


def _without(arrays: list[np.ndarray], places: np.ndarray) -> list[np.ndarray]:
    """Copies of arrays of one length without some places, which ascend."""
    n = len(arrays[0])
    if len(places) * 1000 < n:  # a few long pieces
        bounds = [*zip([0, *(places + 1).tolist()], [*places.tolist(), n])]
        return [np.concatenate([x[a:b] for a, b in bounds]) for x in arrays]
    stays = np.ones(n, bool)
    stays[places] = False
    kept = np.flatnonzero(stays)  # faster than by the mask
    return [x.take(kept) for x in arrays]


def re_pair(ids: np.ndarray, rounds: int | None = None, min_uses: int = MIN_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), the tokens each rule expands to, and the sequence of symbols. Without `rounds`: until no pair earns a rule."""
    seq, rules, lengths = ids.astype(np.uint32), np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    live = np.ones(len(seq), bool)
    for _ in itertools.count() if rounds is None else range(rounds):
        seq, live, pairs = pair_round(seq, live, BASE + len(rules), min_uses)
        if not len(pairs):
            break
        size = np.concatenate([lengths, np.ones(1, np.uint32)])
        of = lambda s: size[np.where(s >= BASE, s.astype(np.int64) - BASE, len(lengths))]  # noqa: E731, B023
        lengths = np.concatenate([lengths, (of(pairs[:, 0]) + of(pairs[:, 1])).astype(np.uint32)])
        rules = np.concatenate([rules, pairs])
    return rules, lengths, seq


class Shard:
    """A shard that can be read at any document or token."""

    def __init__(self, data: bytes | pa.Buffer):
        data = memoryview(data)
        if data[:4] != _MAGIC:
            raise ValueError("no shard of token ids")
        n_rules, n_symbols, n_docs, self.n_tokens = struct.unpack("<4I", data[4:20])
        words = np.frombuffer(data, "<u4", offset=20)
        if len(words) != 3 * n_rules + n_symbols + n_docs:
            raise ValueError("the shard's lengths do not fit")
        self.rules = words[: 2 * n_rules].reshape(-1, 2)
        self.lengths = words[2 * n_rules : 3 * n_rules]
        self.symbols = words[3 * n_rules : 3 * n_rules + n_symbols]
        self.doc_tokens = words[3 * n_rules + n_symbols :]
        self.doc_starts = np.concatenate([[0], np.cumsum(self.doc_tokens, dtype=np.int64)])

    @functools.cached_property
    def _ends(self) -> np.ndarray:
        return np.cumsum(self._size(self.symbols), dtype=np.int64)

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        size = np.ones(len(symbols), np.int64)
        high = symbols >= BASE
        size[high] = self.lengths[symbols[high] - BASE]
        return size

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` to before `stop`; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.empty(0, np.uint32)
        i = int(np.searchsorted(self._ends, start, "right"))
        j = int(np.searchsorted(self._ends, stop, "left")) + 1
        out = self._expand(self.symbols[i:j])
        skip = start - (int(self._ends[i - 1]) if i else 0)
        return out[skip : skip + stop - start]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.doc_starts[i]), int(self.doc_starts[i + 1]))

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Each pass puts the two symbols of a rule in place of its nonterminal, until none is left."""
        out = symbols
        while True:
            high = out >= BASE
            if not high.any():
                return out
            pairs = self.rules[out[high] - BASE]
            places = np.arange(len(out)) + np.concatenate([[0], np.cumsum(high[:-1])])
            longer = np.empty(len(out) + len(pairs), np.uint32)
            longer[places[~high]] = out[~high]
            longer[places[high]], longer[places[high] + 1] = pairs[:, 0], pairs[:, 1]
            out = longer

    def documents(self) -> Iterator[np.ndarray]:
        """All documents; the rules' expansions are built once and copied."""
        n = len(self.rules)
        sizes = np.concatenate([self.lengths.astype(np.int64), [0]])
        starts = np.concatenate([[0], np.cumsum(sizes[:-1])])
        buffer = np.empty(int(starts[-1]) if n else 0, np.uint32)
        # Rules refer to earlier ones only. Those whose parts are ready are filled together.
        ready = np.zeros(n, bool)
        while not ready.all():
            parts = self.rules.astype(np.int64) - BASE
            now = np.flatnonzero(~ready & ((parts < 0) | ready[np.maximum(parts, 0)]).all(axis=1))
            at = starts[now]
            for side in (0, 1):
                symbol = self.rules[now, side]
                length = self._size(symbol)
                self._copy(buffer, at, symbol, length, starts, buffer)
                at = at + length
            ready[now] = True
        # Single ids and the rules' expansions, taken as strings of bytes.
        single = self.symbols < BASE
        m = int(np.where(single, self.symbols, 0).max(initial=0)) + 1
        parts = _binary(np.concatenate([np.arange(m), m + starts]), np.concatenate([np.arange(m, dtype=np.uint32), buffer]))
        out = _numbers(parts.take(pa.array(np.where(single, self.symbols, self.symbols - np.uint32(BASE - m)))))
        for a, b in zip(self.doc_starts[:-1], self.doc_starts[1:]):
            yield out[a:b]

    @staticmethod
    def _copy(out, at, symbols, length, starts, buffer) -> None:
        single = symbols < BASE
        out[at[single]] = symbols[single]
        src, dst, n = starts[symbols[~single] - BASE], at[~single], length[~single]
        if len(n):
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(dst, n) + step] = buffer[np.repeat(src, n) + step]


def pack(docs: list[np.ndarray] | np.ndarray, doc_tokens: np.ndarray | None = None, rounds: int | None = None, min_uses: int = MIN_USES) -> bytes:
    """A shard of the given documents' ids (a list of arrays, or one array and the documents' lengths)."""
    if doc_tokens is None:
        doc_tokens = np.array([len(d) for d in docs], np.uint32)
        docs = np.concatenate([*docs, np.empty(0, np.uint32)])
    if len(docs) and int(docs.max()) >= BASE:
        raise ValueError(f"ids must be below {BASE}")
    rules, lengths, seq = re_pair(docs, rounds, min_uses)
    head = _MAGIC + struct.pack("<4I", len(rules), len(seq), len(doc_tokens), len(docs))
    return head + b"".join(np.ascontiguousarray(x, "<u4").tobytes() for x in (rules, lengths, seq, doc_tokens))


# ---- Tokenizing


class PieceEncoder:
    """Ids of texts, piece by piece, by a tokenizer that drops white space, lowers case and ends words at white space.

    So the ids of a text are those of its pieces between white space, and those of a piece of letters followed by signs are
    the letters' ids and the signs' ids. Letters must be their own composed form (NFC) for that: others may become a letter and a
    mark, which the tokenizer joins with the signs. Each distinct piece of a batch is looked up once; parts that are not remembered go
    through the tokenizer, words of a to z straight to its model, as all steps before it leave them as they are.
    """

    # Not the apostrophe, which the tokenizer takes with some letters after it.
    _SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    # The one letter whose lower case is more than letters.
    _ODD = "\u0130"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # words come once; they are remembered here
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ids = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(ids.values()) + 1, bool)
        self.ends_word[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.letters = 0
        # ids of all parts, and where those of each part begin and end
        self.flat, self.bounds = array("I"), array("q", [0, 0])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if len(self.places) > _MAX_PIECES or self.letters + len(self.flat) > _MAX_LETTERS:
            self._forget()
        pieces = pc.ascii_split_whitespace(texts)
        offsets = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        del pieces
        first, second = self._parts_of(coded.dictionary)
        # Ids are taken as strings of bytes.
        known = _binary(np.frombuffer(self.bounds, "i8"), self.flat)
        own = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), pa.scalar(b"", pa.large_binary()))
        out = own.take(coded.indices)
        upto = np.frombuffer(out.buffers()[1], "i8")[out.offset :][offsets - offsets[0]] // 4
        return _numbers(out), np.diff(upto)

    def _parts_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the two parts of each piece; a piece that is not made of these is its own first part."""
        letters = pc.utf8_rtrim(pieces, self._SIGNS)
        plain = pc.and_(pc.utf8_is_alpha(letters), pc.invert(pc.match_substring(letters, self._ODD)))
        beyond = pc.and_(plain, pc.invert(pc.string_is_ascii(letters)))
        some = letters.filter(beyond).to_numpy(zero_copy_only=False).tolist()
        if not unicodedata.is_normalized("NFC", " ".join(some)):  # then some of them are not
            plain = plain.to_numpy(zero_copy_only=False).copy()
            plain[beyond.to_numpy(zero_copy_only=False)] = [unicodedata.is_normalized("NFC", s) for s in some]
            plain = pa.array(plain)
        signs = pc.if_else(plain, _ends_of(pieces, letters), "")
        return self._places(pc.if_else(plain, pc.ascii_lower(letters), pieces), plain), self._places(signs, plain)

    def _places(self, parts: pa.Array, plain: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = coded.indices.to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.places.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            words = np.zeros(len(names), bool)
            words[which] = plain.to_numpy(zero_copy_only=False)
            self._learn([names[i] for i in missing if words[i]], [names[i] for i in missing if not words[i]])
            found[missing] = [self.places[names[i]] for i in missing]
        return found[which]

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """`plain` parts are words to the tokenizer, so many of them can go in one text, whose ids show where words end."""
        for tokenizer, words in (self.model, [s for s in plain if s.isascii()]), (self.tokenizer, [s for s in plain if not s.isascii()]):
            texts = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
            found = tokenizer.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False) if texts else []
            for parts, x in zip(texts, found):
                ids = x.ids
                ends = np.flatnonzero(self.ends_word[np.array(ids, np.int64)])
                if len(ends) == len(parts):
                    self._remember(parts, ids, ends + 1)
                else:
                    other = other + parts
        for i in range(0, len(other), 4096):
            parts = other[i : i + 4096]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            self._remember(parts, list(itertools.chain.from_iterable(found)), np.cumsum([len(ids) for ids in found]))

    def _remember(self, parts: list[str], ids: list[int], ends: np.ndarray) -> None:
        first = len(self.bounds) - 1
        self.letters += sum(map(len, parts))
        self.places.update(zip(parts, range(first, first + len(parts))))
        self.bounds.frombytes((ends + len(self.flat)).astype(np.int64).tobytes())
        self.flat.extend(ids)


def _binary(bounds: np.ndarray, numbers: np.ndarray | array) -> pa.LargeBinaryArray:
    """Runs of 32-bit numbers, each as a string of bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(numbers)])


def _numbers(strings: pa.LargeBinaryArray) -> np.ndarray:
    """The numbers of all runs."""
    bounds = np.frombuffer(strings.buffers()[1], "i8")[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", "u4")[int(bounds[0]) // 4 : int(bounds[-1]) // 4]


def _ends_of(whole: pa.Array, beginnings: pa.Array) -> pa.Array:
    """What follows the beginning of each string."""
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    starts = offsets[:-1] + pc.binary_length(beginnings).to_numpy(zero_copy_only=False)
    sizes = offsets[1:] - starts
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(upto), pa.py_buffer(data[_runs(starts, sizes)]))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... `sizes[0]` numbers, then those of the next run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, kept from task to task."""
    kept = sys.modules.setdefault("_regmart_encoders", types.ModuleType("_regmart_encoders")).__dict__
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


# ---- Jobs


def write_shards(docs: DataFrame, tokenizer_path: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The table of shards of `docs` (doc_id, text), which it writes: whole texts, each with id `END_ID` at its end.

    Rows are dealt out by ranges of doc_id, so that `part` and `shard` ascend with it. A task holds the documents of one shard at a
    time, `shard_chars` characters and one more document at most. Rows of one doc_id are ordered, and may be parted, by a hash
    of their text. A null doc_id comes first, a null text counts as empty, repeated rows are written each, an empty
    table gives an empty table. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(size // (4 * shard_chars) + 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, start, ids, tokens, sizes, chars = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        encode = encoder(tokenizer_path).encode

        def take(doc_ids: pa.Array, text: pa.Array) -> None:
            """Encode some documents; only their ids and lengths are kept."""
            flat, n = encode(text)
            ends = np.cumsum(n + 1) - 1
            full = np.full(len(flat) + len(n), END_ID, np.uint32)
            inner = np.ones(len(full), bool)
            inner[ends] = False
            full[inner] = flat
            ids.append(doc_ids)
            tokens.append(full)
            sizes.append((n + 1).astype(np.uint32))

        def closed() -> pa.RecordBatch:
            nonlocal number, start, ids, tokens, sizes, chars
            doc_ids, full, n = pa.concat_arrays(ids).to_pylist(), np.concatenate(tokens), np.concatenate(sizes)
            ids, tokens, sizes, chars = [], [], [], 0
            pa.default_memory_pool().release_unused()  # what encoding took, which packing cannot use
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()),
                "start_in_part": pa.array([start], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "n_tokens": pa.array([len(full)], pa.int64()), "data": pa.array([pack(full, n)], pa.binary()),
            })
            number, start = number + 1, start + len(full)
            return out

        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            upto = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            a, before = 0, 0
            while a < batch.num_rows:
                most = min(shard_chars - chars, _ENCODED)
                b = min(batch.num_rows, int(np.searchsorted(upto, before + most)) + 1)
                take(batch.column(0).slice(a, b - a), text.slice(a, b - a))
                chars += int(upto[b - 1]) - before
                a, before = b, int(upto[b - 1])
                if chars >= shard_chars:
                    yield closed()
        if ids:
            yield closed()

    return written(dealt.select("doc_id", "text").mapInArrow(shards, _SHARD))


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (tokens of all documents before it), n_tokens and ids_crc32."""
    schema = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, doc_ids, data in zip(*batch.columns):
                shard = Shard(data.as_buffer())
                n = len(shard.doc_tokens)
                crcs = np.fromiter((zlib.crc32(x.astype("<u4", copy=False)) for x in shard.documents()), np.int64, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part.as_py(), np.int32)), doc_ids.values, pa.array(start.as_py() + shard.doc_starts[:-1]),
                    pa.array(shard.doc_tokens.astype(np.int64)), pa.array(crcs),
                ], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    # One row per part, each of which holds some 32 MB of text: few rows for the one task that adds them up.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    found = shards.select("part", "start_in_part", "doc_ids", "data").mapInArrow(opened, schema)
    return found.join(parts, "part").select(
        "doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents. Only the shards that list them are opened, and of those only their tokens expanded."""
    wanted = F.array(*(F.lit(int(i)).cast("long") for i in doc_ids))

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = set(doc_ids)
        for batch in batches:
            for ids, data in zip(batch["doc_ids"], batch["data"]):
                shard = Shard(bytes(data))
                rows = [(int(d), shard.document(i).tolist()) for i, d in enumerate(ids) if d is not None and int(d) in some]
                yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return shards.filter(F.arrays_overlap("doc_ids", wanted)).select("doc_ids", "data").mapInPandas(picked, "doc_id long, ids array<long>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))


QUERIES = {"op2_token_files": op2_token_files}
ORACLE: dict[str, str] = {}
