"""A gated recurrent language model, trained with numpy on all partitions and averaged.

Tokens are words; the output is factored into classes. The most frequent words are dealt into classes of `CLASS_WORDS` by rank,
and the model gives P(class | what came before) * P(word | class, what came before). All other words, also those never seen,
are dealt into `RARE` classes by their last two bytes; within these a word has its share of the class's training
tokens, smoothed, so that only the class depends on what came before.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, text_or_empty, written

FOLDS = 10
# Added to a word's count, as in the base score.
PSEUDO = 0.1
# Model: state size, classes of frequent words and words in each, classes of all other words.
HIDDEN = 16
CLASSES, CLASS_WORDS = 16, 64
RARE = 53
# Training: lanes that run side by side, tokens in a window of truncated backpropagation, step size.
LANES, WINDOW, RATE = 256, 16, 0.05
# The shared start of all partitions is learned from about so many tokens, in this many passes over fewer ones.
START_TOKENS, START_PASSES = 1_500_000, 4
# Counts of at most so many words are sent to the tasks; those of all others are joined. Longer words are never sent.
HEAD_WORDS, HEAD_BYTES = 300_000, 64
# Tasks work on so many characters at a time (and the rest of the last document).
CHUNK_CHARS = 10 << 20
# Stands for the end of a document; no word holds white space.
END = "\n"
_END = 0  # its symbol


# ---- Texts to words


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, with ASCII letters in lower case, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten()
    real = np.asarray(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), bool)
    upto = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    return (words if real.all() else words.filter(pa.array(real))), np.diff(upto)


def last_bytes(words: pa.Array) -> np.ndarray:
    """The number that the last two bytes of each word make."""
    data = np.concatenate([np.zeros(1, np.uint8), np.frombuffer(words.buffers()[2] or b"", np.uint8)])
    ends = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32)
    ends = ends[words.offset : words.offset + len(words) + 1].astype(np.int64)
    two = np.where(np.diff(ends) > 1, data[np.maximum(ends[1:] - 1, 0)], 0).astype(np.int64)
    return two * 256 + data[ends[1:]]


def rare_class(word: str) -> Column:
    """What `last_bytes` gives for the words of a column, modulo `RARE`."""
    two = F.expr(f"substring(encode({word}, 'utf-8'), greatest(octet_length({word}) - 1, 1), 2)")
    return F.pmod(F.conv(F.hex(two), 16, 10).cast("int"), F.lit(RARE))


def chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces whose last column, a text, has at most so many bytes, or one row."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            before = int(upto[a - 1]) if a else 0
            b = int(np.searchsorted(upto, before + chars - size, "right"))
            if b > a or not held:
                b = max(a + 1, b)
                held.append(batch.slice(a, b - a))
                size += int(upto[b - 1]) - before
                a = b
            if a < batch.num_rows or size >= chars:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    columns = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]
    columns[-1] = columns[-1].cast(pa.large_string())
    return pa.RecordBatch.from_arrays(columns, batches[0].schema.names)


def word_counts(texts: DataFrame) -> DataFrame:
    """Word and count over all of `texts`, with `END` once per text. Each task adds up its own words first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_docs = None, 0
        for chunk in chunks(batches, CHUNK_CHARS):
            n_docs += chunk.num_rows
            words, _ = words_of(chunk.column(0))
            own = words.value_counts()
            table = pa.table({"word": own.field(0), "n": own.field(1)})
            total = table if total is None else pa.concat_tables([total, table])
            if total.num_rows > 1_500_000:
                total = total.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if total.num_rows > 1_000_000:  # mostly rare words: nothing is gained by holding on to them
                    yield from _plain(total)
                    total = None
        if total is not None:
            yield from _plain(total.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]))
        yield pa.RecordBatch.from_pydict({"word": pa.array([END]), "n": pa.array([n_docs], pa.int64())})

    return texts.mapInArrow(counted, "word string, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


def _plain(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=50_000))


@dataclass
class Vocabulary:
    """What tasks know of the corpus: counts of the most frequent words, the rest by class.

    `head`: `END`, then words by falling count, with `counts`. The first `frequent` ones have their place in the model;
    `rare_tokens` and `rare_words` count all others by class. `tokens`, `words`: of the whole training corpus.
    """

    head: pa.Array
    counts: np.ndarray
    tokens: int
    words: int
    rare_tokens: np.ndarray
    rare_words: np.ndarray

    @property
    def frequent(self) -> int:
        return min(len(self.head), CLASSES * CLASS_WORDS)

    def sent(self, spark: SparkSession):
        """A broadcast of the fields, `HEAD_WORDS` words and their counts at most."""
        return spark.sparkContext.broadcast(tuple(getattr(self, f.name) for f in fields(self)))

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per word its symbol in the model (place, or CLASSES * CLASS_WORDS + rare class) and its place in `head`, -1 if not."""
        coded = words.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = CLASSES * CLASS_WORDS + last_bytes(coded.dictionary) % RARE
        symbol = np.where((place >= 0) & (place < self.frequent), place, rare).astype(np.int32)
        which = coded.indices.to_numpy(zero_copy_only=False)
        return symbol[which], place[which]

    def base_logs(self) -> np.ndarray:
        """log10 of the counts of `head`, smoothed."""
        return np.log10(self.counts + PSEUDO)

    def all_log(self) -> float:
        return math.log10(self.tokens + PSEUDO * (self.words + 1))

    def rare_logs(self) -> np.ndarray:
        return np.log10(self.rare_tokens + PSEUDO * (self.rare_words + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts of all words. The driver gets `HEAD_WORDS` words at most and a few sums."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    short = counts.filter((F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != END))
    # The least count that few enough words reach is found from a histogram of counts: 16 steps for each doubling.
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = {r[0]: r[1] for r in short.groupBy(step.alias("b")).agg(F.count(F.lit(1))).collect()}  # 64 * 16 rows at most
    least, kept = 1 << 20, 0
    for b in sorted(bins, reverse=True):
        if kept + bins[b] > HEAD_WORDS:
            break
        kept, least = kept + bins[b], b
    head = short.filter(step >= least).orderBy(F.desc("c"), "word").toPandas()  # HEAD_WORDS rows at most
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = [END, *head["word"]]
    top = counts.sparkSession.createDataFrame([(w,) for w in words[: CLASSES * CLASS_WORDS]], "word string")
    others = counts.join(F.broadcast(top), "word", "left_anti")
    tokens, kinds = np.zeros(RARE), np.zeros(RARE)
    for r in others.groupBy(rare_class("word").alias("r")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["r"]], kinds[r["r"]] = r["c"], r["v"]
    listed = np.concatenate([[ends], head["c"].to_numpy(np.int64)]).astype(np.int64)
    return Vocabulary(pa.array(words, pa.large_string()), listed, n, v, tokens, kinds)


# ---- The model


class Gru:
    """Symbols in, classes and words out. Arrays are laid out (feature, lane), so that steps work on long rows."""

    NAMES = ("inputs", "recur", "recur_bias", "classes", "class_bias", "words", "word_bias")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, vocabulary: Vocabulary, seed: int = 7) -> Gru:
        """Small random weights; the biases are those of the classes' and words' shares."""
        rng, h = np.random.default_rng(seed), HIDDEN
        small = lambda *shape: (rng.standard_normal(shape) / math.sqrt(h)).astype(np.float32)
        full = np.zeros(CLASSES * CLASS_WORDS)
        full[: vocabulary.frequent] = vocabulary.counts[: vocabulary.frequent]
        full = full.reshape(CLASSES, CLASS_WORDS)
        share = np.concatenate([full.sum(axis=1), vocabulary.rare_tokens]) + PSEUDO
        inside = np.where(np.arange(CLASSES * CLASS_WORDS).reshape(full.shape) < vocabulary.frequent, np.log(full + PSEUDO), -1e4)
        return cls({
            "inputs": small(3 * h, CLASSES * CLASS_WORDS + RARE) * np.float32(0.5), "recur": small(3 * h, h),
            "recur_bias": np.zeros((h, 1), np.float32), "classes": small(CLASSES + RARE, h) * np.float32(0.1),
            "class_bias": np.log(share / share.sum()).astype(np.float32)[:, None],
            "words": small(CLASSES, CLASS_WORDS, h) * np.float32(0.1), "word_bias": inside.astype(np.float32)[:, :, None],
        })

    def run(self, symbols: np.ndarray, keep: np.ndarray, state: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step (feature, step, lane) for input symbols (step, lane), and the last one.

        Where `keep` is 0 a document begins, and the state before that step is cleared.
        """
        h, p = HIDDEN, self.p
        steps, lanes = symbols.shape
        x = p["inputs"].take(symbols.ravel(), axis=1).reshape(3 * h, steps, lanes)
        out = np.empty((h, steps, lanes), np.float32)
        for t in range(steps):
            state = state * keep[t]
            g = p["recur"] @ state
            gates = g[: 2 * h]
            gates += x[: 2 * h, t]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r, inner = gates[:h], gates[h:], g[2 * h :]
            inner += p["recur_bias"]
            new = r * inner
            new += x[2 * h :, t]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((state, z, r, inner, new))
            state = state - new
            state *= z
            state += new
            out[:, t] = state
        return out, state

    def targets(self, hidden: np.ndarray, symbols: np.ndarray, back: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each symbol given its state (feature, n); for rare ones that of the class.

        With `back`, gradients of minus the sum of logs are put there, and that of the states is returned too.
        """
        p, n = self.p, len(symbols)
        frequent = CLASSES * CLASS_WORDS
        cls = np.where(symbols < frequent, symbols // CLASS_WORDS, symbols - frequent + CLASSES)
        logits = p["classes"] @ hidden
        logits += p["class_bias"]
        logits -= logits.max(axis=0)
        place = np.arange(n)
        picked = logits[cls, place]
        np.exp(logits, out=logits)
        total = logits.sum(axis=0)
        logs = picked - np.log(total)
        grad = None
        if back is not None:
            logits /= total
            logits[cls, place] -= 1
            back["classes"], back["class_bias"] = logits @ hidden.T, logits.sum(axis=1, keepdims=True)
            back["words"], back["word_bias"] = np.zeros_like(p["words"]), np.zeros_like(p["word_bias"])
            grad = p["classes"].T @ logits
        # Numbers of 16 bits are sorted by their digits, in a fraction of the time.
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = order[bounds[c] : bounds[c + 1]]
            if not len(at):
                continue
            states, word = hidden.take(at, axis=1), symbols[at] - c * CLASS_WORDS
            scores = p["words"][c] @ states
            scores += p["word_bias"][c]
            scores -= scores.max(axis=0)
            mine = np.arange(len(at))
            own = scores[word, mine]
            np.exp(scores, out=scores)
            sums = scores.sum(axis=0)
            logs[at] += own - np.log(sums)
            if back is not None:
                scores /= sums
                scores[word, mine] -= 1
                back["words"][c], back["word_bias"][c] = scores @ states.T, scores.sum(axis=1, keepdims=True)
                grad[:, at] += p["words"][c].T @ scores
        return logs, grad

    def gradients(self, inputs: np.ndarray, keep: np.ndarray, symbols: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean loss over one window, the state after it, and the loss. The state before it is a constant."""
        h, p = HIDDEN, self.p
        steps, lanes = inputs.shape
        trace: list = []
        out, last = self.run(inputs, keep, state, trace)
        back: dict[str, np.ndarray] = {}
        logs, grad = self.targets(out.reshape(h, -1), symbols.ravel(), back)
        grad = grad.reshape(h, steps, lanes)
        dx, dg = np.empty((3 * h, steps, lanes), np.float32), np.empty((3 * h, steps, lanes), np.float32)
        before = np.empty((h, steps, lanes), np.float32)
        carried = np.zeros((h, lanes), np.float32)
        up = np.ascontiguousarray(p["recur"].T)
        for t in range(steps - 1, -1, -1):
            prev, z, r, inner, new = trace[t]
            before[:, t] = prev
            d = grad[:, t] + carried
            keep_z = d * z
            dn = (d - keep_z) * (1 - new * new)
            dr = dn * inner * r * (1 - r)
            dz = keep_z * (prev - new) * (1 - z)
            dx[:h, t], dx[h : 2 * h, t], dx[2 * h :, t] = dz, dr, dn
            dg[:h, t], dg[h : 2 * h, t], dg[2 * h :, t] = dz, dr, dn * r
            carried = up @ dg[:, t]
            carried += keep_z
            carried *= keep[t]
        flat = dg.reshape(3 * h, -1)
        back["recur"] = flat @ before.reshape(h, -1).T
        back["recur_bias"] = flat[2 * h :].sum(axis=1, keepdims=True)
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ordered = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows = ordered[first]
        back["inputs"] = np.zeros_like(p["inputs"])
        back["inputs"][:, rows] = np.add.reduceat(dx.reshape(3 * h, -1).take(order, axis=1), first, axis=1)
        for name in self.NAMES:
            back[name] /= ids.size
        return back, last, -float(logs.mean())

    def train(self, symbols: np.ndarray, lanes: int = LANES, window: int = WINDOW, rate: float = RATE, squares: dict | None = None) -> dict:
        """One pass of truncated backpropagation over a stream of documents, each closed by the end symbol, in lanes.

        The state is carried from window to window and cleared at documents' beginnings. Steps are Adagrad's, whose sums of
        squares are returned.
        """
        squares = squares or {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        lanes = max(1, min(lanes, len(symbols) // (2 * window)))
        length = -(-len(symbols) // lanes)
        # The last lane is filled up with empty documents.
        stream = np.concatenate([[_END], symbols, np.full(lanes * length - len(symbols), _END)]).astype(np.int32)
        inputs, wanted = stream[:-1].reshape(lanes, length).T, stream[1:].reshape(lanes, length).T
        state = np.zeros((HIDDEN, lanes), np.float32)
        for a in range(0, length, window):
            x, y = np.ascontiguousarray(inputs[a : a + window]), np.ascontiguousarray(wanted[a : a + window])
            back, state, _ = self.gradients(x, (x != _END).astype(np.float32), y, state)
            for k, g in back.items():
                np.clip(g, -0.5, 0.5, out=g)
                squares[k] += g * g
                self.p[k] -= rate * g / np.sqrt(squares[k])
        return squares

    def document_logs(self, symbols: np.ndarray, sizes: np.ndarray, lanes: int = LANES, window: int = 2 * WINDOW) -> np.ndarray:
        """Natural log-probability of each document. Whole documents are dealt to lanes, the longest first; the state runs on
        from window to window until a document ends."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        lanes = max(1, min(lanes, len(sizes)))
        heap, dealt = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for d in order.tolist():
            length, i = heapq.heappop(heap)
            dealt[i].append(d)
            heapq.heappush(heap, (length + int(sizes[d]), i))
        lengths = np.array([sizes[d].sum() for d in dealt])
        by = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max())
        # The lanes' symbols one lane after the other: a long document beside short ones fills nothing up.
        flat = np.concatenate([symbols[starts[d] : starts[d] + sizes[d]] for i in by for d in dealt[i]])
        lengths = lengths[by]
        begins = np.cumsum(lengths) - lengths
        logs = np.empty(len(flat), np.float32)
        state = np.zeros((HIDDEN, lanes), np.float32)
        before = np.full((1, lanes), _END, np.int32)
        for a in range(0, longest, window):
            active = int(np.searchsorted(-lengths, -a, "left"))  # lanes that are longer than a
            steps = np.arange(a, min(a + window, longest))[:, None]
            real = steps < lengths[:active]
            places = np.where(real, begins[:active] + steps, 0)
            wanted = np.where(real, flat[places], _END)
            x = np.concatenate([before[:, :active], wanted[:-1]])
            out, state = self.run(x, (x != _END).astype(np.float32), state[:, :active])
            got, _ = self.targets(out.reshape(HIDDEN, -1), wanted.ravel())
            logs[places[real]] = got.reshape(wanted.shape)[real]
            before = wanted[-1:]
        result = np.empty(len(sizes))
        for i, a, n in zip(by, begins, lengths):
            own = logs[a : a + n].astype(np.float64)
            result[dealt[i]] = np.add.reduceat(own, np.cumsum(sizes[dealt[i]]) - sizes[dealt[i]])
        return result


def model(params: dict[str, np.ndarray]) -> Gru:
    """A model with parameters of its own, as they may come from memory that cannot be written to."""
    return Gru({k: v.copy() for k, v in params.items()})


def stream_of(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Symbols of all texts, each with the end symbol after it, and their numbers with it; heads' places and words without ends."""
    words, sizes = words_of(texts)
    symbols, places = vocabulary.ids(words)
    full = np.full(len(symbols) + len(sizes), _END, np.int32)
    inner = np.ones(len(full), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    full[inner] = symbols
    return full, sizes + 1, places, words


# ---- Jobs


def train(texts: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters learned from all of `texts` (mark, a hash of the row, and text).

    A start is learned from a sample of about `START_TOKENS` tokens, drawn by `mark`, and at most twice as many, should long texts be
    drawn. From it every partition goes on over all of its own
    documents, and the results are averaged by the numbers of their tokens; the averages are taken by Spark, number by number.
    """
    known = vocab.sent(texts.sparkSession)
    first = Gru.start(vocab).p

    def learner(params: dict[str, np.ndarray], passes: int, most: int | None = None):
        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gru, squares, tokens = model(params), None, 0
            for chunk in chunks(batches, CHUNK_CHARS):
                symbols, *_ = stream_of(chunk.column(0), Vocabulary(*known.value))
                symbols = symbols if most is None else symbols[: most - tokens]
                for _ in range(passes):
                    squares = gru.train(symbols, squares=squares)
                tokens += len(symbols)
                if tokens == most:
                    break
            if tokens:
                flat = np.concatenate([gru.p[k].ravel() for k in Gru.NAMES]).astype(np.float64)
                yield pa.RecordBatch.from_pydict({
                    "place": np.arange(len(flat), dtype=np.int32), "x": flat * tokens, "n": np.full(len(flat), tokens, np.int64),
                })

        return learned

    def averaged(rows: DataFrame) -> dict[str, np.ndarray]:
        """As many numbers as the model has, whatever the corpus."""
        got = rows.groupBy("place").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("place").toPandas()["x"].to_numpy(np.float32)
        out, at = {}, 0
        for k in Gru.NAMES if len(got) else ():
            out[k], at = got[at : at + first[k].size].reshape(first[k].shape), at + first[k].size
        return out or first

    schema = "place int, x double, n long"
    share = min(1.0, START_TOKENS / max(1, vocab.tokens))
    some = texts.filter(F.pmod("mark", F.lit(1 << 30)) < int(share * (1 << 30))).repartition(1).sortWithinPartitions("mark")
    first = averaged(some.select("text").mapInArrow(learner(first, START_PASSES, 2 * START_TOKENS), schema))
    return averaged(texts.select("text").mapInArrow(learner(first, 1), schema))


def score(docs: DataFrame, vocab: Vocabulary, params: dict[str, np.ndarray], counts: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Per row of `docs` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score, log10 of the whole text.

    Words in the vocabulary's head are scored where the text is read; each other word is looked up in `counts` by a
    join, and its logarithm added to the document it came from. A null text counts as empty and is one end token.
    Repeated rows are told apart by a number that is written with them.
    """
    known = vocab.sent(docs.sparkSession)
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<string>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, vocabulary, gru = TaskContext.get().partitionId() << 40, Vocabulary(*known.value), model(params)
        logs, all_log, rare_log = vocabulary.base_logs(), vocabulary.all_log(), vocabulary.rare_logs()
        for chunk in chunks(batches, CHUNK_CHARS):
            symbols, sizes, places, words = stream_of(chunk.column(1), vocabulary)
            n, doc = chunk.num_rows, np.repeat(np.arange(chunk.num_rows), sizes - 1)
            listed = places >= 0
            log = np.where(listed, logs[places], 0.0)
            inner = np.ones(len(symbols), bool)
            inner[np.cumsum(sizes) - 1] = False
            rare = symbols[inner] - CLASSES * CLASS_WORDS
            inside = np.where(rare >= 0, log - rare_log[np.maximum(rare, 0)], 0.0)
            tail = np.flatnonzero(~listed)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[tail], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "row": np.arange(row, row + n), "doc_id": chunk.column(0), "n_tokens": sizes,
                "n_known": np.bincount(doc[listed], minlength=n) + (vocabulary.counts[_END] > 0),
                "base": np.bincount(doc, log, n) + logs[_END] - sizes * all_log,
                "score": np.bincount(doc, inside, n) + gru.document_logs(symbols, sizes) / math.log(10),
                "tail": pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(tail)).cast(pa.string())),
            })
            row += n

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scored, schema))
    c = F.coalesce("c", F.lit(0))
    looked_up = rows.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    sums = looked_up.groupBy("row").agg(F.sum(F.log10(c + PSEUDO)).alias("more"), F.sum((c > 0).cast("long")).alias("more_known"))
    joined = rows.drop("tail").join(sums, "row", "left").na.fill(0, ["more", "more_known"])
    return joined.select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )


def fit_and_score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Learn from the texts whose id's crc32 is not divisible by `folds` and score all. An empty table gives no rows.

    A null text counts as empty, a null id as an empty text in the hash. Repeated rows are learned from and come out as often as they
    are there. Copies of a text under different ids are drawn for the start one by one.
    """
    texts = docs.filter(fold("doc_id", folds) != 0).select(F.xxhash64("doc_id", text_or_empty()).alias("mark"), text_or_empty().alias("text"))
    counts = written(word_counts(texts.select("text")))
    vocab = vocabulary(counts)
    return score(docs, vocab, train(texts, vocab), counts, folds)


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_gru_lm": op10_gru_lm}
ORACLE: dict[str, str] = {}
