"""Toxic passages as maximum-scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, text_or_empty, written

FOLDS = 5
# The model is fitted on a sample of about this many labelled rows, or on all if there are fewer.
MAX_LABELS = 400_000
# Dirichlet prior: documents that each form gets besides, and so many more shared out as the forms are in all documents.
FLAT_PRIOR = 1.0
SHARED_PRIOR = 1000.0
# A form is in the lexicon if it is so many standard errors and so much (log-odds) likelier in toxic documents.
MIN_Z = 3.29
MIN_LOG_ODDS = 2.5
# A longer word is taken as several ones of so many characters.
MAX_WORD = 64
# Stems stand in for words that are not in the lexicon themselves.
STEMS = (6, 5, 4)
# A passage is significant if chance gives fewer such ones in a clean document of the same length.
MAX_E_VALUE = 0.05
# A task's table of counts is handed on when it has so many forms.
_FLUSH = 200_000
_WORD = re.compile(rf"\w{{1,{MAX_WORD}}}")
# Letters of scripts that put no spaces between words (Thai and Lao, Burmese, Khmer, kana, Chinese characters).
_RANGES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_RANGES}]")
_RUN = re.compile(rf"[{_RANGES}]+|[^\W{_RANGES}]{{1,{MAX_WORD}}}")
# Evidence is counted in steps of this size, up to _LIMIT, for the calibration.
_STEP, _LIMIT = 0.25, 50


@dataclass(frozen=True)
class ToxicityModel:
    """`forms`: log-odds of words and stems; `other`: of all other words (negative); `k`: of the extreme-value distribution;
    `a`, `b`: of the calibration; `base`: share of toxic documents among the labelled ones.

    The distribution's rate is 1, as it is for any scores that are log-odds of two distributions.
    """

    forms: dict[str, float]
    other: float
    k: float
    a: float
    b: float
    base: float

    def e_value(self, score: float, n_words: int) -> float:
        """The number of segments of this score or more that chance gives in a clean document of so many words."""
        return self.k * max(1, n_words) * math.exp(-score)

    def evidence(self, scores: list[float], n_words: int) -> float:
        """Minus the logarithm of the best segment's p-value, and of the E-values of all further significant ones."""
        if not scores:
            return 0.0
        each = sorted(self.e_value(s, n_words) for s in scores)
        best = -math.log(max(1e-300, -math.expm1(-each[0])))
        return best - sum(math.log(max(1e-300, e)) for e in each[1:] if e <= MAX_E_VALUE)

    def probability(self, scores: list[float], n_words: int) -> float:
        if not self.forms:
            return self.base
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a + self.b * self.evidence(scores, n_words)))))


def forms_of(word: str) -> list[str]:
    return [word, *(word[:n] for n in STEMS if len(word) > n)]


def spans_of(text: str) -> list[tuple[int, int]]:
    """Beginnings and ends of the words of a text in lower case. Where a script has no spaces, each two neighbouring characters are a
    word, so that a term is seen wherever it stands in a run."""
    if text.isascii() or not _UNSPACED.search(text):
        return [m.span() for m in _WORD.finditer(text)]
    spans = []
    for a, b in (m.span() for m in _RUN.finditer(text)):
        spans += [(i, i + 2) for i in range(a, b - 1)] if b > a + 1 and _UNSPACED.match(text, a) else [(a, b)]
    return spans


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isascii() or not _UNSPACED.search(text):
        return _WORD.findall(text)
    return [text[a:b] for a, b in spans_of(text)]


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first and last word) in one pass; each word that is no hit scores `other`.

    The candidates are kept as a stack with the sums before and after each of them. A new one absorbs earlier ones as long as
    that makes a larger sum (Ruzzo and Tompa's algorithm). Words without positive score only lower the sum, so
    they are passed over in one step.
    """
    found: list[tuple[float, float, int, int]] = []
    total, at = 0.0, 0
    for i, s in hits:
        total += (i - at) * other
        new = (total, total + s, i, i)
        total, at = total + s, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(right - left, first, last) for left, right, first, last in found]


def hits_of(words: list[str], forms: dict[str, float], starts: set[str]) -> list[tuple[int, float]]:
    """Positions and log-odds of the words that are in the lexicon themselves or by their longest stem there."""
    out, short = [], min(STEMS)
    for i, w in enumerate(words):
        if w[:short] in starts:
            for form in forms_of(w):
                if form in forms:
                    out.append((i, forms[form]))
                    break
    return out


def _starts(forms: dict[str, float]) -> set[str]:
    return {x[: min(STEMS)] for x in forms}


def _form_counts(train: DataFrame) -> DataFrame:
    """Clean (c0) and toxic (c1) documents per form."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: tuple[Counter, Counter] = (Counter(), Counter())

        def handed() -> pd.DataFrame:
            forms = list(docs[0].keys() | docs[1].keys())
            rows = pd.DataFrame({"form": forms, "clean": [docs[0][x] for x in forms], "toxic": [docs[1][x] for x in forms]})
            docs[0].clear()
            docs[1].clear()
            return rows

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                docs[label].update({f for w in set(words_of(text)) for f in forms_of(w)})
                if len(docs[0]) + len(docs[1]) > _FLUSH:
                    yield handed()
        if docs[0] or docs[1]:
            yield handed()

    counts = train.mapInPandas(count, "form string, clean long, toxic long")
    return counts.groupBy("form").agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1"))


def _lexicon(counts: DataFrame) -> dict[str, float]:
    """Log-odds, with Dirichlet priors, of the forms that tell toxic from clean documents.

    All of them: a form needs some labelled toxic documents to be significant, so there are no more than a fraction of these
    documents' words, and at most `MAX_LABELS` documents are labelled."""
    n0, n1, forms = counts.agg(F.sum("c0"), F.sum("c1"), F.count(F.lit(1))).first()
    if not n0 or not n1:
        return {}
    prior = FLAT_PRIOR + F.lit(SHARED_PRIOR / (n0 + n1)) * (F.col("c0") + F.col("c1"))
    all_prior = FLAT_PRIOR * forms + SHARED_PRIOR
    y1, y0 = F.col("c1") + prior, F.col("c0") + prior
    odds = F.log(y1 / (n1 + all_prior - y1)) - F.log(y0 / (n0 + all_prior - y0))
    scored = counts.select("form", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    kept = scored.filter((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_LOG_ODDS))
    return {r["form"]: r["odds"] for r in kept.select("form", "odds").collect()}


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = FOLDS) -> ToxicityModel:
    """Learn from labelled documents whose id's crc32 is not divisible by `folds` (None: from any), `MAX_LABELS` at most.

    `docs`: doc_id, text; `labels`: doc_id, toxic (0/1). Rows with a null id or label teach nothing, a null text counts as
    empty; a document with several labels is toxic if one of them says so, repeated documents count one by one.
    Without documents of either kind the model gives every text the share of toxic ones (0.5 if nothing is known).

    Three passes over labelled documents: forms are counted, the lexicon's words are found, and from these, which are few
    numbers per document, the segments' statistics and the calibration come. The driver gets the lexicon and a histogram.
    """
    told = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna()
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    if folds:
        told, texts = told.filter(fold("doc_id", folds) != 0), texts.filter(fold("doc_id", folds) != 0)
    share = MAX_LABELS / max(1, told.count())
    if share < 1:
        told = told.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    told = told.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    # The sample has two numbers a row, so all tasks get it, and no text is shuffled.
    train = written(texts.join(F.broadcast(told), "doc_id").select("text", "label"))
    forms = _lexicon(written(_form_counts(train)))
    starts = _starts(forms)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"]):
                words = words_of(text)
                hits = hits_of(words, forms, starts)
                rows.append((label, len(words), len(hits), [i for i, _ in hits], [s for _, s in hits]))
            yield pd.DataFrame(rows, columns=["label", "n_words", "n_hits", "places", "odds"])

    hits = written(train.mapInPandas(found, "label int, n_words int, n_hits int, places array<int>, odds array<double>"))
    by = {r["label"]: r for r in hits.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_hits")), F.count(F.lit(1)).alias("n")).collect()}
    if len(by) < 2 or not forms:
        known = sum(r["n"] for r in by.values())
        return ToxicityModel({}, 0.0, 1.0, 0.0, 0.0, by[1]["n"] / known if 1 in by else 0.0 if known else 0.5)
    miss = [(by[y]["n_words"] - by[y]["n_hits"] + 1) / (by[y]["n_words"] + 2) for y in (0, 1)]
    other = min(-1e-3, math.log(miss[1]) - math.log(miss[0]))

    @F.pandas_udf("array<double>")
    def scores(places: pd.Series, odds: pd.Series) -> pd.Series:
        return pd.Series([[s for s, _, _ in segments(list(zip(p, o)), other)] for p, o in zip(places, odds)])

    scored = written(hits.select("label", "n_words", scores("places", "odds").alias("scores")))
    # Maximum likelihood: clean documents per sum of words times exp(-best score).
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    clean = scored.filter("label = 0").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(1), F.col("n_words")) * F.exp(-best)).alias("m")
    ).first()
    model = ToxicityModel(forms, other, clean["n"] / clean["m"], 0.0, 0.0, by[1]["n"] / (by[0]["n"] + by[1]["n"]))

    @F.pandas_udf("int")
    def step(scores: pd.Series, n_words: pd.Series) -> pd.Series:
        return pd.Series([round(min(_LIMIT, model.evidence(list(s), n)) / _STEP) for s, n in zip(scores, n_words)], dtype="int32")

    steps = scored.groupBy(step("scores", "n_words").alias("x"), "label").agg(F.count(F.lit(1)).alias("n"))
    a, b = _logistic([(r["x"] * _STEP, r["label"], r["n"]) for r in steps.collect()])  # 2 * (_LIMIT / _STEP + 1) rows at most
    return ToxicityModel(forms, other, model.k, a, b, model.base)


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope for counted points; a weak normal prior keeps them finite when the classes do not overlap."""
    x, y, n = (np.array(v, dtype=float) for v in zip(*points))
    design, beta, ridge = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Struct of score (0 to 1), n_passages (significant segments) and worst (the best segment's score) for a text."""
    starts = _starts(model.forms)

    @F.pandas_udf("score double, n_passages int, worst double")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                scores = [s for s, _, _ in segments(hits_of(words, model.forms, starts), model.other)]
                n = sum(model.e_value(s, len(words)) <= MAX_E_VALUE for s in scores)
                rows.append((model.probability(scores, len(words)), n, max(scores, default=0.0)))
            yield pd.DataFrame(rows, columns=["score", "n_passages", "worst"])

    return judged(text)


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant toxic passage: doc_id, first and last word (from 0), score, e_value and its text."""
    starts = _starts(model.forms)
    schema = "doc_id long, first_word int, last_word int, score double, e_value double, passage string"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                lower = text.lower()
                spans = spans_of(lower)
                words = [lower[a:b] for a, b in spans]
                for s, i, j in segments(hits_of(words, model.forms, starts), model.other):
                    e = model.e_value(s, len(words))
                    if e <= MAX_E_VALUE:
                        rows.append((doc_id, i, j, s, e, lower[spans[i][0] : spans[j][1]]))
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(listed, schema)


def score_documents(docs: DataFrame, model: ToxicityModel, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row of `docs`, from its whole text and nothing else.

    A null text counts as empty and has no segment; a null id is held out like the id '' would be. No shuffle.
    """
    rows = docs.select("doc_id", score_column(model, text_or_empty()).alias("s"))
    return rows.select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.n_passages").alias("n_passages"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with their columns as they are."""
    return docs.filter(score_column(model, text_or_empty())["score"] < 0.5)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
