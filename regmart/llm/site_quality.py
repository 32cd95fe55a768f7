"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its path, its host and all hosts say.

The classifier's odds speak for a document alone. Its host and path have Beta posteriors, each with the level above it as its
prior: sparse paths are drawn towards their host, sparse hosts towards all. How strongly is estimated from how much
hosts and paths differ. All counts of a level come from grouped aggregation over all documents.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, join_groups, text_or_empty, written

FOLDS = 5
# The classifier is fitted on a sample of about this many labelled rows, or on all if there are fewer.
MAX_LABELS = 60_000
# Prior weights, in documents, are kept in this range; more could not be told apart.
WEIGHTS = (1.0, 10_000.0)
# Borders of the features' steps. Each step of a feature has its own weight in the classifier.
STEPS = {
    "words": (5, 20, 60, 200, 1000, 5000),
    "signs": (0.005, 0.015, 0.03, 0.05, 0.08, 0.15, 0.25),
    "digits": (0.002, 0.01, 0.03, 0.1, 0.3),
    "capitals": (0.01, 0.03, 0.06, 0.1, 0.3, 0.6),
    "unlike_words": (0.05, 0.15, 0.3, 0.45, 0.6, 0.7, 0.8, 0.9),
    "unlike_lines": (0.2, 0.5, 0.8, 0.95, 0.999),
    "bare_signs": (0.01, 0.05, 0.2, 0.4),
    "word_length": (3, 4.5, 5.5, 6.5, 7.5, 9),
    "top_word": (0.02, 0.05, 0.1, 0.2, 0.4),
}
_SIGNS, _DIGITS, _CAPITALS = (x.encode() for x in (string.punctuation, string.digits, string.ascii_uppercase))


def features(text: str) -> list[float]:
    """One number for each entry of `STEPS`. A text without words gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STEPS)
    data, lines, n = text.encode("utf-8"), text.split("\n"), len(words)
    share = lambda signs: (len(data) - len(data.translate(None, signs))) / len(data)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w[:4])))
    return [
        n, share(_SIGNS), share(_DIGITS), share(_CAPITALS), len(counts) / n, len(set(lines)) / len(lines), bare / n, len(text) / n,
        max(counts.values()) / n,
    ]


def design(rows: np.ndarray) -> np.ndarray:
    """A column of ones and one for each step but the lowest of each feature, 1 where the feature is beyond its border."""
    columns = [np.ones(len(rows))]
    for j, borders in enumerate(STEPS.values()):
        columns += [(rows[:, j] >= b).astype(float) for b in borders]
    return np.stack(columns, 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    prior = np.full(x.shape[1], ridge)
    prior[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(prior), x.T @ (y - p) - prior * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass(frozen=True)
class SitePriors:
    """`base`: share of good documents; `host`, `path`: documents that the level above weighs as much as."""

    base: float
    host: float
    path: float


def document_odds(docs: DataFrame, labels: DataFrame, folds: int | None, keep: list[str]) -> DataFrame:
    """`keep` columns, doc_id and `odds`, the classifier's log-odds of being good relative to the share of good ones; written."""

    @F.pandas_udf("array<double>")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(features)

    rows = written(docs.select("doc_id", *keep, measured(text_or_empty()).alias("features")))
    told = labels.select("doc_id", F.col("quality").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    if folds:
        told = told.filter(fold("doc_id", folds) != 0)
    share = MAX_LABELS / max(1, told.count())
    if share < 1:
        told = told.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = rows.select("doc_id", "features").join(F.broadcast(told), "doc_id").select("features", "label").toPandas()
    beta = np.zeros(len(design(np.zeros((0, len(STEPS)))).T))
    if sample["label"].nunique() == 2:
        y = (sample["label"] > 0).to_numpy(float)
        beta = fit_logistic(design(np.stack(sample["features"])), y)
        beta[0] -= math.log(y.mean() / (1 - y.mean()))

    @F.pandas_udf("double")
    def odds(measures: pd.Series) -> pd.Series:
        return pd.Series(design(np.stack(measures)) @ beta) if len(measures) else pd.Series([], dtype=float)

    base = (sample["label"] > 0).mean() if len(sample) else 0.5
    base = min(max(float(base), 1e-3), 1 - 1e-3)
    return written(rows.select("doc_id", *keep, odds("features").alias("odds"))), base


def _weight(groups: DataFrame, k: Column, n: Column, mean: Column) -> float:
    """Prior weight of groups with `n` documents, `k` of them good, around `mean`, by the method of moments.

    What the groups' shares vary beyond chance is the variance of the Beta prior; less variance is more weight.
    """
    extra = n * (n - 1)
    sums = groups.filter(n > 1).agg(
        F.sum(((k - n * mean) * (k - n * mean)) - n * mean * (1 - mean)).alias("beyond"), F.sum(extra * mean * (1 - mean)).alias("most")
    ).first()
    if not sums["most"]:
        return WEIGHTS[1]
    rho = max(1e-9, (sums["beyond"] or 0.0) / sums["most"])
    return float(min(max(1 / rho - 1, WEIGHTS[0]), WEIGHTS[1]))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, folds: int | None = FOLDS) -> DataFrame:
    """doc_id, held_out, own_score, host_rate, path_rate, score and predicted (1: good) of every row of `docs`.

    `host` and `path` name the level of each document, a path within its host; null is a value like others. Labels are learned from
    documents whose id's crc32 is not divisible by `folds` only, a sample of `MAX_LABELS` at most. Repeated labels count as bad if
    one is. Without labels of both kinds the documents' own evidence is even. Null texts count as empty, repeated rows
    one by one. What a document itself adds to its host and path is taken out before they speak for it.
    """
    named = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path"))
    named = named.withColumn("path", F.concat_ws("\1", "host", "path"))
    rows, base = document_odds(named, labels, folds, ["host", "path"])
    prior = math.log(base / (1 - base))
    own = 1 / (1 + F.exp(-(F.col("odds") + prior)))
    rows = rows.withColumn("own", own)
    # The hosts' and paths' sums are exact multiples of 2^-20, so that their order does not matter.
    unit = F.round(F.col("own") * (1 << 20)).cast("long")
    paths = written(rows.groupBy("host", "path").agg(F.sum(unit).alias("k_path"), F.count(F.lit(1)).alias("n_path")))
    hosts = written(paths.groupBy("host").agg(F.sum("k_path").alias("k_host"), F.sum("n_path").alias("n_host")))
    total, good = hosts.agg(F.sum("n_host"), F.sum("k_host")).first()
    if not total:
        total, good = 0, 0
    scale = float(1 << 20)
    mean = (good / scale / total) if total else base
    host_weight = _weight(hosts, F.col("k_host") / scale, F.col("n_host"), F.lit(mean))
    with_host = join_groups(paths, hosts, "host", "n_host", total).withColumn(
        "host_rate", (F.col("k_host") / scale + host_weight * mean) / (F.col("n_host") + host_weight)
    )
    path_weight = _weight(with_host, F.col("k_path") / scale, F.col("n_path"), F.col("host_rate"))
    levels = written(with_host.select("path", "k_host", "n_host", "k_path", "n_path"))
    joined = join_groups(rows.drop("host"), levels, "path", "n_path", total)
    others = lambda k, n, weight, above: (k / scale - F.col("own") + weight * above) / (n - 1 + weight)
    joined = joined.withColumn("host_rate", others(F.col("k_host"), F.col("n_host"), host_weight, mean))
    joined = joined.withColumn("path_rate", others(F.col("k_path"), F.col("n_path"), path_weight, F.col("host_rate")))
    inside = F.least(F.greatest(F.col("path_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
    score = 1 / (1 + F.exp(-(F.col("odds") + F.log(inside / (1 - inside)))))
    return joined.select(
        "doc_id", (fold("doc_id", folds or FOLDS) == 0).alias("held_out"), F.col("own").alias("own_score"), "host_rate", "path_rate",
        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
    )


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Their source stands for the host, their language within it for the path."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, F.col("source"), F.col("lang"))


QUERIES = {"op4_site_quality": op4_site_quality}
ORACLE: dict[str, str] = {}
