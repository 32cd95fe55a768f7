"""Mixing documents to target shares of tokens by iterative proportional fitting, and sampling them accordingly."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from .common import carried, join_groups, text_or_empty, written

# Raking stops when all margins are met this closely, or after so many rounds (targets that contradict each other).
TOLERANCE, MAX_ROUNDS = 1e-10, 1000
# Occupied cells of at most so many bytes are raked on the driver, more of them in Spark; the results are the same.
DRIVER_BYTES = 8 << 20
# Values that no target names, and nulls.
OTHER = "\0other"
# Tempering: shares of tokens are raised to this power.
POWER = 0.85
# The default budget: this share of all tokens is sampled, however rare the rarest cell is.
BUDGET_SHARE = 0.5
# Signs and words the topics are told by.
_SIGNS = "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"
_LEGAL = ("licensed under", "license", "copyright")


def measured(text: Column) -> Column:
    """Struct of tokens (pieces between white space) and topic: markup (many signs), records (many digits), legal (short, with a
    license line), note or article. A text without tokens is a note."""

    def topic(text: str, tokens: int) -> str:
        data = text.encode("utf-8")
        n = max(1, len(data))
        if len(data) - len(data.translate(None, _SIGNS.encode())) >= 0.05 * n:
            return "markup"
        if len(data) - len(data.translate(None, b"0123456789")) >= 0.03 * n:
            return "records"
        if tokens < 400 and any(word in text.lower() for word in _LEGAL):
            return "legal"
        return "note" if tokens < 200 else "article"

    @F.pandas_udf("tokens long, topic string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            tokens = batch.map(lambda t: len(t.split())).astype("int64")
            yield pd.DataFrame({"tokens": tokens, "topic": [topic(t, n) for t, n in zip(batch, tokens)]})

    return of(text)


def rake(tokens: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights of cells, summing to 1, whose sums by each margin are its targets.

    `margins`: each cell's value (a number) and the values' target shares. Targets are scaled to the values that have
    tokens. Cells keep the ratios of their tokens as far as the margins allow (iterative proportional fitting).
    """
    w = tokens / tokens.sum()
    shares = []
    for values, target in margins:
        here = np.where(np.bincount(values, tokens, len(target)) > 0, target, 0.0)
        if not here.sum():
            raise ValueError("no value with a target has tokens")
        shares.append(here / here.sum())
    for _ in range(MAX_ROUNDS):
        for (values, _), share in zip(margins, shares):
            have = np.bincount(values, w, len(share))
            w = w * (share / np.where(have > 0, have, 1.0))[values]
        off = max(np.abs(np.bincount(v, w, len(s)) - s).max() for (v, _), s in zip(margins, shares))
        if off < TOLERANCE:
            break
    return w / w.sum()


def mix(docs: DataFrame, tokens: str, targets: Mapping[str, Mapping[str, float]], budget: float | None = None) -> DataFrame:
    """`docs` with `probability`, by which each is to be sampled so that expected tokens meet all `targets`.

    `targets`: for each column its values and their shares of tokens; values that are not named (and nulls) go under `OTHER` if that has a
    share, else they get probability 0. `tokens`: column of token counts; documents without tokens count one. `budget`: expected
    tokens, by default as many as there can be without a probability above 1; with more, these stay 1.
    """
    keyed = docs
    cell = {f"_cell_{i}": name for i, name in enumerate(targets)}
    for c, name in cell.items():
        value = F.coalesce(F.col(name).cast("string"), F.lit(OTHER))
        keyed = keyed.withColumn(c, F.when(value.isin(list(targets[name])), value).otherwise(F.lit(OTHER)))
    shares = {
        c: docs.sparkSession.createDataFrame([(v, float(x)) for v, x in targets[name].items()], f"{c} string, _share double")
        for c, name in cell.items()
    }
    return _sampled_by(keyed, _cells(keyed, list(cell), tokens), shares, budget).drop(*cell)


def _cells(keyed: DataFrame, cell: list[str], tokens: str) -> DataFrame:
    """The occupied cells, with their _tokens (at least one a document) and _rows."""
    weight = F.greatest(F.col(tokens), F.lit(1)).cast("long")
    return written(keyed.groupBy(*cell).agg(F.sum(weight).alias("_tokens"), F.count(F.lit(1)).alias("_rows")))


def _sampled_by(keyed: DataFrame, cells: DataFrame, shares: Mapping[str, DataFrame], budget: float | None) -> DataFrame:
    """`keyed` with `probability`. `shares`: for each of the cells' columns its values and their _share of tokens, on any scale.

    Few occupied cells are raked on the driver and broadcast, and no document is shuffled. Else they stay in Spark, and each
    document gets the factors of its values, those of long margins by a join that spreads frequent values.
    """
    cell = list(shares)
    size = cells.agg(F.sum(sum((F.octet_length(c) for c in cell), F.lit(32)))).first()[0]
    if size is None:
        return keyed.withColumn("probability", F.lit(1.0))
    if size > DRIVER_BYTES:
        margins = _factors(cells, shares)
        level = _level_of(_with_rate(cells, margins, "_cells"), budget)
        rated = _with_rate(keyed, margins, "_rows")
        return rated.withColumn("probability", F.least(F.lit(1.0), F.col("_rate") * level)).drop("_rate")
    sums = cells.toPandas().sort_values(cell, ignore_index=True)
    margins = []
    for c in cell:
        target = dict(shares[c].select(c, "_share").toPandas().itertuples(index=False))
        place = {v: i for i, v in enumerate(sorted({*target, *sums[c]}))}
        margins.append((sums[c].map(place).to_numpy(), np.array([target.get(v, 0.0) for v in place])))
    have = sums["_tokens"].to_numpy(float)
    rate = rake(have, margins) / have
    sums["probability"] = np.minimum(1.0, rate * (1 / rate.max() if budget is None else _level(rate, have, budget)))
    listed = keyed.sparkSession.createDataFrame(sums[[*cell, "probability"]])
    return keyed.join(F.broadcast(listed), cell)  # a row for each cell


def _factors(cells: DataFrame, shares: Mapping[str, DataFrame]) -> dict[str, tuple[DataFrame, dict[str, int], bool]]:
    """`rake` in Spark, for any number of cells and values: for each column its values' _factor, numbers of _cells and _rows.

    A cell's weight is its tokens times the factors of its values. Each step sums the weights by one column, the other factors
    joined, and writes that column's new factors; one number a step comes to the driver. Also given: how many cells and
    rows there are in all, and whether the factors are short enough to broadcast.
    """
    sizes = cells.agg(F.count(F.lit(1)).alias("_cells"), F.sum("_rows").alias("_rows"), F.sum("_tokens").alias("_tokens")).first().asDict()
    margins = {}
    for c, share in shares.items():
        here = cells.groupBy(c).agg(F.count(F.lit(1)).alias("_cells"), F.sum("_rows").alias("_rows")).join(share, c, "left")
        here = written(here.withColumn("_share", F.coalesce("_share", F.lit(0.0))))
        total = here.agg(F.sum("_share")).first()[0]
        if not total:
            raise ValueError("no value with a target has tokens")
        begin = 1.0 if margins else 1.0 / sizes["_tokens"]
        here = here.withColumn("_share", F.col("_share") / total).withColumn("_factor", F.lit(begin))
        margins[c] = (here, sizes, fits_broadcast(here))
    for _ in range(MAX_ROUNDS):
        off = 0.0
        for c, (old, _, short) in margins.items():
            others = {k: v for k, v in margins.items() if k != c}
            sums = _with_rate(cells, others, "_cells").groupBy(c).agg(F.sum(F.col("_rate") * F.col("_tokens")).alias("_sum"))
            new = old.join(sums, c).withColumn("_off", F.abs(F.col("_factor") * F.col("_sum") - F.col("_share")))
            factor = F.col("_share") / F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(1.0)
            new = written(new.select(c, "_cells", "_rows", "_share", factor.alias("_factor"), "_off"))
            off = max(off, new.agg(F.max("_off")).first()[0])
            margins[c] = (new.drop("_off"), sizes, short)
        if off < TOLERANCE:
            break
    return margins


def _with_rate(rows: DataFrame, margins: Mapping[str, tuple[DataFrame, dict[str, int], bool]], size: str) -> DataFrame:
    """`rows` with _rate, the product of their values' factors. `size`: which of the sizes tells how many rows a value has."""
    rows = rows.withColumn("_rate", F.lit(1.0))
    for c, (values, sizes, short) in margins.items():
        listed = values.select(c, F.col(size).alias("_size"), "_factor")
        rows = rows.join(F.broadcast(listed), c) if short else join_groups(rows, listed, c, "_size", sizes[size])
        rows = rows.withColumn("_rate", F.col("_rate") * F.col("_factor")).drop("_size", "_factor")
    return rows


def _level_of(rated: DataFrame, budget: float | None) -> float:
    """`_level` of cells in Spark; without a budget the factor that brings the largest rate to 1."""
    rated = written(rated.select("_rate", F.col("_tokens").cast("double").alias("_tokens")))
    if budget is None:
        return 1 / rated.agg(F.max("_rate")).first()[0]
    factor = 0.0
    while True:  # each pass adds cells to those that stay whole
        whole = F.col("_rate") * factor >= 1
        full, rest = rated.agg(
            F.sum(F.when(whole, F.col("_tokens")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(F.col("_rate") * F.col("_tokens")))
        ).first()
        if not rest:
            return 1 / rated.filter("_rate > 0").agg(F.min("_rate")).first()[0]
        more = (budget - full) / rest
        if more <= factor * (1 + 1e-12):
            return max(factor, more)
        factor = more


def _level(rate: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor at which sampling with min(1, factor * rate) gives `budget` tokens, or all of them."""
    order = np.argsort(-rate)
    rate, tokens = rate[order], tokens[order]
    full = np.concatenate([[0.0], np.cumsum(tokens)])
    rest = np.cumsum((rate * tokens)[::-1])[::-1]
    for i in range(len(rate)):
        factor = (budget - full[i]) / rest[i] if rest[i] > 0 else np.inf
        if factor * rate[i] <= 1:
            return max(0.0, factor)
    return np.inf if rate.min() > 0 else 1 / rate[rate > 0].min()


def chance(*columns: str) -> Column:
    """The same number from 0 to 1 for the same values, whenever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang, source, others): row (all its columns), doc_id, text, lang, source, _tokens, _topic, probability and _sampled.

    Targets: sources, languages and topics by their tempered shares of tokens. Budget: `BUDGET_SHARE` of all tokens; cells too
    small for their part of it stay whole. Null sources, languages and texts are allowed, as are repeated rows, which share
    their fate, and an empty table. The caller's other columns may have any names.
    """
    counted = carried(docs, *[F.col(c) for c in ("doc_id", "text", "lang", "source")], measured(text_or_empty()).alias("_measured"))
    counted = counted.withColumn("_tokens", F.col("_measured.tokens")).withColumn("_topic", F.col("_measured.topic")).drop("_measured")
    cell = {"_cell_0": "source", "_cell_1": "lang", "_cell_2": "_topic"}
    for c, name in cell.items():
        counted = counted.withColumn(c, F.coalesce(F.col(name).cast("string"), F.lit(OTHER)))
    cells = _cells(counted, list(cell), "_tokens")
    shares = {c: cells.groupBy(c).agg(F.pow(F.sum("_tokens"), F.lit(POWER)).alias("_share")) for c in cell}
    every = cells.agg(F.sum("_tokens")).first()[0] or 0
    mixed = _sampled_by(counted, cells, shares, BUDGET_SHARE * every).drop(*cell)
    return mixed.withColumn("_sampled", chance("doc_id", "text") < F.col("probability"))


def sample_mixture(docs: DataFrame) -> DataFrame:
    """The sampled rows of `docs`, with their columns as they are."""
    return mixed_documents(docs).filter("_sampled").select("row.*")


def op1_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability it is sampled by and whether it is."""
    docs = mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return docs.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("n_tokens"), "probability",
        F.col("_sampled").alias("sampled"),
    )


QUERIES = {"op1_raked_mixture": op1_raked_mixture}
ORACLE: dict[str, str] = {}
