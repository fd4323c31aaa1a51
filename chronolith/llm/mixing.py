"""Mixing sources to target weights: token weights are raked to marginals of source, language and topic by iterative
proportional fitting, and documents are sampled by the calibrated probabilities.

Tokens are first summed by cell (source, language, topic). Fitting multiplies each cell by one factor for each dimension;
a step sums the weighted cells by one dimension, and only these sums, one for each value of the dimension, and the factors pass
through the driver. A document's probability is its weight, the product of its factors, times one scale for all. The scale is
the largest that keeps every probability under 1, or, where a few heavy cells would make that small, the one by which RATE of
the tokens stay: probabilities over 1 are then 1, and the others share what is left in the proportion of their weights.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import sample_hash, stored, table, whole

LOG = logging.getLogger(__name__)
DIMENSIONS = ("source", "lang", "topic")
#: Target shares of the listed values; values not listed keep their own shares. A number flattens the own shares to that power.
TARGETS: dict = {"source": 0.7, "lang": {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}, "topic": {"prose": 0.9}}
TOLERANCE, SWEEPS, SEED = 1e-6, 60, 11
#: Share of the tokens that stays at least, where weights over 0 allow it.
RATE = 0.5
#: Factors of a dimension up to which they are written into the expression.
LISTED = 200
#: Factors of a dimension up to which they are broadcast to the documents; beyond, an ordinary join.
BROADCAST_MOST = 1_000_000


def topic() -> Column:
    """A text's form, as the corpus has no topics: table, symbols, shouting or prose, by its characters."""
    text = whole("text")
    n = F.greatest(F.length(text), F.lit(1))
    lower = F.length(text) - F.length(F.translate(text, "aeiou", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&", ""))
    pipes = F.length(text) - F.length(F.translate(text, "|", ""))
    return F.when(pipes * 40 > n, "table").when(symbols * 20 > n, "symbols").when(lower * 20 < n, "shouting").otherwise("prose")


def tokens() -> Column:
    """Words between white space."""
    return F.regexp_count(whole("text"), F.lit(r"[^ \t\n\r\f\x0B]++")).cast("long")


def drawn(seed: int = SEED) -> Column:
    """A number from 0 to 1 for each id and text, the same in every run: documents without an id, or of one id, are drawn one by one."""
    return sample_hash(F.struct(F.col("doc_id").cast("long"), F.xxhash64(whole("text").cast("string"))), seed)


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang (null: empty), topic, tokens, draw of every document."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMENSIONS[:2]]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named, topic().alias("topic"), tokens().alias("tokens"), drawn(seed).alias("draw"))


def wanted(own: dict[str, float], target) -> dict[str, float]:
    """Target shares of the values that occur, from their own tokens and a power or listed shares."""
    total = sum(own.values())
    if not total:
        return {}
    if not isinstance(target, dict):
        flat = {k: (v / total) ** float(target) for k, v in own.items() if v}
        return {k: v / sum(flat.values()) for k, v in flat.items()}
    listed = {k: target[k] for k in target if own.get(k)}
    rest = {k: v / total for k, v in own.items() if k not in listed and v}
    room = max(0.0, 1 - sum(rest.values()))
    scale = room / sum(listed.values()) if listed else 0.0
    return {k: v * scale for k, v in listed.items()} | (rest if listed else {k: v / sum(rest.values()) for k, v in rest.items()})


def _sums(cells: DataFrame, by: str, factors: dict[str, dict[str, float]]) -> dict[str, float]:
    """The weighted tokens of each value of one dimension. The sums are of decimals, the same in any order of the cells."""
    weighed = by_factors(cells, factors)
    found = weighed.groupBy(by).agg(F.sum((F.col("tokens") * F.col("weight")).cast("decimal(38,9)")).cast("double").alias("w")).collect()
    return {r[by]: r.w or 0.0 for r in sorted(found)}


def rake(cells: DataFrame, targets: dict, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[dict[str, dict[str, float]], float]:
    """The factors of each dimension's values, and the largest gap left between a marginal's share and its target.

    Where no weights meet all targets (empty cells), the sweeps end at their number and the gap says so."""
    factors: dict[str, dict[str, float]] = {d: {} for d in DIMENSIONS}
    goals = {d: wanted(_sums(cells, d, factors), targets[d]) for d in DIMENSIONS}
    gap = 0.0
    for _ in range(sweeps):
        gap = 0.0
        for d in DIMENSIONS:
            now = _sums(cells, d, factors)
            total = sum(now.values())
            if not total:
                return factors, 0.0
            gap = max([gap, *(abs(now.get(k, 0) / total - g) for k, g in goals[d].items())])
            for k, g in goals[d].items():
                if now.get(k):
                    factors[d][k] = factors[d].get(k, 1.0) * g / (now[k] / total)
        if gap < tolerance:
            break
    return factors, gap


def by_factors(df: DataFrame, factors: dict[str, dict[str, float]]) -> DataFrame:
    """df with the weight of its rows' cells."""
    weight = F.lit(1.0)
    for d in DIMENSIONS:
        if 0 < len(factors[d]) <= LISTED:
            listed = F.create_map(*[F.lit(x) for item in sorted(factors[d].items()) for x in item])
            weight = weight * F.coalesce(F.try_element_at(listed, F.col(d)), F.lit(1.0))
        elif factors[d]:
            table_ = df.sparkSession.createDataFrame(sorted(factors[d].items()), f"{d} string, f_{d} double")
            df = df.join(F.broadcast(table_) if len(factors[d]) <= BROADCAST_MOST else table_, d, "left")
            weight = weight * F.coalesce(F.col(f"f_{d}"), F.lit(1.0))
    return df.withColumn("weight", weight).drop(*[f"f_{d}" for d in DIMENSIONS])


def scale_of(cells: DataFrame, rate: float = RATE) -> float:
    """What weights are multiplied by, from the cells' tokens and weights: 1 over the largest weight, or more where that keeps less
    than rate of the tokens.

    The cells whose probability reaches 1 are found by repetition: they keep all their tokens, the others are scaled to the rest
    of the budget, and as that only raises the scale, cells join them until none does. Sums are decimal, the same in any order."""
    w, t = F.col("weight"), F.col("tokens").cast("decimal(20,0)")
    most, total = cells.where("tokens > 0").agg(F.max("weight"), F.sum(t)).first()
    if not most:
        return 1.0
    scale, full = 1.0 / most, None
    while True:
        # the first time no cell counts as full
        over = F.lit(False) if full is None else w * scale >= 1
        n, kept, rest = cells.where("tokens > 0").agg(F.count_if(over), F.sum(F.when(over, t)), F.sum(F.when(~over, (w * t.cast("double")).cast("decimal(38,12)")))).first()
        if n == full or not rest:
            return scale
        scale, full = max(scale, (rate * float(total) - float(kept or 0)) / float(rest)), n


class Fit(NamedTuple):
    """factors and scale; gap: the largest between a marginal's share by weight and its target; kept: expected share of the tokens;
    kept_gap: the largest between a marginal's expected share of what stays and its target, over gap where probabilities end at 1."""

    factors: dict[str, dict[str, float]]
    scale: float
    gap: float
    kept: float
    kept_gap: float


def fit(cells: DataFrame, targets: dict, rate: float = RATE) -> Fit:
    """The calibration of the cells (source, lang, topic, tokens), also written to the log."""
    factors, gap = rake(cells, targets)
    weighed = by_factors(cells, factors)
    scale = scale_of(weighed, rate)
    expected = weighed.withColumn("kept", F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * scale))
    kept_gap, total, stay = 0.0, 0.0, 0.0
    for d in DIMENSIONS:
        found = expected.groupBy(d).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept")).collect()
        total, stay = float(sum(r.tokens for r in found)), sum(r.kept for r in found)
        now = {r[d]: r.kept / stay for r in found} if stay else {}
        goals = wanted({r[d]: float(r.tokens) for r in found}, targets[d]) if stay else {}
        kept_gap = max([kept_gap, *(abs(now.get(k, 0.0) - g) for k, g in goals.items())])
    out = Fit(factors, scale, gap, stay / total if total else 0.0, kept_gap)
    LOG.info("mixing: gap %.2g by weight, %.2g of what stays; %.4f of the tokens stay", out.gap, out.kept_gap, out.kept)
    return out


def mix(docs: DataFrame, targets: dict | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (its tokens' relative weight), probability, sampled for every document.

    A document is sampled if the hash of its id and text is under its probability, so a rerun takes the same ones. Null source or
    language is the value ''; null and empty texts have no tokens and their cell's probability. Rows that repeat an id and a text are
    sampled together, and so are rows without either; others, with an id or not, are drawn for themselves. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(measured(docs, seed), "measured")
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    found = fit(cells, targets or TARGETS, rate)
    out = by_factors(rows, found.factors).withColumn("probability", F.least(F.lit(1.0), F.col("weight") * found.scale))
    return out.select("doc_id", *DIMENSIONS, "tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, targets: dict | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """The sampled documents, whole rows with all their columns, whatever their names, without a shuffle of their texts: each row meets its
    cell's probability again. Null sources, languages and texts, repeated ids and empty tables are as in `mix`."""
    rows = mix(docs, targets, seed, rate)
    shares = stored(rows.groupBy(*DIMENSIONS).agg(F.max("probability").alias("probability")), "shares")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), drawn(seed).alias("draw"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMENSIONS[:2]], topic().alias("topic"))
    small = shares.count() <= BROADCAST_MOST
    joined = own.join(F.broadcast(shares) if small else shares, list(DIMENSIONS))
    return joined.where(F.col("draw") < F.col("probability")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
