"""Spectra of readings at their own instants: a periodogram on each series' own periods, its density, dominant period and bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.sources.shared import stored

#: Periods of a series' grid; readings of a part of a series; readings that meet the periods at once; series whose spectra are sent at once.
PERIODS, PART, AT_ONCE, SERIES = 400, 65_536, 2048, 64
#: Cycles of a period that a series must hold for the period to be called dominant.
CYCLES = 4


def grid(shortest: float, longest: float, n: int = PERIODS) -> np.ndarray:
    """n periods, equally far apart in their logarithm."""
    return np.logspace(np.log10(shortest), np.log10(longest), n)


def _sums(t: np.ndarray, y: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Of cosines and sines of every period at the instants t: the sums of c, s, cc, cs, yc and ys."""
    w, out = 2 * np.pi / periods, np.zeros((6, len(periods)))
    for i in range(0, len(t), AT_ONCE):
        phase, v = np.outer(w, t[i : i + AT_ONCE]), y[i : i + AT_ONCE]
        c, s = np.cos(phase), np.sin(phase)
        out += [c.sum(axis=1), s.sum(axis=1), (c * c).sum(axis=1), (c * s).sum(axis=1), c @ v, s @ v]
    return out


def _explained(sums: np.ndarray, n: float, yy: float) -> np.ndarray:
    """The share of the variance yy that a sine of each period with a floating mean explains; 0 where it is not defined."""
    c, s, cc, cs, yc, ys = sums / n
    cc, ss, cs = cc - c * c, 1 - cc - s * s, cs - c * s
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs))
    return np.where(np.isfinite(p), np.clip(p, 0, 1), 0.0)


def periodogram(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), n_periods: int = PERIODS, least: int = 8) -> DataFrame:
    """by, k, period, explained, density, span_s: the share of each series' variance that a sine of the period explains, and the power
    scaled so that its integral over frequency is the variance, on n_periods periods from twice the median gap between readings (2 s at
    least) to the series' span (twice the shortest where the span is no longer).

    Null readings are left out, and series of under `least` others. A flat series explains nothing. A series of up to PART readings is worked
    out where its readings meet, one after the other along sorted rows. A longer one is dealt over tasks by stretches of about PART readings; what
    a task sends for one, and what is joined, are six sums a period, whatever the number of readings."""
    own = samples.where(F.col(value).isNotNull()).select(*by, "us", F.col(value).cast("double").alias("y"))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy(*by).orderBy("us"))
    stats = own.withColumn("gap", gap).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1"), F.avg("y").alias("mean"), F.var_pop("y").alias("yy"), (F.percentile("gap", 0.5) / 1e6).alias("gap"))
    shortest = F.greatest(2 * F.col("gap"), F.lit(2.0))
    span = (F.col("t1") - F.col("t0")) / 1e6
    stats = stats.where(F.col("n") >= least).select(*by, "n", "t0", "mean", "yy", shortest.alias("shortest"), F.when(span <= shortest, 2 * shortest).otherwise(span).alias("longest"), F.round(span).alias("span_s"))
    stats = stored(stats, "series")
    t = (F.col("us") - F.col("t0")) / 1e6
    facts = ["n", "yy", "shortest", "longest", "span_s"]
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*by).schema.fields)
    told = f"{keys}, k int, period double, explained double, density double, span_s double"

    def rows(of: DataFrame) -> DataFrame:
        return own.join(of, list(by)).select(*by, t.alias("t"), (F.col("y") - F.col("mean")).alias("y"), *facts)

    def found(sums: np.ndarray, n: float, yy: float, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _explained(sums, float(n), float(yy)) if yy > 0 else np.zeros(len(periods))
        frequency = 1 / periods
        area = float((0.5 * (p[1:] + p[:-1]) * (frequency[:-1] - frequency[1:])).sum())
        return p, p * (yy / area) if area > 0 else p

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in chain(batches, [None]):
            last = part is None
            part = rest if last else part if rest is None else pd.concat([rest, part], ignore_index=True)
            if part is None or not len(part):
                continue
            n, yy, low, high, y, at = (part[c].to_numpy(float) for c in ("n", "yy", "shortest", "longest", "y", "t"))
            i, starts = 0, []
            while i < len(part):  # a series' rows stand together, n of them
                starts.append(i)
                i += int(n[i])
            if i > len(part):
                rest = part.iloc[starts.pop() :].reset_index(drop=True)
            else:
                rest = None
            for j in range(0, len(starts), SERIES):
                some = starts[j : j + SERIES]
                periods = [grid(low[i], high[i], n_periods) for i in some]
                made = [found(_sums(at[i : i + int(n[i])], y[i : i + int(n[i])], p), n[i], yy[i], p) for i, p in zip(some, periods)]
                out = part[[*by, "span_s"]].iloc[np.repeat(some, n_periods)].reset_index(drop=True)
                yield out.assign(k=np.tile(np.arange(n_periods, dtype=np.int32), len(some)), period=np.concatenate(periods), explained=np.concatenate([x for x, _ in made]), density=np.concatenate([x for _, x in made]))

    def partial(batches):
        for batch in batches:
            out = batch.groupby(list(by), sort=False, dropna=False)
            sums = [(g.iloc[0], _sums(g["t"].to_numpy(), g["y"].to_numpy(), grid(g["shortest"].iloc[0], g["longest"].iloc[0], n_periods)).ravel()) for _, g in out]
            yield pd.DataFrame([x[0][[*by, *facts]] for x in sums]).assign(sums=[x[1] for x in sums])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        periods = grid(first["shortest"], first["longest"], n_periods)
        p, density = found(np.sum(rows["sums"].to_list(), axis=0).reshape(6, n_periods), first["n"], first["yy"], periods)
        own_keys = {c: [first[c]] * n_periods for c in by}
        return pd.DataFrame(own_keys | {"k": np.arange(n_periods, dtype=np.int32), "period": periods, "explained": p, "density": density, "span_s": first["span_s"]})

    short = rows(stats.where(F.col("n") <= PART)).repartition(*by).sortWithinPartitions(*by).mapInPandas(along, told)
    long = rows(stats.where(F.col("n") > PART)).withColumn("part", F.floor(F.col("t") / F.col("longest") * F.ceil(F.col("n") / PART)))
    parts = long.repartition(*by, "part").sortWithinPartitions(*by).drop("part").mapInPandas(partial, f"{keys}, n long, yy double, shortest double, longest double, span_s double, sums array<double>")
    return short.unionByName(parts.groupBy(*by).applyInPandas(joined, told))


def dominant_period(spectrum: DataFrame, by: list[str]) -> DataFrame:
    """by, period, explained: of the periods of which a series holds CYCLES cycles at least the one of most power (the shortest of equal
    ones), and the share of the variance it explains; null and 0 without such a period, or without power."""
    candidate = (F.col("period") <= F.col("span_s") / CYCLES) & (F.col("density") > 0)
    order = F.when(candidate, F.struct("density", (-F.col("k")).alias("k")))
    return spectrum.groupBy(*by).agg(F.max_by("period", order).alias("period"), F.coalesce(F.max_by("explained", order), F.lit(0.0)).alias("explained"))


def log_bands(spectrum: DataFrame, by: list[str], bins: int = 160) -> DataFrame:
    """by, bin, center, density: mean density in equal bins of the logarithm of a series' periods; bins without a period are left out."""
    x = F.log10("period")
    own = Window.partitionBy(*by)  # a series' periods, a few hundred: a join with their span would make the spectrum twice
    at = spectrum.select(*by, "period", "density").withColumns({"_a": F.min(x).over(own), "_b": F.max(x).over(own)})
    bin_ = F.greatest(F.lit(0), F.least(F.floor((x - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))).cast("int")
    center = F.pow(F.lit(10.0), F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("bin") + 0.5) / bins)
    return at.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.first(center).alias("center"), F.avg("density").alias("density"))
