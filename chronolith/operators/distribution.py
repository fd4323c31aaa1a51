"""Histograms, spectra, clouds and correlations."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 10_000

def bin_of(value: Column, low: Column, high: Column, n: int) -> Column:
    """The bin from 0 of equal bins between low and high, the last one closed; null outside."""
    return F.when((value >= low) & (value <= high) & (high > low), F.least(F.floor((value - low) / (high - low) * n), F.lit(n - 1)).cast("int"))


def ends(low: Column, high: Column) -> tuple[Column, Column]:
    """The range of a histogram: of a single value, the larger of 1 % and 0.5 around it."""
    pad = F.greatest(F.abs(low) * 0.01, F.lit(0.5))
    return F.when(low == high, low - pad).otherwise(low), F.when(low == high, high + pad).otherwise(high)


def histogram(rows: DataFrame, value: str, bins: int, by: list[str], stack: str | None = None) -> DataFrame:
    """by, (stack), bin, n over equal bins of each group's readings; bins without a reading are zero."""
    keys = by + ([stack] if stack else [])
    known = rows.where(F.col(value).isNotNull())
    span = known.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    low, high = ends(F.col("_a"), F.col("_b"))
    span = span.select(*by, low.alias("low"), high.alias("high"))
    at = known.join(span, by) if by else known.crossJoin(F.broadcast(span))
    counts = at.groupBy(*keys, bin_of(F.col(value), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = known.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return groups.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram_edges(rows: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """by, bin, n, with bin -1 for the readings outside the given edges; the last bin is closed."""
    v, bin_ = F.col(value), F.lit(-1)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (v >= a) & ((v < b) | ((v == b) if i == len(edges) - 2 else F.lit(False)))
        bin_ = F.when(inside, i).otherwise(bin_)
    return rows.where(v.isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_facts(rows: DataFrame, value: str, by: list[str], low: float, high: float) -> DataFrame:
    """by, n, left_out, mean, median of each group's readings within the bounds; left_out counts those outside, a missing one is neither.

    Groups without a reading within are left out. The median is exact and held by no task as a whole."""
    from chronolith.operators.segments import quantiles

    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    inside = F.col(value).between(low, high)
    sums = known.groupBy(*by).agg(F.count_if(~inside).alias("left_out"), F.avg(F.when(inside, F.col(value))).alias("mean"))
    return quantiles(known.where(inside), value, {"median": 0.5}, tuple(by)).join(sums, by).select(*by, "n", "left_out", "mean", "median")


def peak(hist: DataFrame, by: list[str]) -> DataFrame:
    """by, total, peak: the fullest bin, the lowest of a tie."""
    folded = hist.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return folded.groupBy(*by).agg(F.sum("n").alias("total"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak"))


def density(rows: DataFrame, x: str, y: str, bins: int, by: list[str]) -> DataFrame:
    """by, bx, by_, n: counts over a square grid on the exact range of the rows with both readings; empty cells are left out."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = both.groupBy(*by).agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("a", F.min), ("b", F.max))])
    at = both.join(span, by)
    cell = []
    for c in (x, y):
        pad = F.when(F.col(f"_a{c}") == F.col(f"_b{c}"), 1e-6 * F.abs(F.col(f"_a{c}")) + 1e-9).otherwise(0.0)
        cell.append(bin_of(F.col(c), F.col(f"_a{c}") - pad, F.col(f"_b{c}") + pad, bins))
    return at.groupBy(*by, cell[0].alias("bx"), cell[1].alias("by_")).agg(F.count(F.lit(1)).alias("n"))


def pearson(x: str, y: str) -> Column:
    """Correlation of the rows with both readings; null for under two rows or a constant."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b))


def correlations(rows: DataFrame, x: str, y: str, sets: list[list[str]], few: int = 30, least: int = 2) -> DataFrame:
    """n, r and few for every grouping set of the keys, in one aggregation; keys out of a set are null. Rows without either reading are left out."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r"), F.grouping_id().alias("level"))
    return out.where(F.col("n") >= least).withColumn("few", F.col("n") < few)


def lomb_scargle(samples: DataFrame, periods: DataFrame, value: str, seconds: str, by: list[str]) -> DataFrame:
    """by, period, power: the share of variance that a sine of the period with a floating mean explains, in closed form.

    periods has a row for each period, at most PERIODS; every sample meets every period, and sums are combined before the shuffle."""
    if periods.limit(PERIODS + 1).count() > PERIODS:
        raise ValueError(f"more than {PERIODS} periods")
    both = samples.where(F.col(value).isNotNull()).crossJoin(F.broadcast(periods))
    w = 2 * math.pi * F.col(seconds) / F.col("period")
    c, s, y = F.cos(w), F.sin(w), F.col(value)
    m = both.groupBy(*by, "period").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("c"), F.avg(s).alias("s"), F.avg(y).alias("y"), F.avg(c * c).alias("cc"), F.avg(s * s).alias("ss"), F.avg(c * s).alias("cs"), F.avg(y * c).alias("yc"), F.avg(y * s).alias("ys"), F.var_pop(y).alias("yy"))
    cc, ss, cs = F.col("cc") - F.col("c") ** 2, F.col("ss") - F.col("s") ** 2, F.col("cs") - F.col("c") * F.col("s")
    yc, ys = F.col("yc") - F.col("y") * F.col("c"), F.col("ys") - F.col("y") * F.col("s")
    d = cc * ss - cs * cs
    power = (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (F.col("yy") * d)
    return m.where(F.col("yy") > 0).select(*by, "period", F.when(d > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), power))).alias("power"))


def dominant(spectrum: DataFrame, by: list[str], longest: float) -> DataFrame:
    """by, period, share: the strongest period up to longest, and its share of all power."""
    kept = spectrum.where((F.col("period") <= longest) & F.col("power").isNotNull())
    return kept.groupBy(*by).agg(F.max_by("period", F.struct("power", -F.col("period"))).alias("period"), (F.max("power") / F.sum("power")).alias("share"))


def log_bins(spectrum: DataFrame, by: list[str], bins: int) -> DataFrame:
    """by, bin, power: mean power in equal bins of the logarithm of the period; empty bins are left out."""
    x = F.log10("period")
    span = spectrum.groupBy(*by).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    at = spectrum.join(span, by).withColumn("bin", bin_of(x, F.col("_a"), F.col("_b"), bins))
    return at.groupBy(*by, "bin").agg(F.avg("power").alias("power"))


def welch(samples: DataFrame, step_us: int, segment: int = 0, overlap: float = 0.5, window: str = "hann", value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, period, psd: averaged one-sided density of detrended segments of the evenly gridded, filled series, without the mean.

    A segment is at least 16 cells and at most the series; without one (0) it is the whole series. A task takes a segment at a time. Series of under 4 cells are left out."""
    import numpy as np
    import pandas as pd

    from chronolith.operators.series import fill_linear, uniform_grid

    shapes = {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "rectangular": np.ones}
    if window not in shapes or not 0 <= overlap < 1:
        raise ValueError("unknown window, or an overlap outside 0 to 1")
    step_s, keys = step_us / 1e6, list(by)
    grid = fill_linear(uniform_grid(samples.withColumn("value", F.col(value)), step_us, by), by).select(*keys, "cell", F.col("filled").cast("double").alias("filled"))
    n, size, hop = F.col("_n"), F.col("_size"), F.col("_hop")
    whole = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(F.nanvl("filled", F.lit(None).cast("double"))).alias("_known")).where((n >= 4) & (F.col("_known") == n))
    whole = whole.withColumn("_size", F.least(n, F.lit(max(segment, 16))) if segment > 0 else n)
    whole = whole.withColumn("_hop", F.greatest(F.lit(1), F.bround(size * (1 - overlap)).cast("long")))
    first = F.greatest(F.lit(0), F.ceil((F.col("cell") - size + 1) / hop))
    last = F.least(F.floor((n - size) / hop), F.floor(F.col("cell") / hop))
    parts = grid.join(whole, keys).withColumns({"_a": first, "_b": last}).where("_a <= _b").select(*keys, "cell", "filled", "_hop", F.explode(F.sequence("_a", "_b")).alias("_segment"))

    def densities(frames):
        rest = None
        for part in chain(frames, [None]):
            last = part is None
            part = rest if last else part if rest is None else pd.concat([rest, part], ignore_index=True)
            if part is None or not len(part):
                continue
            starts = np.flatnonzero(part["cell"].to_numpy() == (part["_segment"] * part["_hop"]).to_numpy())  # a segment's first cell
            ends, y, out = np.append(starts[1:], len(part)), part["filled"].to_numpy(float), []
            if not last:
                rest = part.iloc[starts[-1] :].reset_index(drop=True)
                starts, ends = starts[:-1], ends[:-1]
            for i, j in zip(starts, ends):
                m = j - i
                t, shape = np.arange(m) - (m - 1) / 2, shapes[window](m)
                own = y[i:j] - y[i:j].mean()
                psd = np.abs(np.fft.rfft((own - t * (t @ own) / (t @ t)) * shape)) ** 2 * step_s / (shape**2).sum()
                psd[1 : (m + 1) // 2] *= 2
                out.append((psd[1:], 1 / np.fft.rfftfreq(m, step_s)[1:]))
            if out:
                rows = part[keys].iloc[np.repeat(starts, [len(p) for p, _ in out])].reset_index(drop=True)
                yield rows.assign(period=np.concatenate([f for _, f in out]), psd=np.concatenate([p for p, _ in out]))

    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keys)
    parts = parts.repartition(*keys, "_segment").sortWithinPartitions(*keys, "_segment", "cell")
    return parts.mapInPandas(densities, f"{kinds}, period double, psd double").groupBy(*keys, "period").agg(F.avg("psd").alias("psd"))


def average_spectra(spectrum: DataFrame, by: list[str], group: Column, points: int = 40, value: str = "psd") -> DataFrame:
    """grp, point, period, value, n: spectra averaged on a shared logarithmic grid, each only within its own span, on the line between its neighbours there. A grid point
    within a billionth of a period is that period."""
    span = spectrum.agg(F.min(F.log("period")).alias("a"), F.max(F.log("period")).alias("b"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "a", "b").select("point", F.exp(F.col("a") + (F.col("b") - F.col("a")) * F.col("point") / (points - 1)).alias("p"))
    w = Window.partitionBy(*by).orderBy("period")
    steps = spectrum.withColumn("grp", group).withColumns({"p1": F.lead("period").over(w), "v1": F.lead(value).over(w)})
    at = steps.join(F.broadcast(grid), (F.col("p") >= F.col("period") * (1 - 1e-9)) & (F.col("p") < F.coalesce(F.col("p1") * (1 - 1e-9), F.col("period") * (1 + 1e-9))))
    line = F.coalesce(F.col(value) + (F.col("v1") - F.col(value)) * (F.col("p") - F.col("period")) / (F.col("p1") - F.col("period")), F.col(value))
    return at.groupBy("grp", "point").agg(F.first("p").alias("period"), F.avg(line).alias("value"), F.count(F.lit(1)).alias("n"))


def cloud(samples: DataFrame, budget: int, n_series: int, by: tuple[str, ...] = ("series",), least: int = 50) -> DataFrame:
    """The evenly thinned samples with genuine (judged before thinning), period and seconds since the first sample."""
    from chronolith.functions.labels import period_code
    from chronolith.operators.series import even_stride, sample_kinds

    rows = sample_kinds(samples, by=by).withColumn("genuine", F.col("kind") == 0)
    rows = rows.withColumns({"seconds": (F.col("us") - F.min("us").over(Window.partitionBy(*by))) / 1e6, "period": period_code(F.col("label"))})
    return even_stride(rows, budget, n_series, by, least)

