"""Operators on ordered series: frames with series, us (micros), rid (tie-break), value."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("us", "rid")
MISSING, GENUINE, INTERPOLATED, HELD = -1, 0, 1, 2


def ordered(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(*ORDER)


def sampling_step(samples: DataFrame, by: tuple[str, ...] = ("series",), default_us: int = 1_000_000) -> DataFrame:
    """by, step_us: the median positive gap of the times."""
    gaps = samples.withColumn("gap", F.col("us") - F.lag("us").over(ordered(*by)))
    step = F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5)
    return gaps.groupBy(*by).agg(F.coalesce(step, F.lit(float(default_us))).alias("step_us"))


def kind_of(v: Column, step: Column, ahead: Column, n: Column, most: Column, tolerance: float = 1e-6) -> Column:
    """The kind of a reading from its steps from the one before and to the next, and the number and largest size of its series' readings."""
    tol = tolerance * F.greatest(most, F.lit(1e-12))
    flat = lambda d: F.coalesce(F.abs(d) <= tol, F.lit(False))
    straight = F.coalesce(F.abs(ahead - step) <= tol, F.lit(False))
    return F.when(v.isNull(), MISSING).when(n < 2, GENUINE).when(flat(step), HELD).when(straight & ~flat(ahead), INTERPOLATED).otherwise(GENUINE)


def sample_kinds(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), tolerance: float = 1e-6) -> DataFrame:
    """samples with kind: -1 missing, 0 genuine, 1 interpolated (on a sloped straight line through both neighbours), 2 held (equal to the one before)."""
    w, whole = ordered(*by), Window.partitionBy(*by)
    v = F.col(value)
    rows = samples.withColumns({"_d": v - F.lag(v).over(w), "_most": F.max(F.abs(v)).over(whole), "_n": F.count(v).over(whole)})
    rows = rows.withColumn("_next", F.lead("_d").over(w))
    kind = kind_of(v, F.col("_d"), F.col("_next"), F.col("_n"), F.col("_most"), tolerance)
    return rows.withColumn("kind", kind.cast("int")).drop("_d", "_most", "_n", "_next")


def sampling_summary(kinds: DataFrame, step: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Counts of the kinds, spacing_s between measurements, and shares, per series."""
    rows = kinds.withColumn("_at", F.row_number().over(ordered(*by)))
    count = lambda k: F.count_if(F.col("kind") == k)
    genuine = F.when(F.col("kind") == GENUINE, F.col("_at"))
    out = rows.groupBy(*by).agg(F.count_if(F.col("kind") != MISSING).alias("n_valid"), count(GENUINE).alias("n_genuine"), count(INTERPOLATED).alias("n_interpolated"), count(HELD).alias("n_held"), (F.max(genuine) - F.min(genuine)).alias("_span"))
    out = out.join(step, list(by))
    share = lambda x: F.when(F.col("n_valid") > 0, x / F.col("n_valid")).otherwise(0.0)
    spacing = F.when(F.col("n_genuine") > 1, F.col("_span") * F.col("step_us") / 1e6 / (F.col("n_genuine") - 1))
    filled = F.col("n_interpolated") + F.col("n_held")
    return out.select(*by, "n_valid", "n_genuine", "n_interpolated", "n_held", spacing.alias("spacing_s"), share(F.col("n_genuine")).alias("genuine_share"), share(filled).alias("filled_share"), filled.alias("n_filled"))


def uniform_grid(samples: DataFrame, step_us: int, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, cell, value on a grid of step_us from the first sample: of samples in one cell the last, null in holes."""
    first = samples.groupBy(*by).agg(F.min("us").alias("_from"), F.max("us").alias("_to"))
    cells = first.select(*by, "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_to") - F.col("_from")) / step_us))).alias("cell"))
    at = samples.join(first.select(*by, "_from"), list(by)).withColumn("cell", F.floor((F.col("us") - F.col("_from")) / step_us))
    value = at.groupBy(*by, "cell").agg(F.max_by("value", F.struct(*ORDER)).alias("value"))
    return cells.drop("_from").join(value, [*by, "cell"], "left")


def fill_linear(grid: DataFrame, by: tuple[str, ...] = ("series",), at: str = "cell") -> DataFrame:
    """grid with filled: gaps inside on the line between their neighbours, gaps at the ends as the nearest reading."""
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(at).alias("x"), F.col("value").alias("y")))
    before = F.last(known, True).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(Window.partitionBy(*by).orderBy(at).rowsBetween(0, Window.unboundedFollowing))
    rows = grid.withColumns({"_a": before, "_b": after})
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(at) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    filled = F.coalesce(F.col("value"), line, F.col("_a.y"), F.col("_b.y"))
    return rows.withColumn("filled", filled).drop("_a", "_b")


def detrend(rows: DataFrame, value: str, at: str, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """rows with rest: value less the least-squares line over `at`; of a single row, less its value."""
    w = Window.partitionBy(*by)
    both = rows.withColumns({"_mx": F.avg(at).over(w), "_my": F.avg(value).over(w)})
    dx, dy = F.col(at) - F.col("_mx"), F.col(value) - F.col("_my")
    both = both.withColumns({"_sxy": F.sum(dx * dy).over(w), "_sxx": F.sum(dx * dx).over(w)})
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(0.0)
    return both.withColumn("rest", dy - slope * dx).drop("_mx", "_my", "_sxy", "_sxx")


def prepared(samples: DataFrame, least: int = 16, coverage: float = 0.5, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, n, n_valid, ok for the series fit for a spectrum: enough rows, enough readings, enough coverage, and not flat."""
    from chronolith.functions.labels import is_flat

    out = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    ok = (F.col("n") >= least) & (F.col("n_valid") >= least) & (F.col("n_valid") >= coverage * F.col("n")) & ~F.coalesce(is_flat(F.col("_low"), F.col("_high")), F.lit(True))
    return out.select(*by, "n", "n_valid", ok.alias("ok"))


def fill_edges(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """samples with filled: the last reading before, else the first after."""
    w = ordered(*by)
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return samples.withColumn("filled", F.coalesce(back, ahead))


def even_stride(samples: DataFrame, budget: int, n_series: int, by: tuple[str, ...] = ("series",), least: int = 50) -> DataFrame:
    """Every k-th row of a series, k so that about budget rows stay over n_series series, at least `least` each."""
    each = max(budget // max(n_series, 1), least)
    rows = samples.withColumns({"_at": F.row_number().over(ordered(*by)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return rows.where(F.col("_at") % F.ceil(F.col("_n") / each) == 0).drop("_at", "_n")


def signal_to_noise(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, snr: variance over half the mean squared first difference of the readings; infinite without differences, null under three readings."""
    rows = samples.where(F.col(value).isNotNull())
    rows = rows.withColumn("_d", F.col(value) - F.lag(value).over(ordered(*by)))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.var_pop(value).alias("_v"), (F.avg(F.col("_d") * F.col("_d")) / 2).alias("_e"))
    snr = F.when(F.col("_n") < 3, None).when(F.col("_e") > 0, F.col("_v") / F.col("_e")).when(F.col("_v") > 0, float("inf"))
    return out.select(*by, snr.alias("snr"))


def z_score(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """samples with z: distance from the series' mean in population deviations; 0 for readings of a flat series."""
    w = Window.partitionBy(*by)
    v = F.col(value)
    spread = F.stddev_pop(v).over(w)
    z = F.when(v.isNull(), None).when(F.max(v).over(w) == F.min(v).over(w), 0.0).otherwise((v - F.avg(v).over(w)) / spread)
    return samples.withColumn("z", z)


def decimate(samples: DataFrame, blocks: int = 400, least: int = 32, value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """by, block, z: means of the readings in min(blocks, n) blocks of rows, empty ones on the line between neighbours, scored by series.

    Block edges are the whole parts of an even division of the rows. Series of under `least` readings, and flat ones, are left out."""
    w = Window.partitionBy(*by)
    rows = samples.withColumns({"_i": F.row_number().over(ordered(*by)) - 1, "_n": F.count(F.lit(1)).over(w), "_r": F.count(value).over(w), "_low": F.min(value).over(w), "_high": F.max(value).over(w)})
    rows = rows.where((F.col("_r") >= least) & (F.col("_low") < F.col("_high")))
    k = F.least(F.lit(blocks), F.col("_n"))
    # the last block whose first row, floor(b n / k), is not after the row
    block = F.floor(((F.col("_i") + 1) * k - 1) / F.col("_n"))
    means = rows.groupBy(*by, block.alias("block")).agg(F.avg(value).alias("value"))
    filled = fill_linear(means, by, "block")
    return z_score(filled.drop("value").withColumnRenamed("filled", "value"), "value", by).select(*by, "block", "z")


def moments(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), least: int = 8) -> DataFrame:
    """n, mean, std (population), skew, kurtosis (excess), quantiles and extremes of each series' readings.

    A flat series has its value as mean and no deviation; flat series and those of under `least` readings have no skew nor kurtosis."""
    v = F.col(value)
    out = samples.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"), F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"), F.percentile(v, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("_q"), F.min(v).alias("low"), F.max(v).alias("high"))
    flat = F.col("low") == F.col("high")
    told = ~flat & (F.col("n") >= least)
    return out.select(
        *by, "n", F.when(flat, F.col("low")).otherwise(F.col("_mean")).alias("mean"), F.when(flat, 0.0).otherwise(F.col("_std")).alias("std"),
        F.when(told, F.col("_skew")).alias("skew"), F.when(told, F.col("_kurt")).alias("kurtosis"),
        *[F.col("_q")[i].alias(n) for i, n in enumerate(("q05", "q25", "median", "q75", "q95"))], "low", "high",
    )


def gaussianity(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), least: int = 8, most: int = 50_000) -> DataFrame:
    """slope, offset, scatter, gaussian: the regression of chi-squared quantiles on the sorted squared distances from the mean.

    Longer series are thinned to at most `most` readings by an even stride. Flat and short series are left out."""
    from chronolith.functions.labels import chi2_1_quantile

    w = Window.partitionBy(*by)
    rows = samples.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(ordered(*by)) - 1, "_all": F.count(F.lit(1)).over(w)})
    rows = rows.where(F.col("_i") % F.ceil(F.col("_all") / most) == 0)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_m": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w), "_low": F.min(value).over(w), "_high": F.max(value).over(w)})
    rows = rows.where((F.col("_n") >= least) & (F.col("_low") < F.col("_high")))
    d = ((F.col(value) - F.col("_m")) / F.col("_s")) ** 2
    rows = rows.withColumn("d", d).withColumn("_rank", F.row_number().over(w.orderBy("d")))
    f = chi2_1_quantile((F.col("_rank") - 0.5) / F.col("_n")) * (F.col("_n") + 1) / F.col("_n")
    fit = rows.withColumn("f", f).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.regr_slope("f", "d").alias("slope"), F.regr_intercept("f", "d").alias("_a"), F.avg("f").alias("_f"), F.regr_syy("f", "d").alias("_syy"), F.regr_sxy("f", "d").alias("_sxy"), F.regr_sxx("f", "d").alias("_sxx"))
    rest = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
    scatter = F.sqrt(rest / F.greatest(F.col("_n") - 2, F.lit(1))) / F.col("_f")
    out = fit.where(F.col("_sxx") > 0).withColumns({"offset": F.col("_a") / F.col("_f"), "scatter": scatter})
    gaussian = (F.col("scatter") < 0.15) & (F.abs("offset") <= 0.05) & (F.abs(F.col("slope") - 1) <= 0.2)
    return out.select(*by, "slope", "offset", "scatter", gaussian.alias("gaussian"))


def autocorrelation(samples: DataFrame, step: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), longest_s: float = 21_600.0, block: int = 65_536) -> DataFrame:
    """by, lag, rho, step_us: the biased autocorrelation of each series' readings from lag 0, up to longest_s and the series' length.

    A task takes `block` readings and as many of the next ones as there are lags, never a whole series; the blocks' products are summed by lag. Flat series have no rows."""
    import numpy as np
    import pandas as pd

    keys = list(by)
    reading = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = samples.select(*keys, *ORDER, reading.alias("_v")).where(F.col("_v").isNotNull())
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where(F.col("_low") < F.col("_high"))
    lags = F.least(F.greatest(F.lit(1), F.floor(longest_s * 1e6 / F.col("step_us"))), F.col("_n") - 1)
    whole = whole.join(step, keys).select(*keys, "_m", "step_us", lags.cast("long").alias("_lags"))
    rows = rows.withColumn("_at", F.row_number().over(ordered(*by)) - 1).join(whole, keys)
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - F.col("_lags")) / block)), F.floor(F.col("_at") / block))
    rows = rows.select(*keys, "step_us", "_lags", "_at", (F.col("_v") - F.col("_m")).alias("_v"), F.explode(blocks).alias("_block"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in chain(frames, [None]):
            last = part is None
            part = rest if last else part if rest is None else pd.concat([rest, part], ignore_index=True)
            if part is None or not len(part):
                continue
            at, y, k = part["_at"].to_numpy(), part["_v"].to_numpy(float), part["_lags"].to_numpy()
            first = part["_block"].to_numpy() * block
            starts = np.flatnonzero(at == first)  # a block's rows begin at its first place
            ends = np.append(starts[1:], len(part))
            if not last:
                rest = part.iloc[starts[-1] :].reset_index(drop=True)
                starts, ends = starts[:-1], ends[:-1]
            found = []
            for i, j in zip(starts, ends):
                own = y[i:j]
                head = own[: np.searchsorted(at[i:j], first[i] + block)]
                size = 1 << int(len(own) + len(head) - 1).bit_length()
                found.append(np.fft.irfft(np.conj(np.fft.rfft(head, size)) * np.fft.rfft(own, size), size)[: min(int(k[i]) + 1, len(own))])
            if found:
                n = np.array([len(s) for s in found])
                out = part[[*keys, "step_us"]].iloc[np.repeat(starts, n)].reset_index(drop=True)
                yield out.assign(lag=np.concatenate([np.arange(m) for m in n]), s=np.concatenate(found))

    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keys)
    rows = rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_at")
    sums = rows.mapInPandas(products, f"{kinds}, step_us double, lag long, s double").groupBy(*keys, "step_us", "lag").agg(F.sum("s").alias("s"))
    return sums.select(*keys, "lag", (F.col("s") / F.first("s").over(Window.partitionBy(*keys).orderBy("lag"))).alias("rho"), "step_us")


def autocorrelation_half(samples: DataFrame, step: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), longest_s: float = 21_600.0) -> DataFrame:
    """by, acf_half_s: the first lag at which the autocorrelation is 0.5 or less, on the line between lags; infinite if none
    within longest_s, null for flat and short series."""
    rho = autocorrelation(samples, step, value, by, longest_s).withColumn("_before", F.lag("rho").over(Window.partitionBy(*by).orderBy("lag")))
    low = F.when((F.col("lag") > 0) & (F.col("rho") <= 0.5), F.struct("lag", "_before", "rho"))
    found = rho.groupBy(*by).agg(F.min(low).alias("_k"), F.first("step_us").alias("_step"))
    at = F.col("_k.lag") - 1 + (F.col("_k._before") - 0.5) / (F.col("_k._before") - F.col("_k.rho"))
    found = found.select(*by, F.coalesce(at * F.col("_step") / 1e6, F.lit(float("inf"))).alias("acf_half_s"))
    return step.select(*by).join(found, list(by), "left")


def descriptors(samples: DataFrame, step: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """moments, snr, acf_half_s and the test of normality (slope, offset, scatter, gaussian) of each series' readings."""
    out = moments(samples, value, by)
    for part in (signal_to_noise(samples, value, by), autocorrelation_half(samples, step, value, by), gaussianity(samples, value, by)):
        out = out.join(part, list(by), "left")
    return out


def profile(samples: DataFrame, low: float, high: float, value: str = "value", by: tuple[str, ...] = ("series",), mask: bool = True) -> DataFrame:
    """One row for each series: readings outside the plausible range masked and counted, kinds, sampling, descriptors on all samples
    and (g_ columns) on the genuine ones, whose step is the spacing of the measurements."""
    from chronolith.functions.labels import plausible

    v = F.col(value)
    rows = samples.withColumn("_v", plausible(v, F.lit(low), F.lit(high)) if mask else v)
    odd = rows.groupBy(*by).agg(F.count_if(v.isNotNull() & F.col("_v").isNull()).alias("n_implausible"))
    kinds = sample_kinds(rows, "_v", by)
    step = sampling_step(samples, by)
    summary = sampling_summary(kinds, step, by)
    spacing = summary.where(F.col("spacing_s") > 0).select(*by, (F.col("spacing_s") * 1e6).alias("step_us"))
    genuine = descriptors(kinds.where(F.col("kind") == GENUINE), spacing, "_v", by)
    genuine = genuine.select(*by, *[F.col(c).alias(f"g_{c}") for c in genuine.columns if c not in by])
    return odd.join(summary, list(by)).join(descriptors(kinds, step, "_v", by), list(by), "left").join(genuine, list(by), "left")
