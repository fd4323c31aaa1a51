"""Descriptors of many short series at once: readings of one series after the other, worked out by NumPy over all of a batch's series.

The same measures as `series.descriptors`, for series that a task may hold; NaN is a measure that a series does not have."""

from __future__ import annotations

import numpy as np

from chronolith.functions.labels import MIDDLE, TAIL

QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """`labels.normal_quantile` of numbers between 0 and 1."""
    q = p - 0.5
    tail = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    outer = np.polyval(TAIL[0], tail) / np.polyval(TAIL[1], tail)
    inner = np.polyval(MIDDLE[0], q * q) * q / np.polyval(MIDDLE[1], q * q)
    return np.where(p < 0.02425, outer, np.where(p > 1 - 0.02425, -outer, inner))


def quantile(ranked: np.ndarray, starts: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """A quantile of each series' readings, which stand in order, on the line between its neighbours."""
    place = (n - 1) * share
    below = np.floor(place).astype(np.int64)
    above = np.ceil(place).astype(np.int64)
    a, b = ranked[starts + below], ranked[starts + above]
    return np.where(a == b, a, (above - place) * a + (place - below) * b)


def half_lag(y: np.ndarray, of: np.ndarray, square: np.ndarray, lags: np.ndarray, varies: np.ndarray) -> np.ndarray:
    """The first lag, up to each series' own last, at which its autocorrelation is 0.5 or less, on the line between lags; inf where there is none, NaN for
    a flat series. y: distances from the mean, of: whose they are, square: their squares' sums."""
    half, before, k = np.where(varies, np.inf, np.nan), np.ones(len(lags)), 0
    going = varies & (lags > 0)
    while going.any():
        k += 1
        stays = going[of]
        y, of = y[stays], of[stays]
        near = of[k:] == of[:-k]
        rho = np.bincount(of[k:][near], weights=(y[k:] * y[:-k])[near], minlength=len(lags))[: len(lags)] / np.where(varies, square, 1.0)
        hit = going & (rho <= 0.5)
        half[hit] = k - 1 + (before[hit] - 0.5) / (before[hit] - rho[hit])
        before, going = rho, going & ~hit & (lags > k)
    return half


def measures(v: np.ndarray, n: np.ndarray, step_us: np.ndarray, longest_s: float = 21_600.0, least: int = 8) -> dict[str, np.ndarray]:
    """The measures of series of n readings each (one at least), v being all of them in order of series and time."""
    starts, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    total = lambda x: np.add.reduceat(x, starts)
    low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    varies, mean = low < high, total(v) / n
    y = v - mean[of]
    square = total(y * y)
    variance = square / n
    std = np.sqrt(variance)
    told = varies & (n >= least)
    ranked = v[np.lexsort((v, of))]
    out = {c: quantile(ranked, starts, n, share) for c, share in QUANTILES.items()}
    with np.errstate(divide="ignore", invalid="ignore"):
        out |= {"mean": np.where(varies, mean, low), "std": np.where(varies, std, 0.0), "low": low, "high": high}
        out |= {"skew": np.where(told, total(y**3) / n / variance**1.5, np.nan), "kurtosis": np.where(told, total(y**4) / n / variance**2 - 3, np.nan)}
        steps = np.zeros(len(v))
        steps[1:] = np.diff(v) ** 2
        steps[starts] = 0.0
        noise = total(steps) / np.maximum(n - 1, 1) / 2
        out["snr"] = np.where(n < 3, np.nan, np.where(noise > 0, variance / noise, np.where(variance > 0, np.inf, np.nan)))
        lags = np.minimum(np.maximum(1, np.floor(longest_s * 1e6 / step_us)), n - 1)
        out["acf_half_s"] = half_lag(y, of, square, lags, varies) * step_us / 1e6
        # the regression of chi-squared quantiles on the sorted squared distances from the mean
        d = (y / std[of]) ** 2
        d = np.where(told[of], d, 0.0)
        d = d[np.lexsort((d, of))]
        p = (np.arange(len(v)) - starts[of] + 0.5) / n[of]
        f = normal_quantile((1 + p) / 2) ** 2 * ((n + 1) / n)[of]
        md, mf = total(d) / n, total(f) / n
        d, f = d - md[of], f - mf[of]
        sxx, sxy, syy = total(d * d), total(d * f), total(f * f)
        fits = told & (sxx > 0)
        slope = np.where(fits, sxy / sxx, np.nan)
        offset = (mf - slope * md) / mf
        scatter = np.sqrt(np.maximum(0.0, syy - np.where(fits, sxy, np.nan) * sxy / sxx) / np.maximum(n - 2, 1)) / mf
        gaussian = np.where(fits, (scatter < 0.15) & (np.abs(offset) <= 0.05) & (np.abs(slope - 1) <= 0.2), np.nan)
    return out | {"slope": slope, "offset": offset, "scatter": scatter, "gaussian": gaussian}


def of_each(v: np.ndarray, kept: np.ndarray, of: np.ndarray, step_us: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The measures of each series' kept rows, of being the rows' series; NaN for a series without one."""
    n = np.bincount(of[kept], minlength=len(step_us))
    out = {c: np.full(len(n), np.nan) for c in names}
    some = n > 0
    if some.any():
        found = measures(v[kept], n[some], step_us[some])
        for c in names:
            out[c][some] = found[c]
    return out
