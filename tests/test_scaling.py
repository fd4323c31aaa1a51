"""Classical scaling, warping and periodograms against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import maps as M
from chronolith.operators import scaling
from chronolith.operators import spectra as P


def test_scaling_by_eigenvectors(spark):
    """Groups of several sizes, one of them of distances that no space has."""
    rng, rows, want = np.random.default_rng(1), [], {}
    for g, n, noise in (("a", 25, 0), ("b", 12, 0.4), ("c", 3, 0), ("d", 2, 0)):
        p = rng.normal(size=(n, 3)) * [5, 2, 1]
        d = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2)) + np.triu(np.abs(rng.normal(size=(n, n))) * noise, 1)
        d = np.triu(d, 1) + np.triu(d, 1).T
        rows += [(g, i, j, float(d[i, j])) if (i + j) % 2 else (g, j, i, float(d[i, j])) for i in range(n) for j in range(i)]
        centre = np.eye(n) - 1 / n
        b = -0.5 * centre @ d**2 @ centre
        values, vectors = np.linalg.eigh(b)
        order = np.argsort(-values)[:2]
        want[g] = vectors[:, order] * np.sqrt(np.maximum(values[order], 0)), np.maximum(values[order], 0) / np.trace(b)
    out = scaling.classical(spark.createDataFrame(rows, "grp string, a int, b int, d double"), 2, "grp").toPandas()
    for g, (coordinates, shares) in want.items():
        own = out[out.grp == g].sort_values("id")
        for j in range(2):
            c = coordinates[:, j]
            assert np.allclose(own[f"c{j + 1}"], c * np.sign(c[np.abs(c).argmax()]) if shares[j] > 1e-9 else 0, atol=1e-4), (g, j)
            assert np.allclose(own[f"e{j + 1}"], shares[j], atol=1e-6)


def test_a_table_with_a_hole_is_an_error(spark):
    with pytest.raises(ValueError):
        scaling.classical(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a int, b int, d double"))
    assert scaling.classical(spark.createDataFrame([], "a int, b int, d double")).count() == 0


def warped(a, b, w):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= w:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return np.sqrt(d[-1, -1])


def test_warping_by_cells(spark):
    rng = np.random.default_rng(2)
    series = {i: (i % 3, rng.normal(size=rng.integers(1, 30)).tolist()) for i in range(24)}
    df = spark.createDataFrame([(c, i, z) for i, (c, z) in series.items()], "cls int, id int, z array<double>")
    got = {(r.a, r.b): r.d for r in M.warped(df).collect()}
    longest = {c: max(len(z) for k, z in series.values() if k == c) for c in range(3)}
    want = {(a, b): warped(series[a][1], series[b][1], max(1, round(0.1 * longest[series[a][0]]))) for a in series for b in series if a < b and series[a][0] == series[b][0]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sum(map(np.isinf, want.values())) > 5 and M.warped(df.limit(0)).count() == 0


def test_periodogram_of_parts(spark, monkeypatch):
    """A series dealt over many tasks has the spectrum of one, and its density sums to the variance."""
    rng, rows = np.random.default_rng(3), []
    for s, n, period in ((1, 300, 50.0), (2, 90, 700.0), (3, 5, 9.0), (4, 40, None)):
        t = np.sort(rng.uniform(0, 4000, n))
        y = 3 + np.sin(2 * np.pi * t / period) + rng.normal(0, 0.1, n) if period else np.full(n, 7.0)
        rows += [(s, int(a * 1e6), float(b)) for a, b in zip(t, y)] + [(s, 1, None)]
    df = spark.createDataFrame(rows, "series int, us long, value double")
    whole = P.periodogram(df).orderBy("series", "k").toPandas()
    monkeypatch.setattr(P, "PART", 16)
    parts = P.periodogram(df).orderBy("series", "k").toPandas()
    assert len(whole) == 3 * P.PERIODS and np.allclose(whole.explained, parts.explained, atol=1e-9)
    for s, period in ((1, 50.0), (2, 700.0)):
        own = whole[whole.series == s]
        t, y = (np.array([r[i] for r in rows if r[0] == s and r[2] is not None], float) for i in (1, 2))
        for k in (0, 57, 399):
            x = 2 * np.pi / own.period.iloc[k] * (t - t[0]) / 1e6
            a = np.stack([np.cos(x), np.sin(x), np.ones(len(x))], axis=1)
            left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
            assert own.explained.iloc[k] == pytest.approx(1 - (left**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)
        f = 1 / own.period.to_numpy()
        v = own.density.to_numpy()
        assert (0.5 * (v[1:] + v[:-1]) * (f[:-1] - f[1:])).sum() == pytest.approx(y.var())
    best = {r.series: r for r in P.dominant_period(P.periodogram(df), ["series"]).collect()}
    assert best[1].period == pytest.approx(50, rel=0.02) and best[2].period == pytest.approx(700, rel=0.05) and best[4].period is None and best[4].explained == 0
    bands = P.log_bands(P.periodogram(df), ["series"]).toPandas()
    assert bands.bin.between(0, 159).all() and len(bands[bands.series == 1]) == 160
    assert P.periodogram(df.where(F.lit(False))).count() == 0
