"""Scans in ranges against windows over whole series, and quantiles against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.operators import intervals as I
from chronolith.operators import segments as G
from chronolith.operators import series as S
from chronolith.operators import windows as W


@pytest.fixture(scope="module")
def samples(spark):
    """One series of 20,000 rows beside 40 short ones; held, missing and interpolated readings, ties in time, labels that come and go."""
    rng = np.random.default_rng(7)
    parts = []
    for s in range(41):
        n = 20_000 if s == 3 else int(rng.integers(1, 30))
        value = np.round(np.cumsum(rng.integers(-1, 2, n)).astype(float), 0)
        parts.append(pd.DataFrame({"series": s, "us": np.cumsum(rng.integers(0, 3, n)) * 1_000_000, "rid": np.arange(n), "value": np.where(rng.random(n) < 0.1, np.nan, value), "label": np.repeat(rng.integers(-1, 3, n // 5 + 1), 5)[:n], "keep": rng.random(n) < 0.97}))
    x = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))
    return x.withColumns({"value": F.nanvl("value", F.lit(None)), "label": F.when(F.col("label") >= 0, F.col("label"))}).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scans_equal_windows(samples):
    assert rows(G.runs(samples, parts=7)) == rows(I.runs(samples))
    cols = ("series", "rid", "kind")
    assert rows(G.sample_kinds(samples, parts=7).select(*cols)) == rows(S.sample_kinds(samples).select(*cols))
    cols = ("series", "rid", "window", "at")
    assert rows(G.cut(samples, 4, "keep", parts=7).select(*cols)) == rows(W.cut(samples, 4, "keep").select(*cols))
    assert rows(G.cut(samples, 3, parts=5).select(*cols)) == rows(W.cut(samples, 3).select(*cols))
    gap = samples.withColumn("gap", F.col("us") - F.lag("us").over(S.ordered("series"))).select("series", "us", "rid", "gap")
    assert rows(G.gaps(samples, parts=7)) == rows(gap)


def test_no_segment_holds_the_long_series(samples):
    sizes = [r["count"] for r in G.dealt(samples, parts=8).groupBy("series", G.SEGMENT).count().collect()]
    assert max(sizes) < 6_000 and sum(sizes) == samples.count() and len(sizes) <= 41 + 8


def test_quantiles_are_exact(spark, samples):
    shares = {"low": 0.05, "mid": 0.5, "top": 0.95, "least": 0.0, "most": 1.0}
    got = {r.series: r for r in G.quantiles(samples, "value", shares, parts=6).collect()}
    frame = samples.select("series", "value").toPandas()
    for s, own in frame.groupby("series"):
        v = own["value"].dropna().to_numpy()
        assert got[s].n == len(v)
        for name, p in shares.items():
            if len(v):
                assert got[s][name] == pytest.approx(np.quantile(v, p), abs=1e-12)
            else:
                assert got[s][name] is None
    one = spark.range(50_000).select(F.lit(1).alias("series"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.1).alias("value"))
    assert G.quantiles(one, "value", {"q": 0.3}, parts=6).first().q == pytest.approx(np.quantile(one.toPandas()["value"], 0.3))


def test_empty_null_and_extra(spark):
    none = spark.createDataFrame([], "series long, us long, rid long, value double, label int")
    assert G.runs(none).count() == G.sample_kinds(none).count() == G.cut(none, 3).count() == G.quantiles(none, "value", {"q": 0.5}).count() == 0
    some = spark.createDataFrame([(None, 1, 1, 1.0, 1, {"a": 1}), (1, 1, 1, None, None, {"a": 1}), (1, 2, 2, 3.0, None, None)], "series long, us long, rid long, value double, label int, prev map<string,int>")
    assert [(r.n, r.value) for r in G.runs(some).collect()] == [(2, None)]
    assert G.quantiles(some, "value", {"q": 0.5}).collect() == [(1, 1, 3.0)]
    with pytest.raises(ValueError):
        G.cut(some, 0)
    with pytest.raises(ValueError):
        G.quantiles(some, "value", {"q": 1.5})
