"""What a task holds or does does not grow with the input: charts by few groups, spectra of many short series, studies of many wells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import outputs as G
from chronolith.operators import profiles as Q
from chronolith.operators import series as S
from chronolith.operators import spectra as P
from chronolith.operators import windows as W


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chart_limits_without_a_group_in_a_task(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(2400, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]])
    rows = spark.createDataFrame([(int(i % 2), *map(float, x)) for i, x in enumerate(data)], "grp long, x double, y double, z double")
    model = G.fit_chart(rows, ["x", "y", "z"], "grp", least=600)
    own = G.scored(rows, model, ["x", "y", "z"])
    told = {r.grp: r for r in model.collect()}
    for g in (0, 1):
        found = np.array([(r.t2, r.q) for r in own.where(F.col("grp") == g).collect()])
        assert (told[g].t2_limit, told[g].q_limit) == pytest.approx(tuple(np.quantile(found, 0.99, axis=0)), rel=1e-9)
    assert "percentile(" not in plan(model)
    out = G.chart_labels(rows, model, ["x", "y", "z"])
    out.count()
    # a small written model meets the rows where they are
    assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" in plan(out)


def test_spectra_of_short_series_are_made_once_and_equal_those_by_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, int(t * 1e6), float(np.sin(t / (5 + s)) + rng.normal() / 9)) for s in range(70) for t in np.sort(rng.uniform(0, 500, 7 + s))]
    rows += [(99, i * 1_000_000, 4.0) for i in range(20)] + [(98, i * 1_000_000, None) for i in range(20)]
    x = spark.createDataFrame(rows, "series long, us long, value double")
    bands = P.log_bands(P.periodogram(x, n_periods=50), ["series"])
    assert plan(bands).split("== Physical Plan ==")[1].count("FlatMapGroupsInPandas") == 1  # of series beyond PART alone
    key = lambda df: {(r.series, r.k): (r.period, r.explained, r.density, r.span_s) for r in df.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        short = key(P.periodogram(x, n_periods=50))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(P, "PART", 6)
    long = key(P.periodogram(x, n_periods=50))
    assert {s for s, _ in short} == {*range(1, 70), 99} and len(short) == 70 * 50
    assert short.keys() == long.keys() and all(short[k] == pytest.approx(long[k], rel=1e-6, abs=1e-9) for k in short)


def test_study_is_dealt_by_its_samples(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(well, t, t, int(t // 40 % 2), float(rng.normal() + well * (t // 40 % 2))) for well in range(30) for t in range(800)]
    x = spark.createDataFrame(rows, "series long, us long, rid long, label int, value double")
    key = lambda df: {(r.series, r.size, r.stat): (r.n_event, r.n_normal, round(r.separation, 9)) for r in df.collect()}
    whole = key(W.separation_study(x, (8, 16)))
    assert len(whole) == 30 * 2 * 12
    monkeypatch.setattr(W, "SAMPLES", 1000, raising=False)
    dealt = W.separation_study(x, (8, 16))
    assert "RepartitionByExpression [series" in plan(dealt) and ", 24" in plan(dealt)
    assert key(dealt) == whole


def test_channels_of_a_unit_are_sorted_once(spark):
    rng = np.random.default_rng(7)
    pick = lambda: None if rng.random() < 0.2 else float(rng.integers(0, 4))
    rows = [(f"u{u}", int(t) * 1_000_000, t, pick(), float(t) if t % 9 else 1e6, pick()) for u in range(12) for t in range(u, 40, 1 + u % 3)]
    wide = spark.createDataFrame(rows, "unit string, us long, rid long, a double, b double, c double")
    channels = (("a", 0.0, 2.5, False), ("b", 0.0, 100.0, False), ("c", 0.0, 5.0, True), ("gone", 0.0, 1.0, False))
    got = Q.profiles(wide, channels, described=False)
    told = {(r.unit, r.channel): (r.n_total, r.n_valid, r.n_genuine, r.n_interpolated, r.n_held, r.spacing_s) for r in got.collect()}
    assert len(told) == 12 * 4 and all(told[f"u{u}", "gone"][1:] == (0, 0, 0, 0, None) for u in range(12))
    for name, low, high, _ in channels[:2]:
        own = wide.select("unit", "us", "rid", F.when(F.col(name).between(low, high), F.col(name)).alias("v"))
        for r in S.sampling_summary(S.sample_kinds(own, "v", ("unit",)), S.sampling_step(own, ("unit",)), ("unit",)).collect():
            assert told[r.unit, name][1:] == (r.n_valid, r.n_genuine, r.n_interpolated, r.n_held, r.spacing_s)
    fresh = plan(Q.profiles(wide, channels, described=False)).split("== Physical Plan ==")[1]
    assert fresh.count("Sort [unit") == 1
