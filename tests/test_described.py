"""Profiles along sorted rows equal those by a sort for each descriptor, and need no shuffle but that of the units' rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions.labels import chi2_1_quantile
from chronolith.operators import described as D
from chronolith.operators import profiles as P

CHANNELS = (("a", 0.0, 2.5, False), ("b", -9.0, 100.0, False), ("c", 0.0, 5.0, True), ("gone", 0.0, 1.0, False))


def wide(spark):
    rng = np.random.default_rng(11)
    pick = lambda: None if rng.random() < 0.2 else float(rng.integers(0, 4))
    rows = [(f"u{u}", int(t) * (3_000_000 + u * 997), t, pick(), float(np.sin(t / 19) * 3 + rng.normal() / (1 + u % 4)) if t % 9 else 1e6, pick()) for u in range(40) for t in range(0, 4 + 3 * u, 1 + u % 2)]
    rows += [("flat", 5, i, 1.0, 3.0, None) for i in range(12)] + [("line", i * 1_000_000, i, None, float(i), 0.0) for i in range(30)] + [("one", 0, 0, 1.0, None, 2.0)]
    rows += [("bell", i * 1_000_000, i, None, float(50 + 5 * x), None) for i, x in enumerate(rng.normal(size=400))]
    return spark.createDataFrame(rows, "unit string, us long, rid long, a double, b double, c double")


def key(df):
    return {(r.unit, r.channel): r.asDict() for r in df.collect()}


def test_along_equals_apart(spark, monkeypatch):
    x = wide(spark)
    plan = P.profiles(x, CHANNELS)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [unit") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = key(P.profiles(x, CHANNELS))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(P, "SHORT", 50)  # some units of either sort
    mixed = key(P.profiles(x, CHANNELS))
    monkeypatch.setattr(P, "SHORT", 0)
    want = key(P.profiles(x, CHANNELS))
    assert len(got) == 44 * 4 and got.keys() == want.keys() == mixed.keys()
    for k in want:
        for c, v in want[k].items():
            for other in (got[k][c], mixed[k][c]):
                assert other == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, c)
    assert any(r["gaussian"] for r in got.values()) and any(r["acf_half_s"] not in (None, float("inf")) for r in got.values())


def test_quantiles_of_the_test_of_normality(spark):
    p = np.array([1e-9, 0.01, 0.3, 0.5, 0.9, 0.97, 0.999999])
    rows = spark.createDataFrame([(float(x),) for x in p], "p double").select("p", chi2_1_quantile(F.col("p")).alias("q"))
    assert {r.p: r.q for r in rows.collect()} == pytest.approx(dict(zip(map(float, p), D.normal_quantile((1 + p) / 2) ** 2)), rel=1e-12, abs=1e-15)


def test_lent_profiles_are_not_shuffled(spark):
    listing = spark.createDataFrame([(s, 1, s, s * 10**9, "a", s > 1) for s in range(1, 4)], "series long, entity long, bar long, start long, stamp string, whole boolean")
    x = spark.createDataFrame([(s, 1, s * 10**9 + i * 10**6, i, None if s == 1 and i > 5 else 0, float(i * i % 7)) for s in range(1, 4) for i in range(12)], "series long, entity long, us long, rid long, label int, a double")
    out = P.profile_pass(listing, lambda some: x.join(some, "series", "left_semi"), (("a", 0.0, 9.0, False),))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.unit: (r.scope, r.n_total, r.mean, r.digest) for r in out.collect()}
    assert out.count() == len(got) == 9 and got["labelled:1"][1] == 6
    assert all(got[f"{u}"][1:3] == got[f"instance:{s}"][1:3] for s in (2, 3) for u in (f"labelled:{s}", f"bar:1-{s}"))
    assert got["bar:1-2"][3] != got["instance:2"][3]
