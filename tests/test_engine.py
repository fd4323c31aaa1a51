"""Hand-worked cases of the recordings engine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import labels as L
from chronolith.operators import availability as A
from chronolith.operators import distribution as D
from chronolith.operators import intervals as I
from chronolith.operators import maps as M
from chronolith.operators import outputs as G
from chronolith.operators import quality as K
from chronolith.operators import series as S
from chronolith.operators.ordering import earliest
from chronolith.operators import windows as W

SEC = 1_000_000


def series(spark, values, labels=None, key=1):
    labels = labels or [None] * len(values)
    data = [(key, 1, 0, i * SEC, i, None if v is None else float(v), lab) for i, (v, lab) in enumerate(zip(values, labels))]
    return spark.createDataFrame(data, "series long, entity long, fault int, us long, rid long, value double, label int")


def column(df, name, by="rid"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_kinds(spark):
    y = [1, 1, 2, 3, 4, 4, None, 5, 6, 7, 9, 9]
    kinds = S.sample_kinds(series(spark, y))
    assert column(kinds, "kind") == [0, 2, 1, 1, 0, 2, -1, 0, 1, 0, 0, 2]
    s = S.sampling_summary(kinds, S.sampling_step(series(spark, y))).first()
    assert (s.n_valid, s.n_genuine, s.n_interpolated, s.n_held, s.spacing_s) == (11, 5, 3, 3, 10 / 4)


def test_historian_series(spark):
    y = np.interp(np.arange(3600), np.arange(0, 3610, 10), np.random.default_rng(1).normal(100, 10, 361))
    s = S.sampling_summary(S.sample_kinds(series(spark, y.tolist())), S.sampling_step(series(spark, y.tolist()))).first()
    assert abs(s.n_genuine - 361) <= 2 and s.spacing_s == pytest.approx(10, abs=0.1)


def test_autocorrelation_and_noise(spark):
    rng = np.random.default_rng(2)
    y = [0.0]
    for e in rng.normal(size=20_000):
        y.append(0.9 * y[-1] + e)
    x = series(spark, y)
    assert S.autocorrelation_half(x, S.sampling_step(x)).first().acf_half_s == pytest.approx(6.58, abs=0.6)
    noise = series(spark, rng.normal(size=20_000).tolist())
    assert S.signal_to_noise(noise).first().snr == pytest.approx(1, abs=0.05)
    assert S.gaussianity(noise).first().gaussian and not S.gaussianity(series(spark, rng.uniform(size=20_000).tolist())).first().gaussian


def test_autocorrelation_of_blocks(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=203), 3)
    rows = [("a", i * SEC, i, None if i % 50 == 7 else float(v)) for i, v in enumerate(y)] + [("b", i * SEC, i, 2.0) for i in range(9)] + [("c", 0, 0, 1.0), (None, 0, 0, 1.0), (None, SEC, 1, 3.0)]
    x = spark.createDataFrame(rows, "series string, us long, rid long, value double")
    known = np.array([v for i, v in enumerate(y) if i % 50 != 7])
    known = known - known.mean()
    for block, longest in ((16, 40.0), (1000, 1e6), (7, 6.0)):
        got = {(r.series, r.lag): r.rho for r in S.autocorrelation(x, S.sampling_step(x), longest_s=longest, block=block).collect()}
        lags = int(min(longest, len(known) - 1))
        assert {k for k in got if k[0] == "a"} == {("a", k) for k in range(lags + 1)} and {k[0] for k in got} == {"a"}
        for k in range(lags + 1):
            assert got["a", k] == pytest.approx(float(known[: len(known) - k] @ known[k:] / (known @ known)), abs=1e-9)
    half = {r.series: r.acf_half_s for r in S.autocorrelation_half(x, S.sampling_step(x)).collect()}
    assert set(half) == {"a", "b", "c", None} and half["b"] is None and half["c"] is None and 0 < half["a"] <= 1


def test_flat_and_short_series(spark):
    m = S.moments(series(spark, [118.5] * 20)).first()
    assert (m["mean"], m["std"], m["skew"]) == (118.5, 0.0, None)
    assert S.signal_to_noise(series(spark, [1.0] * 9)).first().snr is None
    assert S.moments(series(spark, [None, None])).first().n == 0


def test_chi2_quantile(spark):
    got = spark.range(1).select(*[L.chi2_1_quantile(F.lit(p)).alias(str(i)) for i, p in enumerate((0.5, 0.95, 0.99))]).first()
    assert list(got) == pytest.approx([0.454936, 3.841459, 6.634897], rel=1e-5)


def test_window_labels(spark):
    lab = [0] * 10 + [101] * 3 + [None] * 5 + [1] * 8
    w = W.windows(W.cut(series(spark, range(26), lab), 4), 4)
    rows = w.orderBy("window").collect()
    assert [r.start // SEC for r in rows] == [0, 4, 8, 10, 13, 17, 18, 22] and [r.n_valid for r in rows] == [4, 4, 2, 3, 4, 1, 4, 4]
    assert rows[2]["values"] == [8.0, 9.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        W.cut(series(spark, [1]), 0)


def test_auc(spark):
    x = spark.createDataFrame([(1.0, False), (2.0, False), (2.0, True), (3.0, True)], "s double, e boolean")
    assert W.auc(x, "s", F.col("e"), [], 1).first().auc == 0.875


def cat(spark, rows):
    runs = "array<struct<start:long,end:long,value:int>>"
    return spark.createDataFrame([(s, 1, 0, a, b, b - a, 0, 0.0, 0.0, "normal", r, 0.0) for s, a, b, r in rows], f"series long, entity long, fault int, start long, end long, n_samples long, n_valid long, low double, high double, reach string, runs {runs}, hours double")


def brute_groups(rows):
    bars = []
    for s, a, b, r in sorted(rows, key=lambda x: (x[1], x[0])):
        ok = lambda m: not any(x[0] < y[1] and y[0] < x[1] and None not in (x[2], y[2]) and x[2] != y[2] for x in r for y in m[3])
        for g in bars:
            touching = [m for m in g if a <= m[2] and m[1] <= b]
            if touching and all(map(ok, touching)):
                g.append((s, a, b, r))
                break
        else:
            bars.append([(s, a, b, r)])
    return {m[0]: i for i, g in enumerate(bars) for m in g}


@pytest.mark.parametrize("seed", range(4))
def test_join_groups_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(14):
        a = rng.randint(0, 60)
        b = a + rng.randint(1, 12)
        c = rng.randint(a, b)
        rows.append((s, a, b, [(a, c, rng.choice([0, 0, None, 1 if seed % 2 else 0])), (c, b + 1, rng.choice([0, None]))]))
    got = {r.series: r.bar for r in I.join_groups(cat(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_coverage_and_lanes(spark):
    c = cat(spark, [(1, 0, 10, []), (2, 5, 15, []), (3, 20, 30, []), (4, 10, 12, [])])
    assert [(r.start, r.end, r.depth) for r in I.coverage(c).orderBy("start").collect()] == [(0, 5, 1), (5, 10, 2), (10, 12, 2), (12, 15, 1), (15, 20, 0), (20, 30, 1)]
    assert {r.series: r.lane for r in I.pack_lanes(c).collect()} == {1: 0, 2: 1, 3: 0, 4: 2}
    assert I.lane_counts(c).first().lanes == 3


def test_merge_at_boundaries(spark):
    c = cat(spark, [(1, 0, 9, [(0, 4, 0), (4, 10, None)]), (2, 2, 14, [(2, 8, 0), (8, 15, 109)])]).withColumn("bar", F.lit(0))
    got = [(r.start, r.end, r.value, r.source) for r in I.merge_runs(c).orderBy("start").collect()]
    assert got == [(0, 4, 0, 1), (4, 8, 0, 2), (8, 15, 109, 2)]
    assert [(r.start, r.end, r.value, r.sources) for r in I.history(I.merge_runs(c)).orderBy("start").collect()] == [(0, 8, 0, [1, 2]), (8, 15, 109, [2])]


def test_time_axis(spark):
    h = 3600 * SEC
    c = cat(spark, [(1, 0, 2 * h, []), (2, h, 3 * h, []), (3, 20 * h, 23 * h, [])])
    axis = I.block_axis(I.time_blocks(c)).orderBy("block").collect()
    assert [(r.x0, r.x1) for r in axis] == [(0, 3), (pytest.approx(3.72), pytest.approx(6.72))]
    p = I.to_axis(spark.createDataFrame([(1, 21 * h)], "entity long, us long"), I.block_axis(I.time_blocks(c))).first()
    assert p.x == pytest.approx(4.72)


def test_onset(spark):
    x = series(spark, [None] * 5, [None, 0, 0, 109, 9]).withColumn("fault", F.lit(9))
    o = I.onsets(x).first()
    assert (o.start, o.transient, o.steady) == (0, 3 * SEC, 4 * SEC)


def test_sensor_states_and_pairs(spark):
    wide = spark.createDataFrame([(1, float(i), 118.5 if i > 3 else None, None) for i in range(10)], "bar long, p double, t double, q double")
    fact = {r.channel: r.state for r in A.facts(A.unpivoted(wide, ["bar"], ["p", "t", "q"]), ["bar"], -1e8, 1e8).collect()}
    assert fact == {"p": 2, "t": 1, "q": 0}
    pairs = {(r.a, r.b): r.n for r in A.pair_counts(wide, ["bar"], ["p", "t", "q"]).collect()}
    assert pairs == {("p", "p"): 10, ("p", "t"): 6, ("p", "q"): 0, ("t", "t"): 6, ("t", "q"): 0, ("q", "q"): 0}
    assert A.seriation([("a", "a", 9), ("b", "b", 9), ("c", "c", 9), ("a", "b", 9), ("b", "c", 1), ("a", "c", 0), ("d", "d", 0)])[-1] == "d"


def test_order_breaks(spark):
    def frame(bad):
        return spark.createDataFrame([(1, 20e6 + i, 18e6 + i + (4e6 if i < bad else 0), 15e6 + i) for i in range(1000)], "series long, a double, b double, c double")

    assert K.order_breaks(frame(5), ["a", "b", "c"], 1e6, 0, 1e8).count() == 0
    got = K.order_breaks(frame(20), ["a", "b", "c"], 1e6, 0, 1e8).first()
    assert (got.up, got.down, got.broken, got.compared) == ("a", "b", 20, 1000)
    assert {r.channel: r.partners for r in K.partners(K.order_breaks(frame(20), ["a", "b", "c"], 1e6, 0, 1e8)).collect()} == {"a": ["b"], "b": ["a"]}


def test_gated_pairs(spark):
    x = spark.createDataFrame([(1, 1e7 + i, 2e7 + i, float(i % 2), 1.0) for i in range(100)], "series long, u double, d double, g double, h double")
    got = K.order_breaks(x, [], 1e6, 0, 1e8, pairs=[("u", "d", ["g", "h"])]).first()
    assert (got.compared, got.broken) == (50, 50)
    assert K.order_breaks(x.withColumn("d", F.lit(3e7)), ["u", "d"], 1e6, 0, 1e8).count() == 0
    assert K.order_breaks(x, ["u", "d"], 1e6, 0, 1e8, gates={"d": ["g"]}).first().compared == 50


def test_state_rules(spark):
    x = spark.createDataFrame([(1, 1, False, True)] * 9 + [(1, 1, None, None)], "series long, state int, w boolean, p boolean")
    got = {r.rule: (r.tested, r.broken) for r in K.state_breaks(x, [(1, "all", True, ["w", "p"]), (1, "any", True, ["w", "p"]), (1, "any", False, ["p"])]).collect()}
    assert got == {0: (9, 9), 2: (9, 9)}


def test_cleaning(spark):
    rng = np.random.default_rng(3)
    rows = [(e, c, float(rng.normal(10, 1)), float(rng.uniform(1, 2))) for e in range(40) for c in "ab"]
    rows = [(e, c, 99.0 if (e, c) == (3, "a") else m, 50.0 if (e, c) == (7, "b") else s) for e, c, m, s in rows] + [(e, "z", None, None) for e in range(40)]
    flagged, dropped = K.robust_cleaning(spark.createDataFrame(rows, "event int, channel string, mean double, std double"))
    assert {(r.event, r.channel, r.by_mean, r.by_std) for r in flagged.where("discard").collect()} == {(3, "a", True, False), (7, "b", False, True)}
    assert {r.channel for r in dropped.where("dropped").collect()} == {"z"}
    assert {r.event: r.why for r in K.reasons(flagged).collect()} == {3: "a by mean", 7: "b by std"}


def test_histogram_and_density(spark):
    x = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, 4.0, 4.0, 2.0, None)], "v double")
    assert [r.n for r in D.histogram(x, "v", 2, []).orderBy("bin").collect()] == [2, 5]
    assert {r.bin: r.n for r in D.histogram_edges(x, "v", [0, 2, 3], []).collect()} == {0: 2, 1: 3, -1: 2}


def test_lomb_scargle_finds_a_sine(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 1000, 400))
    rows = spark.createDataFrame([(1, float(a), float(3 + np.sin(2 * np.pi * a / 50))) for a in t], "series long, t double, y double")
    periods = spark.createDataFrame([(p,) for p in (20.0, 50.0, 90.0)], "period double")
    spec = D.lomb_scargle(rows, periods, "y", "t", ["series"])
    best = D.dominant(spec, ["series"], 100.0).first()
    assert best.period == 50.0 and spec.where("period = 50").first().power == pytest.approx(1, abs=1e-6)


def test_welch_peak(spark):
    y = np.sin(2 * np.pi * np.arange(1024) / 32)
    out = D.welch(series(spark, y.tolist()), SEC, 256)
    assert out.orderBy(F.desc("psd")).first().period == pytest.approx(32)


def planted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, c, i % 3, (rng.normal(size=4) * 0.1 + np.eye(4)[c] * 5).tolist()) for i, c in enumerate([0, 1, 2] * 20)]
    return spark.createDataFrame(rows, "id long, cls int, entity long, x array<double>")


def test_map(spark):
    p = planted(spark)
    _, explained = M.principal(p)
    assert sum(explained) > 0.95
    found = M.clustered(p, 3)
    assert M.agreement(found, "cls", "cluster").first().ari == pytest.approx(1)
    assert M.silhouette(p, "cls").agg(F.min("s")).first()[0] > 0.9
    t = M.typicality(p).toPandas()
    assert (t.groupby("cls").typical.max() == 1).all() and (t.groupby("cls").typical.min() == 0).all()
    n = M.novelty(p).toPandas()
    assert n[n.cls != 0].anomalous.all() and n[n.cls == 0].anomalous.sum() <= 2
    d = M.warped(p.withColumn("z", F.col("x")).where("id < 9")).toPandas()
    assert len(d) == 9 and (d.d >= 0).all()


def test_agreement_of_outputs(spark):
    seg = spark.createDataFrame([(1, 0, 1800 * SEC, 0), (1, 1800 * SEC, 2400 * SEC, None)], "series long, start long, end long, value int")
    ver = spark.createDataFrame([(1, 0, 1500 * SEC, 0), (1, 1500 * SEC, 2400 * SEC, 1)], "series long, start long, end long, value int")
    got = G.agreement(G.split(ver, seg), ["series"]).first()
    assert (got.scored, got.compared, got.agreed) == (2400, 1800, 1500)


def test_chart_flags_a_shift(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(1500, 2))
    rows = [(1, float(a), float(a + 0.1 * b), float(b)) for a, b in z]
    x = spark.createDataFrame(rows, "grp long, p double, q double, r double")
    model = G.fit_chart(x, ["p", "q", "r"], "grp")
    own = G.chart_labels(x, model, ["p", "q", "r"]).agg(F.avg("label")).first()[0]
    moved = G.chart_labels(x.withColumn("q", F.col("q") + 5), model, ["p", "q", "r"]).agg(F.avg("label")).first()[0]
    assert own < 0.03 and moved > 0.99


def test_fill_and_detrend(spark):
    g = S.fill_linear(S.uniform_grid(series(spark, [None, 1, None, None, 4, None]), SEC))
    assert column(g, "filled", "cell") == [1, 1, 2, 3, 4, 4]
    rest = S.detrend(series(spark, [1, 3, 5, 7]), "value", "rid")
    assert max(abs(v) for v in column(rest, "rest")) < 1e-9 and not math.isnan(column(rest, "rest")[0])


def test_scoring_job(spark):
    """Per entity and per recording: what lacks normal rows, or a channel that moves, is skipped, and only chosen recordings are scored."""
    rng = np.random.default_rng(8)
    rows = []
    for recording, (entity, n, spoilt) in enumerate([(1, 80, False), (1, 80, True), (2, 5, False), (3, 80, False)]):
        for i in range(n):
            a = float(rng.normal())
            far = spoilt and i >= 60
            rows.append((recording, entity, i, 1.0 if entity == 3 else a, 2 * a + float(rng.normal()) * 0.1 + (30.0 if far else 0.0), float(rng.normal()), 1 if far else 0))
    x = spark.createDataFrame(rows, "recording long, entity long, us long, p double, t double, q double, label int")
    normal = F.col("label") == 0
    out, report = G.scoring_job(x, ["p", "t", "q"], "recording", "entity", normal, F.col("recording") != 0, 50)
    assert {(r.recording, r.grp, r.training_samples, r.scored) for r in report.collect()} == {(1, 1, 140, True), (2, 2, 5, False), (3, 3, 80, False)}
    got = out.collect()
    assert len(got) == 80 and {r.recording for r in got} == {1} and all(r.score > 1 and r.label == 1 for r in got if r.us >= 60)
    out, report = G.scoring_job(x, ["p", "t", "q"], "recording", "recording", normal, None, 50)
    assert {(r.recording, r.scored) for r in report.collect()} == {(0, True), (1, True), (2, False), (3, False)} and out.count() == 160


def test_earliest(spark):
    x = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 9), (None, 4)], "g int, at int")
    assert {tuple(r) for r in earliest(x, ["g"], ["at"], 2).collect()} == {(1, 1), (1, 2), (2, 9), (None, 4)}
