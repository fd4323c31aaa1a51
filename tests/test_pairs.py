"""Sums over all pairs on the grid against brute force, on small blocks, with copies, missing points and repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import maps as M
from chronolith.operators import pairs as P

rng = np.random.default_rng(3)
X = np.concatenate([rng.normal(0, 1, (60, 5)), rng.normal(1e4, 1e-3, (40, 5)), np.repeat(rng.normal(0, 1, (3, 5)), 7, axis=0)])
CLS = (np.arange(len(X)) % 3).tolist()
D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 20), ("LEAST", 4), ("TALL", 7), ("WIDE", 9)):
        monkeypatch.setattr(P, name, value)


def table(spark, x=X, cls=CLS):
    return spark.createDataFrame([(i, c, i % 5, v.tolist()) for i, (c, v) in enumerate(zip(cls, x))], "id long, cls int, entity long, x array<double>")


@pytest.fixture(scope="module")
def many(spark):
    """30,000 points in 60 places: 900 million pairs, of 60 places 3,600."""
    place = F.col("id") % 60
    return spark.range(30_000).select("id", (place % 3).cast("int").alias("cls"), (F.col("id") % 5).alias("entity"), F.array(*[((place * k) % 61).cast("double") for k in (7, 11, 13)]).alias("x"))


def test_typicality_by_all_pairs(spark, small):
    got = {r.id: r for r in M.typicality(table(spark)).collect()}
    for c in range(3):
        own = [i for i in range(len(X)) if CLS[i] == c]
        medoid = min(own, key=lambda i: (round(D[i, own].sum(), 9), i))
        order = sorted(own, key=lambda i: (D[medoid, i], i))
        for k, i in enumerate(order):
            assert (got[i].medoid, got[i].distance, got[i].typical) == (medoid, pytest.approx(D[medoid, i]), pytest.approx(1 - k / (len(own) - 1)))
    assert len(got) == len(X)


def test_typicality_of_many_copies(spark, many):
    out = M.typicality(many).agg(F.count(F.lit(1)), F.count_distinct("medoid"), F.max("medoid")).first()
    assert out[0] == 30_000 and out[1] == 3 and out[2] < 60


def test_novelty_by_all_pairs(spark, small):
    got = {r.id: r for r in M.novelty(table(spark)).collect()}
    own = [i for i in range(len(X)) if CLS[i] == 0]
    score = np.exp(-(D[:, own] ** 2) / X[own].var(axis=0).sum()).mean(axis=1)
    limit = np.quantile(score[own], 0.05)
    for i in range(len(X)):
        assert got[i].score == pytest.approx(score[i])
        assert got[i].anomalous == (score[i] < limit) or score[i] == pytest.approx(limit)
    assert len(got) == len(X)


def test_novelty_of_many_copies(spark, many):
    assert M.novelty(many).agg(F.count(F.lit(1)), F.count_distinct(F.round("score", 9))).first()[0] == 30_000


def silhouettes(d, cls):
    out = []
    for i, c in enumerate(cls):
        mean = {k: np.mean([d[i, j] for j in range(len(cls)) if cls[j] == k and j != i]) for k in set(cls) if any(cls[j] == k and j != i for j in range(len(cls)))}
        a, b = mean.get(c), min(v for k, v in mean.items() if k != c)
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return out


def test_silhouettes_by_all_pairs(spark, small):
    cls = [*CLS[:-1], 9]  # a cluster of one
    got = {r.id: r.s for r in M.silhouette(table(spark, cls=cls), "cls").collect()}
    assert [got[i] for i in range(len(X))] == pytest.approx(silhouettes(D, cls), abs=1e-9)
    noise = table(spark).union(spark.createDataFrame([(500, -1, 0, X[0].tolist()), (501, None, 0, X[0].tolist()), (502, 1, 0, None)], "id long, cls int, entity long, x array<double>"))
    got = {r.id: r.s for r in M.silhouette(noise, "cls").collect()}
    assert got.pop(502) == 0.0 and len(got) == len(X)
    assert [got[i] for i in range(len(X))] == pytest.approx(silhouettes(D, CLS), abs=1e-9)


def test_silhouettes_of_repeated_ids(spark, small):
    """Points of one id are not compared, as in SQL's a.id <> b.id."""
    rows = [(1, 0, 0, [0.0]), (1, 0, 0, [9.0]), (2, 0, 0, [1.0]), (3, 1, 0, [4.0])]
    got = {r.id: r.s for r in M.silhouette(spark.createDataFrame(rows, "id long, cls int, entity long, x array<double>"), "cls").collect()}
    assert got == {1: pytest.approx((4.5 - 4.5) / 4.5), 2: pytest.approx((3 - 4.5) / 4.5), 3: 0.0}


def test_silhouettes_of_many_copies(spark, many):
    assert M.silhouette(many, "cls").count() == 30_000


def test_nearest_points_by_all_pairs(spark, small):
    p = table(spark)
    for k, apart in ((1, None), (10, None), (3, "entity"), (200, None)):
        got = {}
        for r in M.nearest_points(p.where("id % 50 = 0 or id >= 100"), p, k, apart).collect():
            got.setdefault(r.a, []).append((r["rank"], r.b))
        for i in [0, 50, *range(100, len(X))]:
            want = sorted((D[i, j], j) for j in range(len(X)) if j != i and not (apart and i % 5 == j % 5))[:k]
            assert [b for _, b in sorted(got[i])] == [j for _, j in want]


def test_distances_by_all_pairs(spark, small):
    p = table(spark).union(spark.createDataFrame([(500, 1, 0, None)], "id long, cls int, entity long, x array<double>"))
    got = {(r.a, r.b): r for r in M.distances(p.where("id % 50 = 0"), p).collect()}
    assert len(got) == 4 * len(X)
    for i in (0, 50, 100):
        for j in range(len(X)):
            if i != j:
                r = got[i, j]
                assert (r.d, r.a_cls, r.b_cls, r.a_entity, r.b_entity) == (pytest.approx(D[i, j], rel=1e-9), CLS[i], CLS[j], i % 5, j % 5)
        assert got[i, 500].d is None and got[500, i].d is None


def test_searches_compare_block_with_block(spark):
    """Points are dealt to blocks; pairs are never rows of a join."""
    p = table(spark)
    for df in (M.distances(p, p), M.nearest_points(p, p, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan
