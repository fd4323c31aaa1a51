"""The neighbour search and the clusters on it against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import maps as M
from chronolith.operators import neighbours as N


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def blobs(seed, n, dims):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, s, (n // 3, dims)) for c, s in zip(rng.uniform(-10, 10, (3, dims)), (0.1, 1, 3))])


@pytest.mark.parametrize("dims, ring, sent", [(2, 1024, 16_384), (3, 7, 10), (16, 40, 50)])
def test_neighbours_by_all_pairs(spark, monkeypatch, dims, ring, sent):
    monkeypatch.setattr(N, "RING", ring)
    monkeypatch.setattr(N, "SENT", sent)
    x = blobs(dims, 360, dims)
    x[::40] = x[0]  # copies
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    known = N.cells(table(spark, x))
    for radius in (0.0, 0.4, 3.0):
        got = {(r.a, r.b): r.d for r in N.within(known.rows.select("id", "x", F.lit(radius).alias("bound")), known).collect()}
        want = {(a, b): d[a, b] for a, b in zip(*np.nonzero(d <= radius)) if a != b}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for k in (1, 5):
        got = {}
        for r in N.nearest(known, k).collect():
            got.setdefault(r.a, set()).add(r.b)
        order = [sorted((d[a, b], b) for b in range(len(x)) if b != a)[:k] for a in range(len(x))]
        assert got == {a: {b for _, b in o} for a, o in enumerate(order)}
    some = N.nearest(known, 3, table(spark, x).where("id % 50 = 0"))
    assert {r.a for r in some.collect()} == set(range(0, len(x), 50))


def test_few_points(spark):
    known = N.cells(table(spark, np.zeros((0, 2))))
    assert N.nearest(known, 3).count() == 0
    known = N.cells(table(spark, np.array([[0.0, 0], [1, 0]])))
    assert sorted(map(tuple, N.nearest(known, 5).collect())) == [(0, 1, 1.0), (1, 0, 1.0)]


def test_few_pairs_are_compared(spark):
    """At 100,000 points of a plane under one in twenty pairs is compared."""
    n = 100_000
    rows = spark.range(n).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1_000_003)) / 1_000_003.0 for s in (1, 2)]).alias("x"))
    known = N.cells(rows)
    sent = N.targets(known.rows.select("id", "x", F.lit(0.003).alias("bound")), known)
    assert N.compared(sent, known) < 0.05 * n * n


def clusters(x, neighbours=5, least=5):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    off = d + np.where(np.eye(len(x)), np.inf, 0)
    radius = np.median(np.sort(off, axis=1)[:, min(neighbours, len(x) - 1) - 1])
    near = off <= radius
    core = near.sum(axis=1) + 1 >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    out = label.copy()
    for i in np.flatnonzero(~core):
        reach = sorted((d[i, j], j) for j in np.flatnonzero(near[i] & core))
        if reach:
            out[i] = label[reach[0][1]]
    return out.tolist()


def test_density_clusters_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "RING", 20)
    for x in (blobs(5, 150, 2), np.concatenate([np.repeat([[1.0, 1.0]], 60, axis=0), blobs(6, 90, 2)]), np.array([[0.0], [1.0], [5.0]])):
        got = {r.id: r.cluster for r in M.density_clusters(table(spark, x)).collect()}
        assert [got[i] for i in range(len(x))] == clusters(x)


def test_rings_in_small_blocks(spark, monkeypatch):
    """Queries are sent to blocks of a few rings, and each is met ring by ring or as one."""
    monkeypatch.setattr(N, "BLOCK", (20, 60))
    monkeypatch.setattr(N, "RING", 15)
    monkeypatch.setattr(N, "SENT", 70)
    for dims in (2, 24):
        x = blobs(dims, 360, dims)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        got = {}
        for r in N.nearest(N.cells(table(spark, x)), 4).collect():
            got.setdefault(r.a, set()).add(r.b)
        assert got == {a: {b for _, b in sorted((d[a, b], b) for b in range(len(x)) if b != a)[:4]} for a in range(len(x))}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Labels of 200 cores in a row meet in rounds by the logarithm, not by the chain's length."""
    rounds, stored = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, tag: (rounds.append(tag), stored(df, tag))[1])
    got = M.density_clusters(table(spark, np.arange(200.0)[:, None]), neighbours=1, least=2).collect()
    assert {r.cluster for r in got} == {0} and len(got) == 200
    assert rounds.count("spread") <= 12
